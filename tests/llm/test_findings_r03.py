"""Faults found in round 3."""

from tessera.llm import urls

PAGES = "page_id bigint, url string, html string"


def test_every_rule_gives_its_verdict(spark):
    link = '<link rel="canonical" href="http://example.org/en/12">'
    pages = [
        (1, "http://example.org/", ""), (2, "http://a.Example.org/es/x", ""), (3, "https://example.org/en/1", ""), (4, "https://b.example.org/en/19?q", ""), (5, "http://example.org/en/2", ""),
        (6, "http://x.com/fr/1", ""), (7, "http://x.com/de/1", ""), (8, "http://x.net/1", link), (9, "http://x.net/2", ""),
    ]
    made = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(pages, PAGES)).collect()}
    assert made == {
        1: ("org/", "allow"), 2: ("example.org/es/", "block"), 3: ("example.org/en/1", "block"), 4: ("example.org/en/1", "block"), 5: ("org/", "allow"),
        6: ("com/fr/", "allow"), 7: ("com/de/", "block"), 8: (None, "block"), 9: (None, "allow"),
    }


def test_pipeline_links_by_simhash_and_by_similarity(spark, monkeypatch):
    """1 and 2 are linked by fingerprints alone, 2 and 3 by min-hash alone; 4 is linked to 1 by chance and is not similar."""
    import corpus_pipeline as c
    from tessera.llm import minhash, simhash

    def found(pairs):
        def near(docs, doc_id, **_):
            of = {r[0].d: r[0] for r in docs.select(doc_id).collect()}
            rows = [(of[d], of[pairs.get(d, d)]) for d in of]
            kind = dict(docs.dtypes)[doc_id]
            return spark.createDataFrame(rows, f"doc_id {kind}, component_id {kind}")

        return near

    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text) for i, text in ((4, "other"), (3, "third"), (2, words + " more"), (1, words))], "doc_id bigint, text string")
    with monkeypatch.context() as m:
        m.setattr(simhash, "near_duplicates", found({2: 1, 4: 1}))
        m.setattr(minhash, "near_duplicates", found({3: 2}))
        assert sorted(r.doc_id for r in c.drop_near_duplicates(spark, docs, "").collect()) == [1, 4]
