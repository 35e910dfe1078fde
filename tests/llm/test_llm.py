import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, graph, language, line_dedup, packing, quality, queries, search, simhash, token_counts, toxicity, urls

PATTERN = public_tokenizers.PATTERN
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four"), (4, "one two three four"), (None, "x " * 9000), (5, "é" * 3000 + "\n\n" + "ß"), (6, "\x1c\x85 a　b  c ")]


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def odd(spark, rows=ODD):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with inner ones."""
    more = {"row": 1, "row_": 2, "runs_": 3, "score": 4, "counts": 5, "lines_removed": 6, "t": "z", "a.b": 7}
    return frame(spark, rows).withColumn("source", F.lit(None).cast("string")).select("*", *[F.lit(v).alias(k) for k, v in more.items()])


def by_sql(name, **tables):
    """A query's SQL equivalent over small tables."""
    import duckdb

    con = duckdb.connect()
    for key, value in tables.items():
        con.register(key, value)
    return con.execute(queries.ORACLE_SQL[name]).df()


def empty(spark):
    return odd(spark, [])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    parts = ["word", " ", "  ", "\n", "'ll", "é", "漢字", "12", "…", "!", "\t", "naïve", "😀", "_", "tion", "Ab", "\x1c", "　"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)]


def test_bpe_is_the_library_and_round_trips(spark, texts):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = frame(spark, list(enumerate(texts)) + [(None, None)])
    made = bpe.encode_column(docs, path, PATTERN, outputs=("ids", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    for r in made:
        t = "" if r.doc_id is None else texts[r.doc_id]
        ids = known.encode_ordinary(t)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = bpe.decode_column(bpe.encode_column(docs, path, PATTERN), path, PATTERN).collect()
    assert all(bytes(r.decoded).decode() == ("" if r.doc_id is None else texts[r.doc_id]) for r in back)
    assert bpe.encode_column(odd(spark), path, PATTERN).count() == len(ODD) and bpe.encode_column(empty(spark), path, PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [b"%d" % i for i in range(3000)]
    h = bpe.MinimalPerfectHash(keys)
    assert sorted(map(h, keys)) == list(range(3000))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(100)] + [(200 + i, 201 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 60)] + [(None, 1), (7, 7)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        if a is not None and a != b and find(a) != find(b):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    made = {r.node: r.root for r in graph.connected_components(frame(spark, links, "a bigint, b bigint")).collect()}
    assert made == {x: find(x) for x in top}
    assert graph.connected_components(frame(spark, [], "a bigint, b bigint")).count() == 0


def plain_fingerprint(text):
    import xxhash

    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("node_rows", [1 << 16, 40])
def test_fingerprints_link_as_by_brute_force(spark, node_rows):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 60, dtype=np.int64)
    near = [int(s) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for s in seeds for _ in range(12)]
    fps = sorted(set(near))
    made = graph.connected_components(simhash.link_fingerprints(frame(spark, [(x,) for x in fps], "fp bigint"), node_rows=node_rows))
    got = {r.node: r.root for r in made.collect()}
    top = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3 and top[i] != top[j]:
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    assert [got.get(x, x) for x in fps] == [fps[t] for t in top]


def test_the_gray_index_prunes():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, 6000, dtype=np.uint64) << np.uint64(1)
    fp[3000:] = fp[:3000] ^ np.uint64(1 << 40) ^ (rng.integers(0, 2, 3000, dtype=np.uint64) << np.uint64(7))
    gray = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(shift)
    fp = fp[np.argsort(gray)]
    links = simhash.Forest(len(fp))
    compared = simhash.search(fp, 3, links)
    assert compared < 0.45 * len(fp) * (len(fp) - 1) / 2
    plain = simhash.Forest(len(fp))
    for i in range(len(fp)):
        j = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 3) + i + 1
        plain.add(np.full(len(j), i), j)
    assert (links.root[links.root] == plain.root[plain.root]).all() and len(set(links.root.tolist())) < 3100


def test_top_nodes_follow_the_number_of_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_MEMBERS", 4)  # many top nodes of a few members
    test_fingerprints_link_as_by_brute_force(spark, 1 << 16)


def test_near_duplicates_edges(spark):
    made = simhash.near_duplicates(odd(spark)).collect()
    assert len(made) == len(ODD)
    by = {r.doc_id: r for r in made}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[3].component_id == 1
    for r in made:
        t = next(t for i, t in ODD if i == r.doc_id)
        assert r.fp % 2**64 == plain_fingerprint(t)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def plain_quality(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_hosts(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(rng.choice("abc#|é") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    made = quality.judge(odd(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in made} == {i: plain_quality(t) for i, t in rows}
    assert len(quality.judge(odd(spark)).collect()) == len(ODD) and quality.judge(empty(spark)).count() == 0
    good = " ".join(f"w{i}" for i in range(60))
    hosts = [(i, good if i % 10 == 0 else "short", "bad") for i in range(300)] + [(1000 + i, good, "fine") for i in range(300)]
    kept = {r.doc_id for r in quality.judge(frame(spark, hosts, "doc_id bigint, text string, source string")).filter("kept").collect()}
    assert kept == {1000 + i for i in range(300)}


def plain_line_dedup(rows, least=50):
    """Delete every line of a later copy of a run with enough words, runs of every length. What overlaps the first copy
    is none."""
    seqs = [[(k, x) for k, x in enumerate((t or "").split("\n")) if x.split()] for _, t in rows]
    first, runs = {}, []
    for r in sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0, r)):
        for a in range(len(seqs[r])):
            for b in range(a + 1, len(seqs[r]) + 1):
                run = tuple(x for _, x in seqs[r][a:b])
                if sum(len(x.split()) for x in run) >= least:
                    r0, b0 = first.setdefault(run, (r, b))
                    if (r0, b0) != (r, b) and (r != r0 or a >= b0):
                        runs.append((r, a, b))
    gone = {(r, seqs[r][k][0]) for r, a, b in runs for k in range(a, b)}
    return ["\n".join(x for k, x in enumerate((t or "").split("\n")) if (r, k) not in gone) for r, (_, t) in enumerate(rows)]


def line_rows():
    rng = random.Random(9)
    lines = [" ".join(f"{rng.choice('abcd')}{j}{i}" for j in range(rng.choice((3, 12, 30, 55)))) for i in range(14)] + ["", "  "]
    thirty = " ".join(f"x{i}" for i in range(30))
    return [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for i in range(40)] + [(40, "\n".join([thirty] * 4)), (41, "\n".join([thirty, "", thirty, thirty]))]


def test_line_dedup_is_brute_force(spark):
    import pandas as pd

    rows = line_rows()
    made = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(odd(spark, rows)).collect()}
    assert [made[i] for i, _ in rows] == plain_line_dedup(rows)
    assert made[40].count("x0") == 2  # the first copy of the two lines stays
    sql = by_sql("op1_line_dedup", documents=pd.DataFrame(rows, columns=["doc_id", "text"])).set_index("doc_id")
    assert [sql.text_md5[i] for i, _ in rows] == [hashlib.md5(made[i].encode()).hexdigest() for i, _ in rows]


def test_copies_are_joined_to_maximal_runs(spark):
    copies = frame(spark, [(1, 5, 2), (1, 0, 2), (1, 1, 3), (1, 9, 1), (1, 7, 1), (2, 0, 1)], "row bigint, a int, m int")
    made = {r.row: [tuple(x) for x in r.runs] for r in line_dedup.maximal_runs(copies).collect()}
    assert made == {1: [(0, 4), (5, 8), (9, 10)], 2: [(0, 1)]}


def test_line_dedup_edges(spark):
    made = line_dedup.drop_repeated_lines(odd(spark))
    assert made.count() == len(ODD) and set(odd(spark).columns) == set(made.columns)
    assert made.filter("doc_id = 1 and text is null").count() == 1 and made.filter("doc_id = 2 and text = ''").count() == 1
    assert line_dedup.drop_repeated_lines(empty(spark)).count() == 0


def test_toxicity_learns_and_handles_odd_rows(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice(("ba", "ke", "lo", "mi", "tu")) for _ in range(rng.randint(1, 4))) for _ in range(800)]
    rows = []
    for i in range(700):
        w = [rng.choice(base) for _ in range(150)]
        if i % 4 == 0:
            for _ in range(8):
                w[rng.randrange(150)] = rng.choice(("grrvox", "zwhunk", "pfaxxq"))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs = frame(spark, rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(docs.filter("doc_id < 500").select("doc_id", "text"), docs.filter("doc_id < 500").select("doc_id", "toxic"))
    out = toxicity.score_texts(docs.filter("doc_id >= 500"), model, keep=("doc_id", "toxic")).toPandas()
    assert ((out.score >= 0.5) == (out.toxic == 1)).mean() > 0.95 and out.score.between(0, 1).all()
    assert toxicity.score_texts(odd(spark), model).filter("score between 0 and 1").count() == len(ODD)
    assert model.ordinary and model.toxic and b"grrvox" in model.toxic and b"grrvox" not in model.ordinary
    again = docs.filter("doc_id < 500").unionByName(docs.filter("doc_id = 0").crossJoin(spark.range(50)).drop("id"))  # copies of an id count once
    twice = toxicity.train(again.select("doc_id", "text"), docs.filter("doc_id < 500").select("doc_id", "toxic"))
    assert np.allclose(twice.weights, model.weights) and twice.toxic == model.toxic

    def plain_score(text):
        import zstandard

        made = []
        for content in (model.ordinary, model.ordinary + model.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            made.append([len(c.compress(w)) for w in toxicity.windows(text)])
        saved = sorted((a - b for a, b in zip(*made, strict=True)), reverse=True) or [0]
        n, over = len(saved), [sum(x >= k for x in saved) for k in (2, 4, 6, 8)]
        x = [min(saved[0], 16), min(sum(saved[:3]) / len(saved[:3]), 16), sum(saved) / n, sum(max(x, 0) for x in saved) / n, *(k / n for k in over), *(np.log(1 + k) for k in over), np.log(n)]
        z = model.weights[0] + sum(w * (v - m) / d for w, v, m, d in zip(model.weights[1:], x, model.shift, model.scale, strict=True))
        return 1 / (1 + np.exp(-min(max(z, -30), 30)))

    texts = {r[0]: r[1] for r in rows}
    assert all(abs(plain_score(texts[i]) - v) < 1e-9 for i, v in zip(out.doc_id, out.score, strict=True))
    long = frame(spark, [(i, texts[i] * (400 if i < 3 else 1)) for i in range(500)])  # texts of any length train
    assert toxicity.train(long, docs.filter("doc_id < 500").select("doc_id", "toxic")).toxic
    none = toxicity.train(docs.limit(0), docs.limit(0).select("doc_id", "toxic"))
    assert none.score("x") == 0.0
    whole = "a" * 500 + " b" * 300
    assert b"".join(toxicity.windows(whole)) == whole.encode()


PAGES = "page_id bigint, url string, html string"


def verdicts(spark, pages):
    return {tuple(r) for r in urls.judge_urls(frame(spark, pages, PAGES)).select("page_id", "host", "path", "rule", "verdict").collect()}


def test_urls(spark):
    link = '<html><head><link href="/net/a" rel="canonical"></head>'
    pages = [
        (1, "http://A.Example.org/es/1?q#f", ""), (2, "x", None), (3, None, ""), (4, "http://b.net/1", '<link rel="canonical" href="http://a.example.org/es/1?q">'),
        (5, "http://c.net/2", '<meta http-equiv="refresh" content="0; url=http://b.net/1">'), (6, "http://d.net/fr/2", '<link rel=canonical href=http://b.net/1>'), (7, "http://e.net/x/y", link), (8, "http://example.org", ""), (8, "http://myexample.org/es/", ""),
        (9, "http://f.net/1", '<link rel="canonical" href="http://g.com/de/1">'), (10, "http://h.com/fr/1", '<link rel="canonical" href="http://f.net/1">'),
    ]
    assert verdicts(spark, pages) == {
        (1, "a.example.org", "/es/1", "example.org/es/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "b.net", "/1", None, "block"), (5, "c.net", "/2", None, "block"),
        (6, "d.net", "/fr/2", None, "block"), (7, "e.net", "/x/y", None, "allow"), (8, "example.org", "", None, "allow"), (8, "myexample.org", "/es/", "org/", "allow"),
        (9, "f.net", "/1", None, "allow"), (10, "h.com", "/fr/1", "com/fr/", "allow"),
    }
    more = urls.judge_urls(frame(spark, pages[:3], PAGES), redirects=frame(spark, [("http://q.com/de/2", "http://r.net/"), ("http://r.net", None)], "src string, dst string"))
    assert more.count() == 3
    wide = frame(spark, [*pages, (11, "http://z.net/" + "p" * 50000, "<p>" * 40000)], PAGES).withColumn("node", F.lit(1)).withColumn("host", F.lit("x"))
    assert urls.judge_urls(wide).count() == 12 and urls.judge_urls(frame(spark, [], PAGES)).count() == 0


def test_thousands_of_aliases_are_judged_as_by_sql(spark):
    import pandas as pd

    rng = random.Random(12)
    kinds = ["http://A{}.example.org/es/{}", "https://a{}.example.org/en/1{}", "http://b{}.COM/de/{}", "http://b{}.com/fr/{}", *["http://n{}.net/{}", "https://N{}.net/p/{}?q=1#f"] * 3]
    names = [rng.choice(kinds).format(i % 60, i) for i in range(3000)]
    pages = []
    for i, name in enumerate(names):
        to = names[rng.choice((i // 7 * 7, rng.randrange(max(0, i - 5), i + 1)))]
        form = rng.choice(('<link rel="canonical" href="{}">', "<META http-equiv=refresh content='0; url={}'>", "<p>{}</p>"))
        pages.append((i, name, form.format(to)))
    made = verdicts(spark, pages)
    sql = by_sql("op6_urls", pages=pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    assert made == {tuple(None if x != x else x for x in r) for r in sql.itertuples(index=False)}
    free = [r[4] for r in made if r[3] is None]
    assert free.count("block") > 50 and free.count("allow") > 50


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, " ".join(texts[i : i + 1 + i % 40])) for i in range(200)] + [(None, None), (7777, "")]
    made = packing.pack(frame(spark, rows).repartition(5), public_tokenizers.path("byte_bpe_50k.tiktoken"), PATTERN, size=256).toPandas()
    for key, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = made[made.doc_id.isna() if key is None else made.doc_id == key].sort_values("start")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True):
            assert zlib.crc32(ids[s : s + n].tobytes()) == c
    sums = []
    for _, seq in made.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset.to_numpy() == np.r_[0, seq.length.cumsum().to_numpy()[:-1]]).all()
        sums.append(int(seq.length.sum()))
    assert all(n <= 256 and n & (n - 1) == 0 for n in sums)
    assert packing.pack(empty(spark), public_tokenizers.path("byte_bpe_50k.tiktoken"), PATTERN).count() == 0


def plain_viterbi(pieces, text):
    """Best score, then the piece that starts first; a character that is no piece costs ten below the least score."""
    table, unknown = dict(pieces), min(v for _, v in pieces) - 10.0
    s = "\u2581" + text.replace(" ", "\u2581")
    best = [(0.0, 0)]
    for end in range(1, len(s) + 1):
        found = None
        for start in range(max(0, end - 48), end):
            piece = s[start:end]
            if piece in table:
                score, n = best[start][0] + table[piece], best[start][1] + 1
            elif end - start == 1:
                score, n = best[start][0] + unknown, best[start][1] + len(piece.encode())
            else:
                continue
            if found is None or score > found[0]:
                found = (score, n)
        best.append(found)
    return best[-1]


def test_token_counts_are_the_unigram_tokenizers(spark, texts):
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.zipf_pieces(path)
    assert abs(sum(np.exp(v) for _, v in pieces) - 1) < 1e-9  # a distribution
    known = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, False))
    own = token_counts.UnigramCounter.load(path)
    plain = [t.replace("\x1c", "") for t in texts] + ["Hello world, this is a test of tokenization.", "unbelievable internationalization"]
    counted = 0
    for t in plain:
        if not t:
            continue
        score, n = plain_viterbi(pieces, t)
        count, total = own(t)
        assert count == n and abs(total - score) < 1e-6 * max(1, abs(score))
        norm = "\u2581" + t.replace(" ", "\u2581")
        if all(c in own.single for c in norm):
            assert count == len(known.encode(norm).ids)
            counted += 1
    assert counted > 20 and own(plain[-1])[0] == 6
    assert own("\x1c")[0] == 2 and own(None) == (0, 0.0)
    made = token_counts.count_tokens(odd(spark), path).collect()
    assert len(made) == len(ODD) and token_counts.count_tokens(empty(spark), path).count() == 0


def test_search_is_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)).astype("float32")
    x[5] = x[6]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [float("nan")] * 16), (None, [1.0] * 16), (2040, [])]
    made = search.top_k(frame(spark, rows, "vec_id bigint, embedding array<float>"), shard_rows=200).toPandas()
    v = np.floor(x.astype(float) * 64).astype(np.int64)
    for i in range(0, 900, 20):
        s = v @ v[i]
        best = sorted((-int(s[j]), j) for j in range(900) if j != i)[:20]
        own = made[made.query_id == i].sort_values("rank")
        assert list(zip(-own.score, own.vec_id, strict=True)) == best
    assert made.query_id.nunique() == 45 and not made.duplicated(["query_id", "rank"]).any()
    assert search.top_k(frame(spark, [], "vec_id bigint, embedding array<float>")).count() == 0


def test_search_prunes_where_vectors_have_clusters():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    x = np.floor((centres[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 64))) * 64).astype(np.int64)
    shard = search.Shard(x, np.arange(4000), np.arange(4000))
    q = x[::20]
    n, i, s = shard(q, np.arange(0, 4000, 20), np.full(len(q), search.LEAST_SCORE), 20)
    assert shard.compared < 0.6 * len(q) * len(x)
    every = q @ x.T
    for k in range(len(q)):
        best = sorted((-int(every[k, j]), j) for j in range(4000) if j != 20 * k)[:20]
        assert sorted(zip(-s[n == k], i[n == k], strict=True)) == best


def test_search_with_clusters_repeated_ids_lengths_and_huge_components(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(9, 8)) * 4
    rows = [(i // 2, (centres[i % 9] + 0.1 * rng.normal(size=8)).tolist()) for i in range(1200)] + [(20 * i, [float(i), 1.0]) for i in range(1, 5)]
    made = search.top_k(frame(spark, rows, "vec_id bigint, embedding array<double>"), k=3, shard_rows=100).toPandas()
    fine = [(i, np.floor(np.array(v) * 64).astype(np.int64)) for i, v in rows]
    want = []
    for a, (i, q) in enumerate(fine):
        if i % 20 == 0:
            best = sorted((-int(q @ x), j) for b, (j, x) in enumerate(fine) if b != a and len(x) == len(q))[:3]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted(made.itertuples(index=False, name=None)) == sorted(want)
    huge = search.top_k(frame(spark, [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0])], "vec_id bigint, embedding array<double>")).collect()
    assert [(r.vec_id, r.score > 0) for r in huge] == [(1, True), (2, False)]


def test_language(spark):
    rng = random.Random(6)
    kinds = {"aa": ("ka", "lo", "mi"), "bb": ("ße", "tü", "ra"), "cc": ("éon", "ique", "la")}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(3)) for _ in range(30)), k) for i in range(300) for k in [("aa", "bb", "cc")[i % 3]]]
    docs = frame(spark, rows, "doc_id bigint, text string, lang string")
    model = language.train(docs.filter("doc_id < 200"))
    made = language.identify(docs.filter("doc_id >= 200"), model, keep=("doc_id", "lang")).collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in made)
    strange = {r.doc_id: r.lang_pred for r in language.identify(odd(spark), model).collect()}
    assert strange[1] == strange[2] == strange[3] == "und"
    assert language.identify(empty(spark), language.train(docs.limit(0))).count() == 0


def test_more_than_sixty_four_languages(spark):
    rng = random.Random(8)
    parts = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(rng.choice(parts[k]) for _ in range(40)), k) for i in range(700) for k in [f"l{i % 70:02}"]]
    docs = frame(spark, rows + [(9999, rows[0][1], "l00")] * 300, "doc_id bigint, text string, lang string")
    model = language.train(docs)
    made = language.identify(docs.limit(700), model, keep=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in made) > 0.97 * len(made)


def test_language_is_by_popcounts(spark):
    """Against sets of n-grams, without hashing: the same verdict but for chance hits of the filter."""
    rng = random.Random(6)
    kinds = {"aa": ("ka", "lo", "mi", "to"), "bb": ("ka", "lo", "ra", "ne"), "cc": ("mi", "to", "ra", "us")}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(3)) for _ in range(12)), k) for i in range(240) for k in [("aa", "bb", "cc")[i % 3]]]
    docs = frame(spark, rows, "doc_id bigint, text string, lang string")
    made = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.train(docs)).collect()}

    def grams(t):
        t = f" {t} "
        return [t[i : i + 3] for i in range(len(t) - 2)]

    held = {}
    for lang in kinds:
        texts = {t for _, t, k in rows if k == lang}
        counts = {}
        for t in texts:
            for g in set(grams(t)):
                counts[g] = counts.get(g, 0) + 1
        held[lang] = {g for g, c in counts.items() if c >= 2}
    for i, t, _ in rows:
        shares = sorted(((sum(g in held[k] for g in grams(t)) / len(grams(t)), k) for k in kinds), key=lambda x: (-x[0], x[1]))
        if shares[0][0] - shares[1][0] > 0.01:
            assert made[i][0] == shares[0][1] and abs(made[i][1] - shares[0][0] / (shares[0][0] + shares[1][0])) < 0.01


def test_quality_prior_is_the_sqls(spark):
    import pandas as pd

    rng = random.Random(13)
    good = " ".join(f"w{i}" for i in range(60))
    hosts = [(f"h{k}", rng.random(), rng.choice((1, 2, 5, 40))) for k in range(60)]
    rows = [(100 * k + i, good if rng.random() > p else "short", h) for k, (h, p, n) in enumerate(hosts) for i in range(n)]
    made = {r.doc_id: r.kept for r in quality.judge(frame(spark, rows, "doc_id bigint, text string, source string")).collect()}
    sql = by_sql("op4_quality", documents=pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    assert made == dict(zip(sql.doc_id, sql.kept, strict=True)) and 0 < sum(made.values()) < sum(t == good for _, t, _ in rows)
    kept = quality.keep_good(odd(spark, [(i, t) for i, t, _ in rows]).drop("source").join(frame(spark, [(i, h) for i, _, h in rows], "doc_id bigint, source string"), "doc_id"))
    assert {r.doc_id for r in kept.collect()} == {i for i, k in made.items() if k} and "a.b" in kept.columns


SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_line_dedup": ["doc_id", "lines_removed", "chars_kept", "text_md5"], "op2_simhash": ["doc_id", "fingerprint", "component_id"], "op3_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_urls": ["page_id", "host", "path", "rule", "verdict"], "op7_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "op8_token_counts": ["doc_id", "n_tokens", "score"],
    "op9_top_k": ["query_id", "rank", "vec_id", "score"], "op10_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op11_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"], "op12_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op13_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_return_the_agreed_columns_for_every_row(spark, name):
    made = queries.QUERIES[name](spark, SMALL)
    assert made.columns == COLUMNS[name]
    ids = [r[0] for r in made.select(made.columns[0]).collect()]
    source = {"op6_urls": "pages", "op9_top_k": "embeddings", "op11_vector_codes": "embeddings"}.get(name, "documents")
    every = [r[0] for r in spark.read.parquet(f"{SMALL}/{source}.parquet").select({"pages": "page_id", "embeddings": "vec_id"}.get(source, "doc_id")).collect()]
    if name == "op9_top_k":
        assert set(ids) == {i for i in every if i % 20 == 0} and len(ids) == 20 * len(set(ids))
    elif name == "op7_packing":
        assert set(ids) == set(every)
    else:
        assert sorted(ids) == sorted(every)
    if "held_out" in made.columns:
        n, k = (3, 1) if name == "op5_toxicity" else (4, 2)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == k) for r in made.collect())


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_queries_are_their_sql(spark, name):
    made = queries.QUERIES[name](spark, SMALL).toPandas()
    tables = {t: spark.read.parquet(f"{SMALL}/{t}.parquet").toPandas() for t in ("documents", "pages", "embeddings")}
    sql = by_sql(name, **tables)[list(made.columns)]
    order = list(made.columns[:2])
    same = made.sort_values(order).astype(str).reset_index(drop=True) == sql.sort_values(order).astype(str).reset_index(drop=True)
    assert (same | made.sort_values(order).isna().reset_index(drop=True)).all().all()


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline as c
    from tessera.llm.common import cut

    good = " ".join(f"w{i}" for i in range(70))
    rows = [*ODD, (10, good), (11, good), (12, good + " more")]
    docs = cut(odd(spark, rows).withColumn("n_chars", F.length("text").cast("long")), "docs")
    columns = docs.columns
    for name, stage in c.STAGES:
        docs = cut(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert name == "packing" or docs.columns == columns
        if name != "packing":
            assert all(r.row_ == 2 and r.score == 4 and r.lines_removed == 6 and r["a.b"] == 7 for r in docs.collect())
    kept = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert 10 in kept and 2 not in kept


def test_pipeline_finds_pairs_at_four_fifths(spark, monkeypatch):
    import corpus_pipeline as c
    from tessera.llm import minhash

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    rng = random.Random(8)
    texts = []
    for k in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(words))
        for at in rng.sample(range(5, 195), 2 + k % 4):
            words[at] = f"new{at}"
        texts.append(" ".join(words))
    words = [f"g{i}" for i in range(200)]
    for _ in range(60):  # one group with many different pairs on both sides of the bound
        made = list(words)
        for at in rng.sample(range(200), 2):
            made[at] = f"u{rng.randrange(10**6)}"
        texts.append(" ".join(made))
    sets = [shingles(t) for t in texts]
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and top[i] != top[j]:
                x, y = sorted((top[i], top[j]))
                top = [x if z == y else z for z in top]
    assert 1 < len(set(top)) < len(texts)
    docs = frame(spark, list(enumerate(texts)))
    assert {r.doc_id for r in c.drop_near_duplicates(spark, docs, "").collect()} == set(top)
    monkeypatch.setattr(minhash, "PART", 20)  # several parts in a bucket
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == dict(enumerate(top))
    assert minhash.near_duplicates(empty(spark)).count() == 0
