import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment, jaccard, vector_codes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASHING = {"node": 1, "i": 2, "n": 3, "t": 4, "d1": 5, "key": 6, "code": 7, "error": 8, "a.b": 9, "at": 10, "block": 11, "groups": 12}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).select("*", *[F.lit(v).alias(k) for k, v in CLASHING.items()])


# ---- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """Lloyd over all parts again in every round, in plain Python."""
    good = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    if not good:
        return [], []
    size = len(good[0][1])
    good = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in good if len(v) == size]
    cuts = [p * size // parts for p in range(parts + 1)]
    books = [[v[a:b] for _, v in good[:entries]] for a, b in zip(cuts, cuts[1:])]
    for k in range(rounds + 1):
        coded = []
        for i, v in good:
            code, error = [], 0
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                d = [sum((x - y) ** 2 for x, y in zip(v[a:b], e)) for e in books[p]]
                code.append(d.index(min(d)))
                error += min(d)
            coded.append((i, code, error))
        if k < rounds:
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                for e in range(len(books[p])):
                    if mine := [v[a:b] for (_, v), (_, c, _) in zip(good, coded) if c[p] == e]:
                        books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((i is None, i or 0, bytes(c).hex(), min(e, 2**63 - 1)) for i, c, e in coded), books


def vectors(n=300, size=32, seed=3):
    rng = np.random.default_rng(seed)
    made = [(int(k), [float(x) for x in rng.normal(size=size) * (0.01 if k % 7 else 3)], int(k % 3) if k % 5 else None) for k in rng.permutation(n)]
    return [*made, made[0], (None, [0.5] * size, 1), (9001, None, 1), (9002, [], None), (9003, [float("nan")] * size, 1), (9004, [None] * size, 2), (9005, [float("inf")] * size, 1), (9006, [1.0] * (size + 1), 1)]


@pytest.mark.parametrize("huge", [False, True])
def test_codes_are_plain_lloyd(spark, huge):
    rows = vectors(90 if huge else 300)
    if huge:  # beyond what float64 holds exactly
        rows = [(i, v if v is None or i is None or i % 4 or i > 9000 else [(x or 0) * 1e12 for x in v], g) for i, v, g in rows]
    made, books = vector_codes.compress(frame(spark, rows, "vec_id bigint, embedding array<double>, label int"), keep=("label",))
    want, plain = plain_codes([(i, v) for i, v, _ in rows])
    assert sorted((r.vec_id is None, r.vec_id or 0, bytes(r.code).hex(), r.error) for r in made.collect()) == want
    assert [e.tolist() for e in books.entries] == plain
    assert books.sha256() == hashlib.sha256(",".join(str(x) for p in plain for e in p for x in e).encode()).hexdigest()
    by = defaultdict(int)
    for r in made.collect():
        by[r.label] += r.error
    assert all(r.label_error == min(by[r.label], 2**63 - 1) for r in vector_codes.summed(made, "label", "error", "label_error").collect())
    one = vector_codes.decode(made.select("vec_id", "code"), books).first()
    assert one.decoded == [int(x) for p, e in enumerate(one.code) for x in books.entries[p][e]]


def test_only_parts_that_moved_are_sent(spark):
    rows = vectors(200)[:200]
    df = frame(spark, rows, "vec_id bigint, embedding array<double>, label int").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"))
    start = np.floor(np.array([v for _, v, _ in sorted(rows)][:64]) * 256).astype("i8")
    books = vector_codes.Codebooks(tuple(range(0, 33, 2)), [start[:, k : k + 2] for k in range(0, 32, 2)])
    first = vector_codes.assign(df, books, 256)
    counts = vector_codes.changes(first, books, 256).filter("at = -1")
    assert counts.agg(F.sum("total")).first()[0] == 200 * 16
    again = vector_codes.assign(first.drop("was", "error"), books, 256)
    assert vector_codes.changes(again, books, 256).count() == 0


def test_codes_of_few_or_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    made, books = vector_codes.compress(frame(spark, [], schema))
    assert made.count() == 0 and books.sha256() == hashlib.sha256(b"").hexdigest()
    made, books = vector_codes.compress(frame(spark, [(2, [1.0, -0.001], None), (1, [0.0, 0.0], None)], schema))
    assert [len(e) for e in books.entries] == [2] * 16 and {r.vec_id: r.error for r in made.collect()} == {1: 0, 2: 0}


# ---- Jaccard join


def plain_sets(texts, size=5):
    out = []
    for t in texts:
        low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def plain_components(ids, sets):
    top = list(range(len(ids)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    least = {}
    for k in range(len(ids)):
        r = find(k)
        least[r] = min(least.get(r, (True, 0)), (ids[k] is None, ids[k] or 0))
    return [None if least[find(k)][0] else least[find(k)][1] for k in range(len(ids))]


def corpus(seed=4):
    """Copies, near copies around the threshold, chains, a template that many pages share, and a passage in many texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 4000)}"
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 6, 8, 9, 14, 30, 80, 300]))]
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
            base = t if rng.random() < 0.4 else base
    template, passage = [word() for _ in range(90)], [word() for _ in range(50)]
    texts += [" ".join(template + [word() for _ in range(30)]) for _ in range(40)]
    texts += [" ".join(template + [word() for _ in range(12)]) for _ in range(40)]
    texts += [" ".join([word() for _ in range(60)] + passage) for _ in range(40)]
    base = [word() for _ in range(200)]
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(1, 6)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [texts[3], texts[3].upper() + "\n", "", None, " \t", "one", "ONE", "one two", "x " * 3000]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("small", [16, 3])
def test_links_are_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "PART", 16 if small == 3 else 512)
    texts = corpus(small)
    ids = [None if k == 0 else 5 if k in (9, 11) else k for k in range(len(texts))]
    sets = plain_sets(texts)
    made = jaccard.near_duplicates(frame(spark, list(zip(ids, texts)), "doc_id bigint, text string")).collect()
    want = Counter(zip([i if i is not None else -1 for i in ids], map(len, sets), [c if c is not None else -1 for c in plain_components(ids, sets)]))
    assert Counter((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in made) == want
    assert len({r.component_id for r in made}) > 150


def test_shingle_sets_are_those_of_each_text(monkeypatch):
    import pyarrow as pa

    texts = [*corpus()[:120], "a\x00 a", "a", "é É", "x" * 5000, None]
    flat, bounds = jaccard.shingle_sets(pa.array(texts).slice(3), 5)
    sets = plain_sets(texts[3:])
    assert np.diff(bounds).tolist() == [len(x) for x in sets]
    own = [set(flat[x:y].tolist()) for x, y in zip(bounds, bounds[1:])]
    names = {}
    for x, y in zip(sets, own):
        for z in x:
            names.setdefault(z, set(y)).intersection_update(y)
    assert all(names.values())  # equal shingles have equal hashes wherever they stand
    assert all(len(own[i] & own[j]) == len(sets[i] & sets[j]) for i in range(len(sets)) for j in range(i))
    monkeypatch.setattr(jaccard, "PIECE", 300)
    pieces = list(jaccard.in_pieces(pa.array(texts)))
    assert sum(len(x) for _, x in pieces) == len(texts) and [a for a, _ in pieces] == np.cumsum([0, *[len(x) for _, x in pieces]])[:-1].tolist()


def test_every_difference_within_the_bound_leaves_a_common_band():
    rng = np.random.default_rng(1)
    sizes = jaccard.Sizes(4, 5)
    for n in (4, 5, 7, 10, 33, 120, 700):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype="u8"))
            more = int(rng.integers(0, sizes.largest(n) - n + 1))
            d = sizes.most(n, n + more)
            swap = max(0, (d - more) // 2)
            b = np.unique(np.r_[a[swap:], rng.integers(0, 1 << 63, swap + more, dtype="u8")])
            assert len(np.setxor1d(a, b)) <= sizes.most(len(a), len(b))
            common = sorted(set(sizes.groups(len(a))) & set(sizes.groups(len(b))))
            assert sizes.of(min(len(a), len(b))) in common
            g = sizes.of(min(len(a), len(b)))
            keys = [set(jaccard.band_keys(x, np.array([0, len(x)]), np.array([g]), np.array([sizes.differ(g) + 1]), 0, True)[1].tolist()) for x in (a, b)]
            assert not d or keys[0] & keys[1]
            x, y = jaccard.narrow_sketch(a), jaccard.narrow_sketch(b)
            least = min(len(x), len(y))
            assert np.bitwise_count(jaccard.folded(x, least) ^ jaccard.folded(y, least)).sum() <= len(np.setxor1d(a, b))


def test_pages_of_a_template_meet_few_others(spark, monkeypatch):
    """Pages of one template at a similarity of 0.6 are told apart by their own shingles: a page is tested with some
    others of its small buckets, however many pages there are."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    met = []
    plain = jaccard.allowed
    monkeypatch.setattr(jaccard, "allowed", lambda pairs, *a: (met.append(pairs.count()), plain(pairs, *a))[1])
    rng = random.Random(3)
    template = [f"t{k}" for k in range(150)]
    rows = [(k, " ".join(template + [f"w{rng.randint(0, 10**6)}" for _ in range(50)])) for k in range(600)]
    made = jaccard.near_duplicates(frame(spark, rows, "doc_id bigint, text string")).collect()
    assert all(r.component_id == r.doc_id for r in made)
    assert sum(met) < 0.25 * 600 * 599 / 2


def test_join_of_nothing(spark):
    assert jaccard.near_duplicates(frame(spark, [], "doc_id bigint, text string")).count() == 0
    rows = [(3, None), (2, ""), (1, " ")]
    alike = jaccard.near_duplicates(frame(spark, rows, "doc_id bigint, text string"), empty_alike=True).collect()
    assert {r.component_id for r in alike} == {1}


# ---- alignment


def plain_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    own = {}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for b in range(256):
        own[chr(b) if b in printable else chr(256 + sum(1 for x in range(b) if x not in printable))] = b
    rows, held = [], Counter()
    for t in texts:
        a = ta.encode(" " + t, add_special_tokens=False).ids if t else []
        b = tb.encode(t) if t else []
        xa = [bytes(own[c] for c in ta.id_to_token(i)) for i in a]
        xb = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + t).encode() if t else b""
        if b"".join(xa) != raw or b"".join(xb) != raw:
            a, b, xa, xb = [], [], [], []
        ea, eb = np.cumsum([len(x) for x in xa]).tolist(), np.cumsum([len(x) for x in xb]).tolist()
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(ea[i] - len(xa[i]), eb[j] - len(xb[j])) < min(ea[i], eb[j])]
        cuts, shown, la, lb = sorted(set(ea) & set(eb)), [], 0, 0
        for c in cuts:
            ka, kb = ea.index(c) + 1, eb.index(c) + 1
            shown.append(",".join(map(str, a[la:ka])) + "|" + ",".join(map(str, b[lb:kb])))
            la, lb = ka, kb
        rows.append((len(a), len(b), len(cuts), links, ";".join(shown)))
        held.update(set(links))
    most = {}
    for (x, _), c in held.items():
        most[x] = max(most.get(x, 0), c)
    out = []
    for na, nb, ng, links, shown in rows:
        out.append((na, nb, ng, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if na else ""))
    return out, [r[4] for r in rows]


@pytest.mark.parametrize("block", [1 << 21, 50])
def test_alignment_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rng = random.Random(8)
    parts = ["word", " ", "  ", "\n", "'ll", "é", "漢字", "12", "…", "!", "\t", "naïve", "😀", "_", "tion", "Ab", "\x1c", "　", "<|endoftext|>", "<s>", "<0x41>", "▁" if block == 50 else "▂", "\xa0", "the", " the ", "\r\n", "unbelievably"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", " ", "  ", " a", "a ", "a\x00b", "ﬁ Å", "字" * 1500, "the the the", "the the the"]
    ids = [None if k == 3 else 7 if k in (8, 9) else k for k in range(len(texts))]
    want, shown = plain_alignment(texts)
    df = frame(spark, list(zip(ids, texts)), "doc_id bigint, text string").repartition(3)
    made = alignment.align(df, A, B).collect()
    assert Counter((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in made) == Counter((-1 if i is None else i, *w) for i, w in zip(ids, want))
    whole = Counter(";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in r.groups) for r in alignment.groups(df, A, B).collect())
    assert whole == Counter(shown)
    assert alignment.align(df.filter("false"), A, B).count() == 0 and alignment.groups(df.filter("false"), A, B).count() == 0


def test_bitsets_of_several_words():
    rng = random.Random(2)
    cuts = [sorted({0, 300, *rng.sample(range(1, 300), 90)}) for _ in range(2)]
    spans = [list(zip(c, c[1:])) for c in cuts]
    link, a, b, cut, ga, gb = (x.tolist() for x in alignment.aligned(*(np.diff(c) for c in cuts)))
    want = [(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if max(x[0], y[0]) < min(x[1], y[1])]
    assert list(zip(a, b)) == want and link == sorted({e - 1 for c in cuts for e in c[1:]})
    assert [c + 1 for c in cut] == sorted(set(cuts[0]) & set(cuts[1]) - {0}) == [cuts[0][i] for i in ga] == [cuts[1][j] for j in gb]
    assert all(x.tolist() == [] for x in alignment.aligned(np.array([], int), np.array([], int)))


def test_known_chunks_are_forgotten(monkeypatch):
    aligner = alignment.Aligner(A, B)
    first = aligner(["one two three", None, "four"])
    monkeypatch.setattr(alignment, "MEMO_ENTRIES", 2)
    again = aligner(["one two three", None, "four"])
    assert len(aligner.known) == 4 and all(np.array_equal(x, y) for x, y in zip(first, again))
