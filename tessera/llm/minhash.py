"""Near duplicates at a similarity of shingle sets: min-hash bands name candidates, exact Jaccard confirms them.

Texts with the same set of shingles are one node. A band is a hash of 5 of 125 minima; nodes that share one of the 25
bands stand in a bucket, which two sets at similarity s do with 1 - (1 - s^5)^25: 0.99995 at 0.8. Candidates are pairs of
a bucket that an estimate does not rule out, and every candidate is confirmed by the shingles of the two texts, unless
links already found join the two.

Buckets of up to SMALL nodes estimate by the 125 minima, of which a byte each is kept: a pair at 0.8 has ESTIMATE of them
equal but for 1e-5. Nodes of larger buckets get a finer sketch, one bit of each of FINE more minima. Bits of two sets at
similarity s agree with (1 + s) / 2, so the share of a pair at 0.8 lies 4.2 standard deviations above FINE_ESTIMATE.

So that a large group of copies is not confirmed pair by pair, rounds go before: each node is tested with the closest in
its part of a bucket, then all pairs that are still in different components. Only a bucket that keeps more than one
component is compared as a whole, as pairs of its parts; a part is compared inside its task and only the pairs that the
finer sketch leaves come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, forget
from tessera.llm.graph import connected_components
from tessera.llm.simhash import SEED

BANDS, ROWS = 25, 5
#: Least share of equal bytes of a signature for which a pair is confirmed by its texts.
ESTIMATE = 0.65
#: Bits of the finer sketch, and the least share of equal ones: 0.9 less 4.2 times sqrt(0.9 * 0.1 / FINE).
FINE, FINE_ESTIMATE = 2048, 0.8721
#: Buckets up to SMALL give all their pairs at once; larger ones are dealt in parts of about PART rows.
SMALL, PART = 16, 1024
#: Ranks of partners in the rounds before the last.
CLOSEST = ((0, 8), (8, 64))

_ANY = np.random.default_rng(SEED)
_XOR, _ODD = (_ANY.integers(0, 1 << 63, (BANDS * ROWS + FINE, 1), "<u8") * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of all words where they are fewer. No words: none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.array([], "<u8")
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1))], "<u8"))


def minima(hashes: np.ndarray, first: int = 0, last: int = BANDS * ROWS) -> np.ndarray:
    """The least value of each of the permutations from ``first`` to ``last``."""
    least = np.full(last - first, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[at : at + 1024] ^ _XOR[first:last]) * _ODD[first:last]).min(axis=1), out=least)
    return least


def fine_sketch(hashes: np.ndarray) -> bytes:
    """A bit of each of FINE further minima. The top bit of a minimum is nearly always 0, so one from the middle is taken."""
    low = np.concatenate([minima(hashes, at, at + 256) for at in range(BANDS * ROWS, BANDS * ROWS + FINE, 256)])
    return np.packbits((low >> np.uint64(20) & np.uint64(1)).astype("u1")).tobytes()


def sketches(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """doc_id, d1 and d2 (128 bits of the set), n (shingles), bands and sig (a byte of each minimum)."""
    df = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2, n, bands, sig = [], [], [], [], []
            for x in batch.column(1):
                h = shingles(x.as_py(), size)
                low = minima(h)
                d = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), "<i8")
                d1.append(d[0])
                d2.append(d[1])
                n.append(len(h))
                bands.append(np.array([xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], "<u8").view("<i8"))
                sig.append(low.astype("u1").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d1, "int64"), pa.array(d2, "int64"), pa.array(n, "int32"), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, "binary")], names=["doc_id", "d1", "d2", "n", "bands", "sig"])

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, d1 bigint, d2 bigint, n int, bands array<bigint>, sig binary")


def _small_pairs(task: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the candidates inside each run of equal ``task``, of at most SMALL rows."""
    need = int(np.ceil(ESTIMATE * sig.shape[1]))
    rows, found_a, found_b = np.arange(len(task)), [np.array([], int)], [np.array([], int)]
    for d in range(1, SMALL):
        rows = rows[rows + d < len(task)]
        rows = rows[task[rows] == task[rows + d]]
        for at in range(0, len(rows), 65536):
            a = rows[at : at + 65536]
            a = a[(sig[a] == sig[a + d]).sum(axis=1) >= need]
            found_a.append(a)
            found_b.append(a + d)
    return np.concatenate(found_a), np.concatenate(found_b)


def _large_pairs(task: np.ndarray, root: np.ndarray, sig: np.ndarray, low: int, high: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The same for larger runs and the finer sketch: candidates with different roots, of which one is among the other's
    ``low`` to ``high`` closest in the run."""
    need = int(np.ceil(FINE_ESTIMATE * FINE))
    words = np.ascontiguousarray(sig).view("<u8")
    starts = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
    found_a, found_b = [np.array([], int)], [np.array([], int)]
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(task)], strict=True):
        own, n = words[s:e], e - s
        same = np.stack([FINE - np.bitwise_count(own ^ x).sum(axis=1, dtype="i4") for x in own])
        ok = np.triu(same >= need, 1) & (root[s:e, None] != root[None, s:e])
        if high is not None and ok.any():
            np.fill_diagonal(same, FINE + 1)  # itself has rank -1
            rank = np.empty((n, n), "i4")
            np.put_along_axis(rank, np.argsort(-same, axis=1, kind="stable"), np.arange(-1, n - 1, dtype="i4")[None, :], axis=1)
            rank = np.minimum(rank, rank.T)
            ok &= (rank >= low) & (rank < high)
        a, b = np.nonzero(ok)
        found_a.append(a + s)
        found_b.append(b + s)
    return np.concatenate(found_a), np.concatenate(found_b)


def _by_task(dealt: DataFrame, width: int, pairs_of) -> DataFrame:
    """Distinct pairs (a, b), a < b, of what ``pairs_of`` finds. ``dealt``: task, node, root, sig (``width`` bytes)."""

    def made(task, node, root, sig) -> pa.RecordBatch:
        a, b = pairs_of(task, root, sig)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            new.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), "u1").reshape(-1, width))
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            whole = int(np.searchsorted(rows[0], rows[0][-1]))  # rows before the last task's
            if whole:
                yield made(*(x[:whole] for x in rows))
            held = [x[whole:] for x in rows]
        if held is not None:
            yield made(*held)

    sorted_ = dealt.select("task", "node", "root", "sig").repartition("task").sortWithinPartitions("task", "node")
    return sorted_.mapInArrow(run, "a bigint, b bigint").filter("a < b").distinct()


def small_candidates(buckets: DataFrame) -> DataFrame:
    """``buckets``: key, node, sig, of buckets of at most SMALL nodes."""
    return _by_task(buckets.select(F.col("key").alias("task"), "node", F.lit(0).cast("long").alias("root"), "sig"), BANDS * ROWS, lambda task, root, sig: _small_pairs(task, sig))


def large_candidates(buckets: DataFrame, low: int, high: int | None) -> DataFrame:
    """``buckets``: key, node, root, sig (the finer sketch), c (members). Without ``high``, all pairs of parts."""
    parts = F.ceil(F.col("c") / PART).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.least(o, own) * parts + F.greatest(o, own))) if high is None else own
    dealt = buckets.select("key", "node", "root", "sig", pair.alias("pair")).withColumn("task", F.xxhash64("key", "pair"))
    return _by_task(dealt, FINE // 8, lambda task, root, sig: _large_pairs(task, root, sig, low, high))


def confirm(pairs: DataFrame, texts: DataFrame, size: int, similar: tuple[int, int]) -> DataFrame:
    """Of ``pairs`` those whose shingle sets have a Jaccard similarity of ``similar``, a fraction, at least."""
    top, base = similar
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept, at, x = [], None, None
            for i in range(batch.num_rows):
                if b[i] != at:
                    at, x = b[i], shingles(batch.column(3)[i].as_py(), size)
                y = shingles(batch.column(2)[i].as_py(), size)
                common = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(base * common >= top * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, "i8")[np.array(kept, bool)]), pa.array(np.array(b, "i8")[np.array(kept, bool)])], names=["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def fine_sketches(texts: DataFrame, size: int) -> DataFrame:
    """node and sig, the finer sketch. ``texts``: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fine_sketch(shingles(x.as_py(), size)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "sig"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, sig binary")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similar: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id and component_id: the least doc_id that links of at least ``similar`` reach.

    ``doc_id`` is unique and not null. Texts without words, null ones too, are copies of each other; shorter texts than
    a shingle count as one shingle. Empty table: no rows. Other columns are not read.
    """
    marked = cut(sketches(docs, doc_id, text, shingle), "sketches")
    one = marked.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = cut(one.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.filter("n > 0").select("node", F.explode("bands").alias("key"))
    shared = cut(members.join(members.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "key").select("key", "node", "c"), "buckets")
    small, large = shared.filter(F.col("c") <= SMALL), shared.filter(F.col("c") > SMALL)
    ends = shared.groupBy("node").agg(F.max("c").alias("most")).join(nodes.select("node", "least"), "node")
    texts = cut(ends.join(docs.select(F.col(f"`{doc_id}`").alias("least"), F.col(f"`{text}`").alias("text")), "least").select("node", "text", "most"), "candidate_texts")
    fine = cut(fine_sketches(texts.filter(F.col("most") > SMALL), shingle), "fine_sketches")
    large = cut(large.join(fine, "node").select("key", "node", "c", "sig"), "large_buckets")

    pairs = cut(small_candidates(small.join(nodes.select("node", "sig"), "node")), "pairs")
    seen, links = pairs, cut(confirm(pairs, texts, shingle, similar), "confirmed")
    roots, tables = connected_components(links).select("node", "root"), [shared, texts, fine, large, pairs, links]
    for low, high in (*CLOSEST, (0, None)):
        named = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        keys = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
        pairs = cut(large_candidates(named.join(keys, "key", "left_semi"), low, high).join(seen, ["a", "b"], "left_anti"), "pairs")
        found = cut(confirm(pairs, texts, shingle, similar), "confirmed")
        tables += [pairs, found]
        seen, links = seen.unionByName(pairs), links.unionByName(found)
        roots = connected_components(links).select("node", "root")
    for done in tables:  # the components stand by themselves
        forget(done)
    reach = nodes.select("d1", "d2", "least", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = reach.join(reach.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("d1", "d2", "component_id")
    return marked.select("doc_id", "d1", "d2").join(named, ["d1", "d2"]).select("doc_id", "component_id")
