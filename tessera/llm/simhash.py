"""SimHash near duplicates by a hierarchical index over fingerprints in Gray order.

The top nodes of the index factor out a masked bit pattern that all their members share: the first few bits of one of
r + 1 equal slices. Fingerprints that differ in at most r bits agree on a whole slice, so they meet in a top node. The
number of those bits follows from the number of fingerprints, so that a top node holds about NODE_MEMBERS.

Below a top node the members stand in the order of their Gray rank, so neighbours share long patterns. Leaves of LEAF
members, and nodes of FANOUT nodes, keep the mask of the bits on which all below agree. All links are found by one
descent: two nodes are compared under their common mask, where the differences only grow on the way down, and a pair of
nodes that differs in more than r bits is pruned with every pair of members below it.

A top node with more than ``node_rows`` members is dealt to several tasks as pairs of its parts. A task turns the links
it finds into a forest, so it returns fewer links than it holds members, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.graph import connected_components

#: XXH64's seed for shingles.
SEED = 42
#: Members of a leaf, nodes of a node, and members of a top node on average.
LEAF, FANOUT, NODE_MEMBERS = 8, 4, 4096


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits; bit k is set where over half of the shingle hashes have it. No words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if shingle == 3:
        made = [digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]
    else:
        made = [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(len(words) - shingle + 1)]
    if not made:
        made = [digest(b" ".join(words), SEED)]
    h = np.array(made, "<u8")
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        set_in += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """``keep`` columns and ``fp`` (long, the 64 bits). Null, empty and wordless texts: 0. Rows are independent."""
    named = [f"k{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, named, strict=True)], F.col(f"`{text}`").alias("t"))
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(batch.num_columns - 1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=[*named, "fp"])

    made = df.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in named), "fp bigint"]))
    return made.select(*[F.col(k).alias(c) for c, k in zip(keep, named, strict=True)], "fp")


class Forest:
    """Union-find over 0..n-1 that takes links by the array."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.root[a], self.root[b]
        apart = ra != rb
        if not apart.any():
            return
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for x, y in np.unique(np.stack([ra[apart], rb[apart]], 1), axis=0).tolist():
            if (x := top(x)) != (y := top(y)):
                up[max(x, y)] = min(x, y)
        old = np.array(list(up))
        self.root[old] = [top(x) for x in up]
        self.root = self.root[self.root]


def _apart(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    return np.bitwise_count((a ^ b) if mask is None else (a ^ b) & mask)


def _levels(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, pattern) of the nodes of every level, leaves first. Members stand in Gray order."""
    at = np.arange(0, len(fp), LEAF)
    ones, some = np.bitwise_and.reduceat(fp, at), np.bitwise_or.reduceat(fp, at)
    out = [(~(ones ^ some), ones)]
    while len(out[-1][0]) > FANOUT:
        at = np.arange(0, len(ones), FANOUT)
        ones, some = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(some, at)
        out.append((~(ones ^ some), ones))
    return out


def search(fp: np.ndarray, radius: int, links: Forest, first: int = 0, step: int = 4096) -> int:
    """Add to ``links`` all links among the members of one top node, whose numbers begin at ``first``. Returns the number
    of pairs of members that were compared; the others were pruned with their nodes."""
    levels = _levels(fp)
    i, j = np.triu_indices(len(levels[-1][0]))
    stack, compared = [(len(levels) - 1, i, j)], 0
    while stack:
        level, i, j = stack.pop()
        if len(i) > step:
            half = len(i) // 2
            stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        mask, pattern = levels[level]
        near = _apart(pattern[i], pattern[j], mask[i] & mask[j]) <= radius
        i, j = i[near], j[near]
        if not len(i):
            continue
        width, below = (FANOUT, len(levels[level - 1][0])) if level else (LEAF, len(fp))
        a = (i[:, None] * width + np.arange(width)).repeat(width, axis=1).ravel()
        b = np.tile(j[:, None] * width + np.arange(width), width).ravel()
        if level:
            ok = (a <= b) & (b < below)
            if ok.any():
                stack.append((level - 1, a[ok], b[ok]))
            continue
        ok = (a < b) & (b < below)
        a, b = a[ok], b[ok]
        compared += len(a)
        near = _apart(fp[a], fp[b]) <= radius
        links.add(a[near] + first, b[near] + first)
    return compared


def forest_links(node: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within ``radius`` inside each run of equal ``node``; rows in Gray order."""
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    links = Forest(len(fp))
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
        if e - s > 1:
            search(fp[s:e], radius, links, s)
    child = np.flatnonzero(links.root != np.arange(len(fp)))
    return fp[child], fp[links.root[child]]


def gray_rank(fp):
    """Position of a bit pattern in the reflected Gray sequence, as a column."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def link_fingerprints(fps: DataFrame, radius: int = 3, node_rows: int = 1 << 16) -> DataFrame:
    """``fps``: distinct ``fp``. Links (a, b) whose components are those of all pairs within ``radius`` bits."""
    slices = radius + 1
    edges = [64 * i // slices for i in range(slices + 1)]
    shared = max(0, int(np.log2(max(1, fps.count() / NODE_MEMBERS))))  # bits of a top node's pattern
    masks = [((1 << min(edges[i] + shared, edges[i + 1])) - (1 << edges[i])) for i in range(slices)] if shared else [0]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    members = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col("fp").bitwiseAND(F.lit(m)).alias("p")) for i, m in enumerate(masks)])).alias("n")).select("fp", "n.s", "n.p")
    large = members.groupBy("s", "p").count().filter(F.col("count") > node_rows).select("s", "p", F.ceil(F.col("count") / node_rows).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, own) * F.col("parts") + F.greatest(o, own)))
    dealt = members.join(large, ["s", "p"], "left").select("fp", F.explode(pairs).alias("pair"), "s", "p", gray_rank(F.col("fp")).alias("g"))
    # a number for each node and pair of parts; nodes that shared one by chance would only be compared in vain
    dealt = dealt.select("fp", "g", F.xxhash64("s", "p", "pair").alias("node")).repartition("node").sortWithinPartitions("node", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_n, held_f = np.array([], "<i8"), np.array([], "<u8")
        for batch in batches:
            n, f = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view("<u8")
            n, f = np.r_[held_n, n], np.r_[held_f, f]
            whole = len(n) - np.searchsorted(n[::-1] != n[-1], True) if len(n) else 0  # rows before the last node's
            a, b = forest_links(n[:whole], f[:whole], radius) if whole else (f[:0], f[:0])
            held_n, held_f = n[whole:], f[whole:]
            yield pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], names=["a", "b"])
        if len(held_n):
            a, b = forest_links(held_n, held_f, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], names=["a", "b"])

    return dealt.select("node", "fp").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp and component_id: the least doc_id that links of at most ``radius`` bits reach.

    Copies share a fingerprint and are one member of the index, however many they are. Texts without words have
    fingerprint zero and are linked like others. Null ids keep their row; a component of null ids only has null.
    Empty table: no rows. Other columns are not read.
    """
    marked = cut(fingerprints(docs, text, (doc_id,), shingle).select(F.col(f"`{doc_id}`").alias("doc_id"), "fp"), "fingerprints")
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = connected_components(link_fingerprints(fps.select("fp"), radius))
    member = joined.join(fps, joined["node"] == fps["fp"]).select("fp", "root", "least")
    reach = member.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = member.join(reach, "root").select("fp", "component_id")
    named = fps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
