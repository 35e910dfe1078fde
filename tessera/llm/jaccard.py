"""Jaccard join of shingle sets by parity sketches: exact, without an index of single shingles.

Sets A and B are linked at a similarity of x/y or more, that is if they differ in at most
D = (y - x) / (y + x) * (|A| + |B|) shingles. Two sketches come from the shingles' hashes:

* A wide one, of which a shingle toggles one of 2^64 bits in one of the bands. A band of it is not written out; its key
  is the XOR of the hashes in it. A shingle that only one set has changes one band, so sets within D agree on all but D
  of the bands (pigeonhole), and sets that agree on a band stand in its bucket.
* A narrow one, of 2^k bits, in which equal bits cancel: the number of bits in which two sketches differ is at most
  the number of shingles in which the sets differ, so a pair whose sketches differ more than D is ruled out. What is
  left is verified with the texts.

Sizes are cut into classes so that a set's partners stand in its own class and its neighbours; for each class the sets
of it and of the next use the same number of bands.

Buckets that hold very many sets need not be compared. A band counts as useful to a set if it holds something and its
bucket was settled: at most SMALL sets, or all known to be of one component. If the larger set of a pair has more than D
useful bands, one of them agrees with the other set's, and the pair was met there. Only sets with fewer go on to a level
with finer bands, where rare shingles stand alone; what is left even then is compared bucket by bucket, in parts.

Texts with the same set are one node. Since only components are asked for, stars come first: the sets of a bucket are
tested with the first and the last of them, and only sets of different components after that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, forget
from tessera.llm.graph import connected_components

#: Bands for each shingle of the allowed difference, plus two, for each level.
LEVELS = (1.25, 8.0)
#: Buckets of up to SMALL sets are compared whole in one task; larger ones, at the end, in parts of about PART sets.
SMALL, PART = 16, 512
#: Bytes of text whose shingles are hashed at a time, and band keys that travel together.
PIECE, CHUNK = 1 << 20, 1 << 20
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: A-Z to a-z, one added so that no byte is nought, and the white space that separates words.
_LOWER = np.array([(b + 32 if 0x41 <= b <= 0x5A else b) + 1 for b in range(256)], "<u8")
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _rolled(words: np.ndarray, run: int) -> np.ndarray:
    """A hash of every ``run`` words in a row."""
    out = np.full(max(0, len(words) - run + 1), run, "<u8")
    for k in range(run):
        out ^= words[k : k + len(out)]
        out *= _MIX[1]
        out ^= out >> np.uint64(32)
    return out


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse modulo 2^64."""
    made = []
    for x in (int(_MIX[2]), pow(int(_MIX[2]), -1, 1 << 64)):
        p = np.full(size, x, "<u8")
        p[:1] = 1
        made.append(np.cumprod(p, dtype="<u8"))
    return made[0], made[1]


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's runs of ``size`` words (of all its words where they are fewer), one
    text after another, and where each begins. A null text has no words.

    A word's hash is the sum of its bytes times powers of an odd number by place, taken from running sums."""
    raw = texts.fill_null("").cast(pa.binary()).cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], "<i8")[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", "u1")[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends[:-1] &= ~inside[1:] | first[1:-1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    power, back = _powers(1 << max(20, int(len(data)).bit_length()))
    sums = np.cumsum(_LOWER[data] * power[: len(data)], dtype="<u8")
    words = mixed((sums[ends] - np.where(begins > 0, sums[begins - 1], np.uint64(0))) * back[begins], 0)
    at = np.searchsorted(begins, bounds)
    many = np.diff(at)
    runs = np.maximum(0, np.where(many >= size, many - size + 1, np.minimum(many, 1)))
    start = np.concatenate([[0], np.cumsum(runs)])
    out = np.empty(start[-1], "<u8")
    whole = np.flatnonzero(many >= size)
    rolled = _rolled(words, size)
    for k in whole.tolist():
        own = rolled[at[k] : at[k] + runs[k]]
        own.sort()
        out[start[k] : start[k + 1]] = own
    for run in range(1, size):
        short = np.flatnonzero(many == run)
        out[start[short]] = _rolled(words, run)[at[short]] if len(short) else 0
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[start[:-1][runs > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[start]


def in_pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """``texts`` in slices of about PIECE bytes, and where each begins."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8"))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + PIECE, side="right")))
        yield first, texts.slice(first, last - first)
        first = last


def shingles(text: str | None, size: int) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()), size)[0]


def mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Other hashes of the same, one to one."""
    with np.errstate(over="ignore"):
        x = hashes + _MIX[0] * np.uint64(seed + 1)
        x = (x ^ x >> np.uint64(30)) * _MIX[1]
        x = (x ^ x >> np.uint64(27)) * _MIX[2]
    return x ^ x >> np.uint64(31)


class Sizes:
    """Classes of set sizes for links at ``top`` / ``base``, and how many shingles a pair may differ in."""

    def __init__(self, top: int, base: int):
        self.top, self.base = top, base
        self.starts = [1]

    def most(self, a: int, b: int) -> int:
        return (self.base - self.top) * (a + b) // (self.base + self.top)

    def largest(self, a: int) -> int:
        """Size of the largest set that one of ``a`` can be linked to."""
        return a * self.base // self.top

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.largest(self.starts[-1]) + 1)
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def differ(self, group: int) -> int:
        """The most that a pair may differ in whose smaller set is in the class."""
        while len(self.starts) < group + 2:
            self.starts.append(self.largest(self.starts[-1]) + 1)
        last = self.starts[group + 1] - 1
        return self.most(last, self.largest(last))

    def bands(self, group: int, spread: float, empty: bool) -> int:
        """How many bands the class uses; none if its sets are linked to equal ones only."""
        differ = self.differ(group)
        return 0 if not differ else differ + 1 if empty else int(spread * (differ + 1)) + 2

    def limit(self, n: int, group: int) -> int:
        return self.most(n, self.largest(n)) if group == self.of(n) else self.most(self.starts[group + 1] - 1, n)

    def groups(self, n: int) -> list[int]:
        """Its own class, and the one before where a set of that may be its partner."""
        own = self.of(n)
        return [g for g in (own - 1, own) if g >= 0 and (g == own or self.largest(self.starts[own] - 1) >= n)]


def band_keys(flat: np.ndarray, bounds: np.ndarray, group: np.ndarray, bands: np.ndarray, seed: int, empty: bool) -> tuple[np.ndarray, np.ndarray]:
    """The set and the key of each band that holds a shingle, of all bands with ``empty``; of sets between ``bounds`` in
    ``flat``, of which each has its class and number of bands (0: none). A key is 48 bits and a byte for the class."""
    size = np.where(bands > 0, np.diff(bounds), 0)
    taken = np.repeat(bands > 0, np.diff(bounds))
    h, of = flat[taken], np.repeat(np.arange(len(bands)), size)
    base = np.concatenate([[0], np.cumsum(bands)])
    slot = base[of] + ((mixed(h, seed) >> np.uint64(32)) * bands[of].astype("u8") >> np.uint64(32)).astype("i8")
    word, filled = np.zeros(base[-1], "u8"), np.zeros(base[-1], bool)
    np.bitwise_xor.at(word, slot, mixed(h, seed + 1))
    filled[slot] = True
    at = np.arange(base[-1]) if empty else np.flatnonzero(filled)
    owner = np.repeat(np.arange(len(bands)), bands)[at]
    own = group[owner].astype("u8")
    named = mixed(word[at] ^ mixed((at - base[owner]).astype("u8") + (own << np.uint64(40)), 7), seed + 2)
    return owner, (named >> np.uint64(16) << np.uint64(8) | own & np.uint64(255)).view("i8")


def narrow_sketch(hashes: np.ndarray) -> bytes:
    """Parities of the shingles in each of 2^k bits, at least four times as many as shingles, 256 or more."""
    bits = 1 << max(8, int(4 * len(hashes) - 1).bit_length())
    at = (mixed(hashes, 99) & np.uint64(bits - 1)).astype("i8")
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype("u1"), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch with ``size`` bytes, as words: halves fall on each other."""
    x = np.frombuffer(sketch, "<u8")
    return np.bitwise_xor.reduce(x.reshape(-1, size // 8), axis=0)


def marks(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (i, t) with d1 and d2, 128 bits of the set, and n, its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_pieces(batch.column(1)):
                flat, bounds = shingle_sets(texts, size)
                d = np.array([np.frombuffer(xxhash.xxh3_128_digest(flat[x:y].tobytes()), "<i8") for x, y in pairwise(bounds.tolist())], "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), texts, pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(np.diff(bounds))], names=["i", "t", "d1", "d2", "n"])

    return rows.select("i", "t").mapInArrow(run, f"i {dict(rows.dtypes)['i']}, t string, d1 bigint, d2 bigint, n bigint")


def _keyed(batches: Iterator[pa.RecordBatch], size: int, sizes: Sizes, spread: float, seed: int, empty: bool = False):
    """For batches of node, t, only (the classes wanted, null for all) and each of a set's classes: nodes, their classes,
    how many bands they fill and how many they may differ in; and the node and key of each band."""
    for batch in batches:
        for first, texts in in_pieces(batch.column(1)):
            flat, bounds = shingle_sets(texts, size)
            nodes = batch.column(0).slice(first, len(texts)).to_numpy()
            only = batch.column(2).slice(first, len(texts)).to_pylist()
            groups = [sizes.groups(n) for n in np.diff(bounds).tolist()]
            for k in range(2):
                own = [g[k] if k < len(g) and (o is None or g[k] in o) else -1 for g, o in zip(groups, only, strict=True)]
                bands = np.array([sizes.bands(g, spread, empty) if g >= 0 else 0 for g in own], "i8")
                owner, keys = band_keys(flat, bounds, np.array(own, "i8"), bands, seed, empty)
                there = np.flatnonzero(bands)
                limits = np.array([sizes.limit(int(bounds[x + 1] - bounds[x]), own[x]) for x in there.tolist()], "i8")
                yield nodes[there], np.array(own, "i8")[there], np.bincount(owner, minlength=len(bands))[there], limits, nodes[owner], keys


def useful_bands(texts: DataFrame, size: int, sizes: Sizes, spread: float, seed: int) -> DataFrame:
    """node, grp, filled (bands that hold something), limit (the most that a pair of the class may differ in whose one set
    is the node's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *four, _, _ in _keyed(batches, size, sizes, spread, seed):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in four], names=["node", "grp", "filled", "limit"])

    return texts.select("node", "t", "only").mapInArrow(run, "node bigint, grp bigint, filled bigint, limit bigint")


def shared_bands(texts: DataFrame, size: int, sizes: Sizes, spread: float, seed: int, parts: int, empty: bool = False) -> DataFrame:
    """node and key of the bands that more than one set of ``texts`` has; and, with ``thin``, node and class (as the key) of
    sets that fill too few bands to be sure to share one.

    Keys travel packed, CHUNK at a time, to ``parts`` parts by key. A band that more than SMALL sets of one chunk have is
    known to be shared: its sets stay in the chunk's own row, and its part gets one entry for it, so a band that very many
    sets have brings at most SMALL entries a chunk to a part."""

    def packed(node: np.ndarray, key: np.ndarray, chunk: int) -> Iterator[tuple]:
        order = np.argsort(key, kind="stable")
        node, key = node[order], key[order]
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.repeat(np.diff(np.r_[begins, len(key)]) > SMALL, np.diff(np.r_[begins, len(key)]))
        lead = np.zeros(len(key), bool)
        lead[begins] = True
        if many.any():
            yield chunk % parts, 1, node[many].tobytes(), key[many].tobytes(), b""
        sent = ~many | lead
        node, key, many = node[sent], key[sent], many[sent]
        part = ((key.view("u8") >> np.uint64(8)) % np.uint64(parts)).astype("i8")
        order = np.lexsort((node, part))  # nodes as steps from one to the next, which are small and pack well
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        for p, (x, y) in enumerate(pairwise(bounds.tolist())):
            if x < y:
                at = order[x:y]
                yield p, 0, np.diff(node[at], prepend=0).tobytes(), key[at].tobytes(), many[at].tobytes()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "kind", "node", "key", "many"])
        held, count, chunk = [], 0, TaskContext.get().partitionId()
        for nodes, own, filled, limit, node, key in _keyed(batches, size, sizes, spread, seed, empty):
            thin = filled <= limit
            if thin.any() and not empty:
                yield as_batch([(chunk % parts, 2, nodes[thin].tobytes(), own[thin].tobytes(), b"")])
            held.append((node, key))
            count += len(key)
            if count >= CHUNK:
                yield as_batch(list(packed(*map(np.concatenate, zip(*held, strict=True)), chunk)))
                held, count, chunk = [], 0, chunk + 1
        if count:
            yield as_batch(list(packed(*map(np.concatenate, zip(*held, strict=True)), chunk)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(node, key, thin) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(key), pa.array(np.full(len(node), thin))], names=["node", "key", "thin"])

        def close() -> Iterator[pa.RecordBatch]:
            nodes, *rest = zip(*held, strict=True)
            node, (key, many) = np.concatenate(nodes), (np.concatenate([np.frombuffer(x, t) for x in v]) for v, t in zip(rest, ("<i8", "?"), strict=True))
            order = np.argsort(key, kind="stable")
            node, key, many = node[order], key[order], many[order]
            same = key[1:] == key[:-1]
            kept = (np.r_[False, same] | np.r_[same, False]) & ~many
            yield out(node[kept], key[kept], False)

        held, now = [], None
        for batch in batches:
            for part, kind, node, key, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind:
                    yield out(np.frombuffer(node, "<i8"), np.frombuffer(key, "<i8"), kind == 2)
                    continue
                if part != now and held:
                    yield from close()
                    held = []
                now = part
                held.append((np.cumsum(np.frombuffer(node, "<i8")), key, many))
        if held:
            yield from close()

    sent = texts.select("node", "t", "only").mapInArrow(send, "part bigint, kind int, node binary, key binary, many binary")
    return sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(meet, "node bigint, key bigint, thin boolean")


def narrow_sketches(texts: DataFrame, size: int) -> DataFrame:
    """node, n, sig of ``texts`` (node, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_pieces(batch.column(1)):
                flat, bounds = shingle_sets(texts, size)
                made = [narrow_sketch(flat[x:y]) for x, y in pairwise(bounds.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(np.diff(bounds)), pa.array(made, pa.binary())], names=["node", "n", "sig"])

    return texts.select("node", "t").mapInArrow(run, "node bigint, n bigint, sig binary")


def near(sizes: Sizes, na, nb, apart):
    """Whether sizes and the number of differing bits allow a link."""
    return (sizes.top * np.maximum(na, nb) <= sizes.base * np.minimum(na, nb)) & (apart * (sizes.base + sizes.top) <= (sizes.base - sizes.top) * (na + nb))


def allowed(pairs: DataFrame, sketches: DataFrame, sizes: Sizes) -> DataFrame:
    """Of ``pairs`` (a, b) those that the narrow sketches (node, n, sig) leave."""
    fits = f"{sizes.top} * greatest(na, nb) <= {sizes.base} * least(na, nb)"
    of = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").filter(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            apart = [int(np.bitwise_count(folded(x, least) ^ folded(y, least)).sum()) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True) for least in [min(len(x), len(y))]]
            kept = near(sizes, na, nb, np.array(apart, "i8"))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(kept)) for k in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, size: int, sizes: Sizes) -> DataFrame:
    """Of ``pairs`` those whose sets are similar enough, by their texts."""
    of = lambda x: texts.select(F.col("node").alias(x), F.col("t").alias(f"t{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, at, x = [], None, None
            for i, b in enumerate(batch.column(1).to_pylist()):
                if b != at:
                    at, x = b, shingles(batch.column(3)[i].as_py(), size)
                y = shingles(batch.column(2)[i].as_py(), size)
                common = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(sizes.base * common >= sizes.top * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(kept, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def compared(dealt: DataFrame, sizes: Sizes) -> DataFrame:
    """Distinct pairs (a, b), a < b, of different roots that the narrow sketches leave in a task of ``dealt``: task, node,
    root, n, sig, own (whether it stands in the task by itself, or only to be compared with those that do). Rows of a
    task that share the commonest root are not compared with each other."""

    def pairs_of(node, root, n, own, sig) -> tuple[np.ndarray, np.ndarray]:
        least = min(map(len, sig))
        words = np.stack([folded(x, least) for x in sig])
        names, place, many = np.unique(root, return_inverse=True, return_counts=True)
        minor = np.flatnonzero(place != np.argmax(many))
        a, b = [np.array([], "i8")], [np.array([], "i8")]
        for k in minor.tolist():
            apart = np.bitwise_count(words ^ words[k]).sum(axis=1, dtype="i8")
            other = np.flatnonzero(near(sizes, n, n[k], apart) & (root != root[k]) & (own | own[k]))
            a.append(np.minimum(node[other], node[k]))
            b.append(np.maximum(node[other], node[k]))
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)] + [np.array(batch.column(5).to_pylist(), object)]
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            whole = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from split([x[:whole] for x in rows])
            held = [x[whole:] for x in rows]
        if held is not None:
            yield from split(held)

    def split(rows) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]]).tolist() if len(rows[0]) else []
        found = [pairs_of(*(x[s:e] for x in rows[1:])) for s, e in zip(starts, [*starts[1:], len(rows[0])], strict=True) if e - s > 1]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])

    made = dealt.select("task", "node", "root", "n", "own", "sig").repartition("task").sortWithinPartitions("task", "node")
    return made.mapInArrow(run, "a bigint, b bigint").distinct()


def small_pairs(members: DataFrame, sizes: Sizes) -> DataFrame:
    """Distinct pairs of ``members`` (key, node, root, n) of a band with different roots, of sizes that can be linked. No
    band has more than SMALL."""

    def made(key, node, root, n) -> pa.RecordBatch:
        a, b, rows = [np.array([], "i8")], [np.array([], "i8")], np.arange(len(key))
        for d in range(1, SMALL):
            rows = rows[rows + d < len(key)]
            rows = rows[key[rows] == key[rows + d]]
            x = rows[(root[rows] != root[rows + d]) & near(sizes, n[rows], n[rows + d], 0)]
            a.append(np.minimum(node[x], node[x + d]))
            b.append(np.maximum(node[x], node[x + d]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                rows = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
                whole = int(np.searchsorted(rows[0], rows[0][-1]))
                yield made(*(x[:whole] for x in rows))
                held = [x[whole:] for x in rows]
        if held is not None:
            yield made(*held)

    return members.select("key", "node", "root", "n").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()


class _Join:
    """The components that the links found so far make of the nodes of ``texts`` (node, n, t)."""

    def __init__(self, texts: DataFrame, size: int, sizes: Sizes):
        self.texts, self.size, self.sizes = texts, size, sizes
        self.sketches = cut(narrow_sketches(texts, size), "narrow_sketches")
        self.seen = self.roots = None
        self.tables = [self.sketches]

    def test(self, pairs: DataFrame) -> None:
        """Verify candidates that were not tested before, and bring the components up to date."""
        if self.seen is not None:
            pairs = pairs.join(self.seen, ["a", "b"], "left_anti")
        pairs = cut(pairs, "pairs")
        self.tables.append(pairs)
        if pairs.isEmpty():
            return
        self.seen = pairs if self.seen is None else self.seen.unionByName(pairs)
        left = cut(allowed(pairs, self.sketches, self.sizes), "allowed")
        found = cut(verified(left, self.texts, self.size, self.sizes), "confirmed")
        forget(left)
        if found.isEmpty():
            forget(found)
            return
        if self.roots is None:
            self.roots = connected_components(found).select("node", "root")
            forget(found)
            return
        known = self.roots
        of = lambda x: known.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
        ends = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        merged = connected_components(ends)  # of the components so far; a node without links stands for itself
        moved = known.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        self.roots = cut(moved.unionByName(merged.join(known, "node", "left_anti")), "roots")
        for x in (known, found):
            forget(x)

    def rooted(self, rows: DataFrame) -> DataFrame:
        if self.roots is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def open(self, shared: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
        """Members with their roots; and key and c of the bands of ``least`` members or more, of more than one component."""
        rooted = self.rooted(shared)
        return rooted, rooted.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("x"), F.max("root").alias("y")).filter((F.col("x") < F.col("y")) & (F.col("c") >= least)).select("key", "c")

    def stars(self, shared: DataFrame, *by) -> None:
        """Test the sets of an open band with those that are the least by ``by``, if their roots differ."""
        rooted, still = self.open(shared)
        hub = lambda k, order: F.min(F.struct(order.alias("o"), F.col("node").alias("hub"), F.col("root").alias("hub_root"))).alias(f"h{k}")
        hubs = rooted.groupBy("key").agg(*[hub(k, order) for k, order in enumerate(by)]).join(still, "key").select("key", F.explode(F.array(*[f"h{k}" for k in range(len(by))])).alias("h"))
        met = rooted.join(hubs, "key").filter("root <> h.hub_root")
        self.test(met.select(F.least("node", "h.hub").alias("a"), F.greatest("node", "h.hub").alias("b")).distinct())

    def compare_small(self, shared: DataFrame) -> None:
        """All pairs of different roots of the bands with up to SMALL members; those with three or fewer had their stars."""
        rooted, still = self.open(shared, 4)
        self.test(small_pairs(rooted.join(still.filter(F.col("c") <= SMALL), "key").join(self.sketches.select("node", "n"), "node"), self.sizes))

    def compare(self, shared: DataFrame) -> None:
        """The same of bands of any size, in parts: a row goes to its own part of the band, and to every other one unless it
        has the root that most have."""
        rooted, still = self.open(shared)
        members = rooted.join(still, "key")
        parts = F.ceil(F.col("c") / PART).cast("int")
        own = F.pmod(F.xxhash64("node"), parts).cast("int")
        common = members.filter(F.col("c") > PART).groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("major"))
        dealt = members.join(common, "key", "left").withColumn("mine", own)
        to = F.when(F.col("major").isNull() | (F.col("root") == F.col("major")), F.array("mine")).otherwise(F.sequence(F.lit(0), parts - 1))
        dealt = dealt.withColumn("part", F.explode(to)).select(F.xxhash64("key", "part").alias("task"), "node", "root", (F.col("mine") == F.col("part")).alias("own"))
        self.test(compared(dealt.join(self.sketches, "node"), self.sizes))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similar: tuple[int, int] = (4, 5), empty_alike: bool = False) -> DataFrame:
    """doc_id, n_shingles (the size of its set) and component_id: the least doc_id that links of at least ``similar``
    reach, itself included.

    A text's set holds its runs of ``shingle`` words, A-Z lower-cased; of fewer words, all as one. Texts without words and
    null ones have an empty set and are linked with nothing, or with ``empty_alike`` with each other. Repeated rows are
    documents of their own; those with the same id and set share a component. Null ids come last among the least. Other
    columns are not read. Empty table: no rows.
    """
    spark, sizes = docs.sparkSession, Sizes(*similar)
    one = F.struct(F.col(f"`{doc_id}`").isNull().alias("n"), F.col(f"`{doc_id}`").alias("d"))
    rows = marks(docs.select(one.alias("i"), F.col(f"`{text}`").alias("t")), shingle)
    marked = cut(rows.select("i", "d1", "d2", "n"), "marks")
    sets = rows if empty_alike else rows.filter("n > 0")
    texts = cut(sets.groupBy("d1", "d2").agg(F.min("i").alias("i"), F.first("n").alias("n"), F.first("t").alias("t")).withColumn("node", F.monotonically_increasing_id()), "sets")
    total = marked.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // CHUNK + 1)
    play, join, before = texts.withColumn("only", F.lit(None).cast("array<bigint>")), None, None
    for level, spread in enumerate((*LEVELS, None)):
        met = cut(shared_bands(play, shingle, sizes, spread or 1.0, 10 * level, parts, spread is None), "shared_bands")
        shared, thin = met.filter("not thin").select("key", "node"), met.filter("thin").select("node", F.col("key").alias("grp"))
        if join is None:
            near_ones = cut(texts.join(met.select("node").distinct(), "node", "left_semi").select("node", "t"), "candidate_texts")
            named, whole = cut(texts.select("d1", "d2", "i", "node"), "names"), texts
            forget(whole)  # what is compared from here on stands in a shared band
            play, join = near_ones.withColumn("only", F.lit(None).cast("array<bigint>")), _Join(near_ones, shingle, sizes)
        join.stars(shared, F.col("node"), -F.col("node"))
        if spread is None:
            join.compare(shared)
            forget(met)
            break
        join.compare_small(shared)
        _, still = join.open(shared, SMALL + 1)
        hot = shared.join(still, "key").groupBy("node", F.expr("key & 255").alias("class")).agg(F.count("*").alias("idle"))
        made = useful_bands(play.join(hot.select("node").distinct(), "node", "left_semi"), shingle, sizes, spread, 10 * level).withColumn("class", F.expr("grp & 255"))
        few = made.join(hot, ["node", "class"]).filter(F.col("filled") - F.col("idle") <= F.col("limit")).select("node", "grp")
        left = cut(few.unionByName(thin).groupBy("node").agg(F.collect_set("grp").alias("only")), "left_over")
        for x in (met, before):
            forget(x)
        before = left
        if left.isEmpty():
            break
        play = join.texts.join(left, "node")
    for x in [before, near_ones, *join.tables]:  # the components stand by themselves
        forget(x)
    reach = join.rooted(named)
    named = reach.join(reach.groupBy("root").agg(F.min("i").alias("c")), "root").select("d1", "d2", "c")
    known = (F.col("n") > 0) | F.lit(empty_alike)
    return marked.join(named, ["d1", "d2"], "left").select(F.col("i.d").alias(doc_id), F.col("n").alias("n_shingles"), F.when(known, F.col("c.d")).otherwise(F.col("i.d")).alias("component_id"))
