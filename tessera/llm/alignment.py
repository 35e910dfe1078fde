"""Alignment of two tokenizers over the same bytes.

Both tokenize a space and the text. A byte-level BPE and a piece BPE never join a character before a space with it, and
the first cuts before every space that something other than white space follows, so the text falls into chunks that
both tokenize for themselves; what a chunk gives is remembered in a table of bounded size.

In a chunk, bit k of a tokenizer's bitset is set where a token ends after byte k. The bits of both (AND) are the shared
cuts; between two of them lies a group. Every bit of either (OR) ends a stretch of bytes that lies in one token of each,
so the stretches are the links: the tokens' places are the popcounts of the two sets below the bit. Bitsets are packed
in words of 64 bits, and all chunks that a block meets for the first time stand in one, end to end.

How often an id pair is linked is counted in documents. Documents are taken in blocks of about BLOCK characters, and a
block sends a row for each pair that it holds, with the number of its documents, so that common pairs are summed before
the shuffle; the counts come back to the block by its pair numbers and are added up there.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import WHITE
from tessera.llm.common import cut

BLOCK = 2 << 20
#: Chunks that are remembered, and bytes of them, before they are forgotten.
MEMO_ENTRIES, MEMO_BYTES = 200_000, 8 << 20
_UNEVEN = re.compile(f" (?:[{WHITE}]|\\Z)")
_CUT = re.compile(f"(?<=[^ ])(?= [^{WHITE}])")
#: Bits of a pair number that hold the second id.
_LOW = 32


def byte_of_character() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, the others from
    U+0100 on in their order."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def bitset(at: np.ndarray, size: int) -> np.ndarray:
    """The set of the places ``at`` below ``size``, in words of 64 bits."""
    marks = np.zeros(-(-size // 64) * 64, bool)
    marks[at] = True
    return np.packbits(marks, bitorder="little").view("<u8")


def select(words: np.ndarray) -> np.ndarray:
    """The places of a set, ascending."""
    return np.flatnonzero(np.unpackbits(words.view("u1"), bitorder="little"))


def rank(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many places of a set lie below each of ``at``."""
    below = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype="i8")])
    inside = words[at >> 6] & (np.uint64(1) << (at & 63).astype("u8")) - np.uint64(1)
    return below[at >> 6] + np.bitwise_count(inside)


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """For the byte lengths of two rows of tokens over the same bytes: the last byte of each link and the places of its
    tokens; the last byte of each group and the numbers of tokens up to it."""
    size = int(a.sum())
    x, y = (bitset(np.cumsum(v) - 1, size) for v in (a, b))
    links, cuts = select(x | y), select(x & y)
    return links, rank(x, links), rank(y, links), cuts, rank(x, cuts) + 1, rank(y, cuts) + 1


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places from each start on, as many as its size."""
    done = np.cumsum(sizes)
    return np.arange(done[-1] if len(done) else 0) + np.repeat(starts - (done - sizes), sizes)


class Aligner:
    """``a_path``: a file of the tokenizers library, byte-level; ``b_path``: a sentencepiece model that puts a space
    before the text. Special tokens' strings are ordinary text.

    Chunks that were met get a number; what they give stands in arrays by that number, until there are too many."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks fill the cores; threads of their own only wait for each other
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte = byte_of_character()
        names = self.a.get_vocab()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for t, i in names.items():
            self.a_bytes[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        ids = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        self.a_size, self.b_size = (np.array([len(x) for x in v]) for v in (self.a_bytes, self.b_bytes))
        ends = ((len(self.a_bytes), ",", "|"), (len(self.b_bytes), ",", ";"))  # of a token that its group goes on after, and of its last
        self.written = pa.array([f"{i}{x}" for n, *two in ends for i in range(n) for x in two])
        self.forget()

    @staticmethod
    @lru_cache(maxsize=2)
    def load(a_path: str, b_path: str) -> Aligner:
        return Aligner(a_path, b_path)

    def forget(self) -> None:
        """No chunks are known; ``sizes`` will hold tokens of each, groups and links by chunk, -1 for one without tokens."""
        self.known, self.shown, self.held = {}, [], 0
        self.sizes, self.links = np.empty((0, 4), "i8"), np.array([], "<i8")

    def learn(self, new: list[str]) -> None:
        raw = [(" " + c).encode() for c in new]
        a, b = [e.ids for e in self.a.encode_batch_fast([" " + c for c in new], add_special_tokens=False)], self.b.encode(new)
        size = np.array([len(r) for r in raw])
        good = self._same(raw, size, a, self.a_bytes, self.a_size) & self._same(raw, size, b, self.b_bytes, self.b_size)
        a, b = ([v if ok else [] for v, ok in zip(x, good.tolist(), strict=True)] if not good.all() else x for x in (a, b))
        many_a, many_b = (np.array([len(v) for v in x]) for x in (a, b))
        fa, fb = (np.fromiter(chain.from_iterable(x), "i8", int(n.sum())) for x, n in ((a, many_a), (b, many_b)))
        size = np.where(good, size, 0)
        link, la, lb, cut_, ga, gb = aligned(self.a_size[fa], self.b_size[fb])
        ends = np.cumsum(size)
        count = lambda at: np.diff(np.concatenate([[0], np.searchsorted(at, ends)]))
        sizes = np.stack([np.where(good, many_a, -1), many_b, count(cut_), count(link)], axis=1)
        self.shown += self._shown(fa, fb, ga, gb, sizes[:, 2])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.links = np.concatenate([self.links, fa[la] << _LOW | fb[lb]])
        self.held += int(size.sum())

    @staticmethod
    def _same(raw: list[bytes], size: np.ndarray, ids: list[list[int]], names: list[bytes], name_size: np.ndarray) -> np.ndarray:
        """Whether the bytes of each chunk's tokens are the chunk's."""
        many = np.array([len(v) for v in ids])
        flat = np.fromiter(chain.from_iterable(ids), "i8", int(many.sum()))
        before = np.concatenate([[0], np.cumsum(name_size[flat])])
        end = np.cumsum(many)
        start, given = before[end - many], before[end] - before[end - many]
        alike = given == size
        made, told = b"".join([names[i] for i in flat.tolist()]), b"".join(raw)
        if alike.all() and made == told:
            return alike
        x, y = np.frombuffer(made, "u1"), np.frombuffer(told, "u1")
        own = np.flatnonzero(alike)
        at = (np.cumsum(size) - size)[own]
        other = x[_ranges(start[own], size[own])] != y[_ranges(at, size[own])]
        alike[np.repeat(own, size[own])[other]] = False
        return alike

    def _shown(self, fa: np.ndarray, fb: np.ndarray, ga: np.ndarray, gb: np.ndarray, groups_: np.ndarray) -> list[str]:
        """The groups of each chunk written out: tokens in the order of their groups, each with what follows it."""
        na, nb = np.diff(ga, prepend=0), np.diff(gb, prepend=0)
        last_a, last_b = np.zeros(len(fa), "i8"), np.zeros(len(fb), "i8")
        last_a[ga - 1], last_b[gb - 1] = 1, 1
        of = lambda n: np.repeat(np.arange(len(n)), n)
        code = np.empty(len(fa) + len(fb), "i8")
        code[np.arange(len(fa)) + (gb - nb)[of(na)]] = fa * 2 + last_a
        code[np.arange(len(fb)) + ga[of(nb)]] = 2 * len(self.a_size) + fb * 2 + last_b
        done = np.cumsum(groups_)
        tokens = np.concatenate([[0], np.cumsum(na + nb)])[np.concatenate([[0], done])]
        lists = pa.LargeListArray.from_arrays(pa.array(tokens), self.written.take(pa.array(code)))
        return [x[:-1] for x in pc.binary_join(lists, "").to_pylist()]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """For each text the numbers of tokens of both, groups and links, and its groups written out; and a number for every
        link, one text after another. Texts null, empty, or with bytes that are not those of the tokens have none."""
        if len(self.known) > MEMO_ENTRIES or self.held > MEMO_BYTES:
            self.forget()
        parts = [[] if not t else [c[1:] for c in _CUT.split(" " + t)] if _UNEVEN.search(" " + t) else t.split(" ") for t in texts]
        known = self.known
        if new := [c for c in dict.fromkeys(c for p in parts for c in p) if c not in known]:
            self.learn(new)
        code = [[known[c] for c in p] for p in parts]
        flat = np.array([c for p in code for c in p], "i8")
        text = np.repeat(np.arange(len(texts)), [len(p) for p in code])
        bad = np.zeros(len(texts), bool)
        bad[text[self.sizes[flat, 0] < 0]] = True
        flat, text = flat[~bad[text]], text[~bad[text]]
        sums = np.stack([np.bincount(text, self.sizes[flat, k], len(texts)) for k in range(4)], axis=1).astype("i8")
        start = np.cumsum(self.sizes[:, 3]) - self.sizes[:, 3]
        shown = ["" if x else ";".join([self.shown[c] for c in p]) for x, p in zip(bad.tolist(), code, strict=True)]
        return sums, shown, self.links[_ranges(start[flat], self.sizes[flat, 3])]


def groups(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``groups``, an array of (a, b): the ids of both tokenizers between two shared cuts. A text
    without tokens has none."""
    named = [f"k{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, named, strict=True)], F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.load(a_path, b_path)
        for batch in batches:
            made = aligner(batch.column(batch.num_columns - 1).to_pylist())[1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=[*named, "g"])

    made = df.mapInArrow(run, ", ".join([*(f"{c} {k}" for c, k in df.dtypes if c != "t"), "g string"]))
    ids = lambda g, i: F.split(F.split(g, r"\|")[i], ",").cast("array<int>")
    pairs = F.transform(F.split("g", ";"), lambda g: F.struct(ids(g, 0).alias("a"), ids(g, 1).alias("b")))
    empty = F.array().cast("array<struct<a:array<int>,b:array<int>>>")
    return made.select(*[F.col(k).alias(c) for c, k in zip(keep, named, strict=True)], F.when(F.col("g") == "", empty).otherwise(pairs).alias("groups"))


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``docs``: i and t. Rows of two kinds, for each block: a document (i, n_a, n_b, n_groups, n_links, sha, its pairs'
    numbers in the block ``at``, and how often it has each, ``times``), and the block's pairs (``pairs``) with the number
    of documents that hold each (``held``)."""
    kind = dict(docs.dtypes)["i"]
    schema = f"block bigint, i {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, sha string, at array<int>, times array<int>, pairs array<bigint>, held array<bigint>"
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())

    def rows(block: int, ids: list[pa.Array], texts: list[str | None], aligner: Aligner) -> Iterator[pa.RecordBatch]:
        sums, shown, links = aligner(texts)
        pairs, place = np.unique(links, return_inverse=True)
        n, wide = len(texts), max(1, len(pairs))
        own, times = np.unique(np.repeat(np.arange(n), sums[:, 3]) * wide + place, return_counts=True)
        at = own % wide
        bounds = pa.array(np.searchsorted(own // wide, np.arange(n + 1)).astype("i4"))
        lists = lambda x: pa.ListArray.from_arrays(bounds, pa.array(x.astype("i4")))
        sha = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in shown]
        names, doc_id = [x.split()[0] for x in schema.split(", ")], pa.concat_arrays(ids)
        yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), doc_id, *(pa.array(sums[:, k]) for k in range(4)), pa.array(sha), lists(at), lists(times), pa.nulls(n, longs), pa.nulls(n, longs)], names=names)
        held = np.bincount(at, minlength=len(pairs))
        none = [pa.nulls(1, t) for t in (doc_id.type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), ints, ints)]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *none, pa.array([pairs], longs), pa.array([held], longs)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = Aligner.load(a_path, b_path), TaskContext.get().partitionId() << 32
        ids, texts, chars = [], [], 0
        for batch in batches:
            first = 0
            for k, x in enumerate(batch.column(1)):
                texts.append(x.as_py())
                chars += len(texts[-1] or "")
                if chars >= BLOCK:
                    yield from rows(block, [*ids, batch.column(0)[first : k + 1]], texts, aligner)
                    block, ids, texts, chars, first = block + 1, [], [], 0, k + 1
            if first < batch.num_rows:
                ids.append(batch.column(0)[first:])
        if texts:
            yield from rows(block, ids, texts, aligner)

    return docs.select("i", "t").mapInArrow(run, schema)


def _add_up(kind: str):
    """A block's documents with what the counts of their links come to."""

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        at, times = (docs.column(c).combine_chunks() for c in ("at", "times"))
        place = counts.column("place").to_numpy()
        size = int(place.max(initial=-1)) + 1
        count, best = np.zeros(size, "i8"), np.zeros(size, "i8")
        count[place], best[place] = counts.column("held").to_numpy(), counts.column("best").to_numpy()
        offsets, where, often = at.offsets.to_numpy(), at.flatten().to_numpy(), times.flatten().to_numpy().astype("i8")
        total = lambda v: (s := np.concatenate([[0], np.cumsum(v[where] * often)]))[offsets[1:] - offsets[0]] - s[offsets[:-1] - offsets[0]]
        return docs.select(["i", "n_a", "n_b", "n_groups", "n_links", "sha"]).append_column("n_best", pa.array(total(best), pa.int64())).append_column("count_sum", pa.array(total(count), pa.int64()))

    return run, f"i {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, sha string, n_best bigint, count_sum bigint"


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document: doc_id, n_a and n_b (tokens), n_groups, n_links, n_best (links whose pair no other pair of
    their A id outnumbers), count_sum (over links, how many documents hold their pair), groups_sha256.

    Texts null, empty, or whose bytes either tokenizer does not give back have zeros and an empty digest. Rows are
    documents: repeated rows and null ids count each, texts of any length are taken whole, other columns are not read.
    Empty table: no rows.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t"))
    blocks = cut(_blocks(rows, a_path, b_path), "aligned")
    held = blocks.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = cut(held.groupBy("pair").agg(F.sum("held").alias("held")).withColumn("a", F.shiftright("pair", _LOW)), "pair_counts")
    most = counts.groupBy("a").agg(F.max("held").alias("most"))
    ranked = counts.join(most, "a").select("pair", "held", (F.col("held") == F.col("most")).cast("bigint").alias("best"))
    placed = blocks.filter("pairs is not null").select("block", F.posexplode("pairs").alias("place", "pair")).join(ranked, "pair").select(F.col("block").alias("of"), "place", "held", "best")
    texts = blocks.filter("pairs is null").select("block", "i", "n_a", "n_b", "n_groups", "n_links", "sha", "at", "times")
    run, schema = _add_up(dict(rows.dtypes)["i"])
    made = texts.groupBy("block").cogroup(placed.groupBy("of")).applyInArrow(run, schema)
    return made.select(F.col("i").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("sha").alias("groups_sha256"))
