"""Byte-level BPE encoding and decoding with rank files.

Two tiers. A pre-token that is itself in the vocabulary is found by one probe of a minimal perfect hash. Any other is
merged with a heap over a doubly linked list of its bytes, O(n log n) for a pre-token of n bytes.

The text is first cut before every space that a non-space follows. Every alternative of the pre-token pattern that can
hold such a space begins with it, and a run of white space gives up its last character to what follows, so no
pre-token crosses these cuts and each chunk can be encoded for itself. Encoded chunks are remembered in a table of
bounded size; a chunk too long for it is encoded anew.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters with the Unicode property White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNEVEN = re.compile(f" (?:[{WHITE}]|\\Z)")
_CUT = re.compile(f"(?= [^{WHITE}])")
#: Chunks in a generation of a worker's memory, of which there are two, and the longest of them in characters.
MEMO_ENTRIES, MEMO_CHARS = 350_000, 40


#: 2**64 divided by the golden ratio, and the low 64 bits.
_ODD, _LOW64 = 0x9E3779B97F4A7C15, 0xFFFFFFFFFFFFFFFF


class MinimalPerfectHash:
    """n keys to 0..n-1 without gaps: hash and displace, buckets of two keys on average.

    A bucket with several keys stores the displacement that sends them to free slots; a bucket with one key stores its
    slot itself as a negative number.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        self.shift = [0] * self.buckets
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            members[(h >> 32) % self.buckets].append(h)
        taken, free = bytearray(n), 0
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if len(members[b]) > 1:
                d = 0
                while len(slots := {self._place(h, d) for h in members[b]}) < len(members[b]) or any(taken[s] for s in slots):
                    d += 1
                self.shift[b] = d
                for s in slots:
                    taken[s] = 1
            elif members[b]:
                while taken[free]:
                    free += 1
                taken[free] = 1
                self.shift[b] = -1 - free

    def _place(self, h: int, d: int) -> int:
        return (((h ^ d * _ODD) * _ODD & _LOW64) >> 20) % self.n

    def __call__(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[(h >> 32) % self.buckets]
        return -1 - d if d < 0 else self._place(h, d)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.token = [b""] * (max(ranks.values()) + 1)
        for key, rank in ranks.items():
            self.token[rank] = key
        keys = list(ranks)
        self.slot = MinimalPerfectHash(keys)
        self.slot_key, self.slot_rank = [b""] * len(keys), [0] * len(keys)
        for key in keys:
            s = self.slot(key)
            self.slot_key[s], self.slot_rank[s] = key, ranks[key]

    @staticmethod
    @lru_cache(maxsize=4)
    def load(path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return ByteBPE({base64.b64decode(k): int(v) for k, v in (line.split() for line in f if line.strip())}, pattern)

    def pretoken(self, piece: bytes) -> list[int]:
        s = self.slot(piece)
        if self.slot_key[s] == piece:
            return [self.slot_rank[s]]
        return self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Least rank first, leftmost among equals. A heap entry (rank, start, end) is stale unless the two parts that
        begin at start still end at end; which two parts they are does not change the merged bytes or their rank."""
        n, get = len(piece), self.ranks.get
        after, before = list(range(1, n + 2)), list(range(-1, n))
        gone = bytearray(n + 1)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, end = pop(heap)
            mid = after[i]
            if gone[i] or mid >= n or after[mid] != end:
                continue
            gone[mid] = 1
            after[i] = end
            before[end] = i
            if end < n and (r := get(piece[i : after[end]])) is not None:
                push(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := get(piece[p:end])) is not None:
                push(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.find(text) for i in self.pretoken(piece.encode())]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class ChunkMemo(dict):
    """What ``of`` makes of a chunk, kept for short chunks in two generations of at most ``entries`` each: a full table
    becomes the older one, and what is asked for again moves back into the younger."""

    def __init__(self, of, entries: int = MEMO_ENTRIES, chars: int = MEMO_CHARS):
        super().__init__()
        self.of, self.entries, self.chars, self.older = of, entries, chars, {}

    def __missing__(self, chunk: str):
        made = self.older.get(chunk)
        if made is None:
            made = self.of(chunk)
            if len(chunk) > self.chars:
                return made
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[chunk] = made
        return made


class ChunkedEncoder:
    """``made(chunk)`` of every chunk of a text, in order. The chunk passed on holds its leading space."""

    def __init__(self, made):
        self.made = made
        self.spaced = ChunkMemo(lambda c: made(" " + c))

    def __call__(self, text: str) -> list:
        if not text:
            return []
        spaced = self.spaced
        if _UNEVEN.search(text):
            return [spaced[c[1:]] if c[0] == " " else self.made(c) for c in _CUT.split(text) if c]
        first, *rest = text.split(" ")
        made = [spaced[c] for c in rest]
        return [self.made(first), *made] if first else made


def id_bytes(encode) -> ChunkedEncoder:
    """A text's chunks as little-endian unsigned 32-bit ids. ``encode``: a list of ids for a string."""
    return ChunkedEncoder(lambda c: np.array(encode(c), "<u4").tobytes())


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> tuple[ByteBPE, ChunkedEncoder]:
    bpe = ByteBPE.load(path, pattern)

    def made(chunk: str) -> tuple[bytes, bytes]:
        first, *rest = bpe.find(chunk)
        head = (b"", b"")
        if rest and first[0] == " " and len(first) > 1:  # a word with marks behind it: the word may be known
            head = chunks.spaced[first[1:]]
        else:
            rest = [first, *rest]
        ids = [i for piece in rest for i in bpe.pretoken(piece.encode())]
        return head[0] + np.array(ids, "<u4").tobytes(), head[1] + b"".join([b"%d," % i for i in ids])

    chunks = ChunkedEncoder(made)
    return bpe, chunks


FIELDS = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.binary(), "decoded_sha256": pa.string()}
SQL_TYPES = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def encode_column(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """``keep`` columns and, for each whole text, the ``outputs``: ids, n_tokens, ids_sha256 (of the decimal ids joined
    by commas), decoded (bytes of the decoded ids), decoded_sha256.

    No special tokens: their strings are ordinary text. A null text counts as empty: no ids, the digests of nothing.
    Rows are independent, so repeated rows, ties and null keys pass through; other columns are not read.
    """
    named = [f"k{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, named, strict=True)], F.col(f"`{text}`").alias("t"))
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in named), *(f"o_{o} {SQL_TYPES[o]}" for o in outputs)])
    want_decoded = any(o.startswith("decoded") for o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, chunks = _encoder(path, pattern)
        for batch in batches:
            out: dict[str, list] = {o: [] for o in outputs}
            for value in batch.column(batch.num_columns - 1):
                parts = chunks(value.as_py() or "")
                raw = b"".join([p[0] for p in parts])
                ids = np.frombuffer(raw, "<u4")
                if "n_tokens" in out:
                    out["n_tokens"].append(len(ids))
                if "ids" in out:
                    out["ids"].append(ids.astype("int32"))
                if "ids_sha256" in out:
                    out["ids_sha256"].append(hashlib.sha256(b"".join([p[1] for p in parts])[:-1]).hexdigest())
                if want_decoded:
                    decoded = bpe.decode(ids.tolist())
                    if "decoded" in out:
                        out["decoded"].append(decoded)
                    if "decoded_sha256" in out:
                        out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(out[o], FIELDS[o]) for o in outputs)], names=[*named, *(f"o_{o}" for o in outputs)])

    made = df.mapInArrow(run, schema)
    return made.select(*[F.col(k).alias(c) for c, k in zip(keep, named, strict=True)], *[F.col(f"o_{o}").alias(o) for o in outputs])


def decode_column(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded``, the bytes of each array of ids (null: no bytes)."""
    named = [f"k{i}" for i in range(len(keep))]
    df = encoded.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, named, strict=True)], F.col(f"`{ids}`").alias("i"))
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.load(path, pattern)
        for batch in batches:
            made = [bpe.decode(x.as_py() or ()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], names=[*named, "decoded"])

    made = df.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in named), "decoded binary"]))
    return made.select(*[F.col(k).alias(c) for c, k in zip(keep, named, strict=True)], "decoded")
