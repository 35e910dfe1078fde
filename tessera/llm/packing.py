"""Bounded-space online packing of token streams into windows.

Each partition keeps a fixed number of open windows. A document's full windows go out at once; its tail goes to the
open window it fits best. If it fits none and no window may be opened, the fullest is topped up with the head of the
tail and emitted full, and the rest of the tail opens a window. What is open at the end of the partitions is joined
over groups of partitions and cut anew; the last short stretch of a group is cut at powers of two, which need no
padding. So no sequence is padded at all.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import ChunkedEncoder, id_bytes
from tessera.llm.common import cut

#: Open windows of a partition, and partitions whose open windows are joined at the end: at most 64 x 64 windows.
OPEN_WINDOWS, MERGED_PARTITIONS = 64, 64
PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
SCHEMA = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> ChunkedEncoder:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(k): int(v) for k, v in (line.split() for line in f if line.strip())}
    return id_bytes(tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)


class Packer:
    """Windows of ``size`` ids, at most ``limit`` open. A piece: (key, start, bytes of ids, doc_tokens)."""

    def __init__(self, size: int = 1024, limit: int = OPEN_WINDOWS):
        self.size, self.limit = size, limit
        self.open: list[tuple[int, int]] = []  # (free, number), least free first
        self.held: dict[int, list] = {}
        self.made = 0

    def add(self, key, ids: bytes) -> Iterator[list]:
        """Take a document; yield the windows that it fills, each a list of pieces."""
        n = len(ids) // 4
        full = n - n % self.size
        for at in range(0, full, self.size):
            yield [(key, at, ids[4 * at : 4 * (at + self.size)], n)]
        at = full
        while at < n:
            need = n - at
            k = bisect.bisect_left(self.open, (need, -1))
            if k == len(self.open):
                if len(self.open) < self.limit:
                    self.made += 1
                    self.held[self.made] = []
                    free, number = self.size, self.made
                else:
                    free, number = self.open.pop(0)
            else:
                free, number = self.open.pop(k)
            put = min(free, need)
            self.held[number].append((key, at, ids[4 * at : 4 * (at + put)], n))
            at += put
            if put == free:
                yield self.held.pop(number)
            else:
                bisect.insort(self.open, (free - put, number))

    def rest(self) -> Iterator[list]:
        for _, number in self.open:
            yield self.held.pop(number)
        self.open = []


def _cut_rest(total: int, size: int) -> list[int]:
    """Lengths of the sequences for ``total`` ids: full ones, then the binary digits of what is left."""
    left = total % size
    return [size] * (total // size) + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def pack(docs: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", size: int = 1024, end_id: int = 0) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and ``end_id``; null and empty texts are that id alone. Every id lies in one piece, a
    long document in as many as it takes; rows with the same or a null doc_id are packed each for itself. ``size`` is a
    power of two. The pieces are written to the shared folder once, so a lost task cannot number windows anew.
    """
    df = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    kind = dict(df.dtypes)["doc_id"]
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = _encoder(rank_path, pattern), Packer(size)
        part, count, key_type = TaskContext.get().partitionId(), 0, None

        def rows(windows: list[list], closed: bool) -> pa.RecordBatch:
            nonlocal count
            flat: list[tuple] = []
            for pieces in windows:
                at = 0
                for key, start, ids, n in pieces:
                    flat.append((key, start, len(ids) // 4, zlib.crc32(ids), n, (part << 32 | count) * 2, at, None if closed else ids))
                    at += len(ids) // 4
                count += 1
            cols = list(zip(*flat, strict=True)) or [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.binary()), pa.array([part] * len(flat), pa.int64())], names=["doc_id", *SCHEMA.names, "ids", "part"])

        for batch in batches:
            key_type = batch.column(0).type
            filled = []
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                filled += packer.add(key.as_py(), b"".join(encode(value.as_py() or "")) + last)
            yield rows(filled, True)
        if key_type is not None:
            yield rows(list(packer.rest()), False)

    made = cut(df.mapInArrow(run, f"doc_id {kind}, {PIECE}, ids binary, part bigint"), "pieces")

    def join_open(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        group = rows.column("g")[0].as_py()
        lengths = _cut_rest(sum(rows.column("length").to_pylist()), size)
        keys, starts, every, totals = (rows.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))
        out, k, at = [], 0, 0
        for key, start, ids, n in zip(keys, starts, every, totals, strict=True):
            done, have = 0, len(ids) // 4
            while done < have:
                put = min(have - done, lengths[k] - at)
                own = ids[4 * done : 4 * (done + put)]
                out.append((key, start + done, put, zlib.crc32(own), n, (group << 32 | k) * 2 + 1, at))
                done, at = done + put, at + put
                if at == lengths[k]:
                    k, at = k + 1, 0
        cols = list(zip(*out, strict=True))
        return pa.table([pa.array(cols[0], rows.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", *SCHEMA.names])

    columns = ["doc_id", *SCHEMA.names]
    rest = made.filter(F.col("ids").isNotNull()).withColumn("g", F.floor(F.col("part") / MERGED_PARTITIONS)).groupBy("g").applyInArrow(join_open, f"doc_id {kind}, {PIECE}")
    return made.filter(F.col("ids").isNull()).select(*columns).unionByName(rest)
