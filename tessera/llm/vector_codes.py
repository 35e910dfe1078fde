"""Vector code compression by delta-maintained Lloyd rounds.

A vector is cut into equal parts, each part position has a codebook of integer entries, and a vector's code is the index
of the nearest entry for every part. Each round writes down the assignments beside the vectors; only parts whose entry
changed then send anything on: plus to the new entry, minus to the old one, summed in the task before the shuffle. The
running sums and counts are a small table (a row for each component of each entry), to which a round adds its changes.
What a task or the driver holds is bounded by the codebooks, not by the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, forget

#: Integers beyond are clipped to it.
FAR = 1 << 62
#: Up to here float64 holds integers exactly.
EXACT = 1 << 53


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]``: the integer entries of part p, an (entries, width) array of Python or numpy integers."""

    bounds: tuple[int, ...]
    entries: list[np.ndarray]

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~wrong, F.lit(False))


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of float64 ``vectors``, as int64."""
    with np.errstate(over="ignore"):
        wide = np.floor(vectors * float(scale))
    return np.clip(wide, -float(FAR), float(FAR)).astype("i8")


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest of ``entries`` for every row of ``x``, ties to the lower one, and its squared distance."""
    if x.shape[1] == 0:
        return np.zeros(len(x), "i8"), np.zeros(len(x), "i8")
    most = max(int(np.abs(x).max(initial=0)), max(abs(int(v)) for v in entries.ravel()))
    if x.shape[1] * (2 * most + 1) ** 2 < EXACT:
        e, f = entries.astype("f8"), x.astype("f8")
        d = (f * f).sum(axis=1)[:, None] - 2 * (f @ e.T) + (e * e).sum(axis=1)[None, :]
    else:
        d = ((x.astype(object)[:, None, :] - entries.astype(object)[None, :, :]) ** 2).sum(axis=2)
    at = np.argmin(d, axis=1)
    return at, d[np.arange(len(x)), at]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def assign(rows: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """``rows`` (v and what goes with it) with ``code``, a byte for each part, ``was``, the code before, and ``error``."""
    before = "code" in rows.columns
    kept = [c for c in rows.columns if c not in ("code", "was", "error")]
    schema = ", ".join([*(f"`{c}` {k}" for c, k in rows.dtypes if c in kept), "was binary, code binary, error bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(_matrix(batch.column("v")), scale)
            codes, error = np.empty((batch.num_rows, len(books.entries)), "u1"), [0] * batch.num_rows
            for p, (low, high) in enumerate(zip(books.bounds, books.bounds[1:], strict=False)):
                codes[:, p], d = nearest(x[:, low:high], books.entries[p])
                error = [a + int(b) for a, b in zip(error, d.tolist(), strict=True)]
            was = batch.column("code") if before else pa.nulls(batch.num_rows, pa.binary())
            made = [was, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([min(e, (1 << 63) - 1) for e in error], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, "was", "code", "error"])

    return rows.select(*kept, *(["code"] if before else [])).mapInArrow(run, schema)


def changes(assigned: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """part, entry, at, total: what the parts that changed their entry add to it and take from the old one; at -1 is the
    count. One row for each touched number and task leaves the task."""
    shapes = [e.shape for e in books.entries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((n, w + 1), object) for n, w in shapes]
        for batch in batches:
            x = integers(_matrix(batch.column("v")), scale)
            new = np.frombuffer(b"".join(batch.column("code").to_pylist()), "u1").reshape(len(x), -1)
            old = np.array([list(c) if c is not None else [-1] * len(shapes) for c in batch.column("was").to_pylist()], "i2").reshape(len(x), -1)
            for p, (low, high) in enumerate(zip(books.bounds, books.bounds[1:], strict=False)):
                moved = np.flatnonzero(new[:, p] != old[:, p])
                part = np.c_[x[moved, low:high], np.ones(len(moved), "i8")]
                small = int(np.abs(part).max(initial=0)) * (len(moved) + 1) < 1 << 62
                for codes, sign in ((new[moved, p].astype("i8"), 1), (old[moved, p].astype("i8"), -1)):
                    there = codes >= 0
                    add = np.zeros(shapes[p][:1] + (part.shape[1],), "i8" if small else object)
                    np.add.at(add, codes[there], part[there] if small else part[there].astype(object))
                    sums[p] += sign * add.astype(object)
        rows = [(p, e, at if at < shapes[p][1] else -1, str(v)) for p, s in enumerate(sums) for e, row in enumerate(s) for at, v in enumerate(row) if v]
        if rows:
            part, entry, at, total = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(at, pa.int32()), pa.array(total, pa.string())], names=["part", "entry", "at", "total"])

    moved = assigned.filter(F.col("was").isNull() | (F.col("was") != F.col("code"))).select("v", "was", "code")
    made = moved.mapInArrow(run, "part int, entry int, at int, total string").withColumn("total", F.col("total").cast("decimal(38,0)"))
    return made.groupBy("part", "entry", "at").agg(F.sum("total").cast("decimal(38,0)").alias("total"))


def _moved(books: Codebooks, sums: DataFrame) -> Codebooks:
    """Every entry becomes the floor of its sums over its count; entries without parts stay. Reads a number for each
    component of the codebooks."""
    entries = [e.astype(object) for e in books.entries]
    totals = {(r.part, r.entry, r["at"]): int(r.total) for r in sums.filter("total is not null").collect()}
    for (p, e, at), n in totals.items():
        if at == -1 and n > 0:
            entries[p][e] = [totals.get((p, e, k), 0) // n for k in range(entries[p].shape[1])]
    return Codebooks(books.bounds, [np.array(e.tolist(), "i8").reshape(e.shape) for e in entries])


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks]:
    """A row for each usable vector: vec_id, the ``keep`` columns, code (binary, a byte for each part) and error (squared
    distance to the coded vector); and the codebooks.

    A component x becomes the integer floor(scale * x), within 2**62. Codebooks start as the parts of the vectors with
    the ``entries`` (256 at most) smallest ids, by vector where ids are equal, null ids last; fewer vectors give fewer
    entries. Vectors null, empty, or with null or non-finite components are left out, as are those of another length
    than the first. Part p goes from floor(p * length / parts) on, so parts are equal where ``parts`` divides the length.
    Ties go to the lower entry. Repeated rows count each time. Errors beyond a long are the largest long. Other columns
    are not read. Empty table: no rows, codebooks without entries.
    """
    names = [f"k{i}" for i in range(len(keep))]
    rows = vectors.filter(usable(F.col(f"`{vector}`"))).select(F.col(f"`{vec_id}`").alias("i"), F.col(f"`{vector}`").alias("v"), *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)])
    order = [F.col("i").asc_nulls_last(), F.col("v")]
    one = rows.orderBy(*order).select("v").first()
    length = len(one.v) if one else 0
    rows = rows.filter(F.size("v") == length)
    first = [r.v for r in rows.orderBy(*order).limit(entries).select("v").collect()]
    start = integers(np.array(first, "f8").reshape(len(first), length), scale)
    bounds = tuple(p * length // parts for p in range(parts + 1))
    books = Codebooks(bounds, [start[:, low:high] for low, high in zip(bounds, bounds[1:], strict=False)])
    sums = None
    for _ in range(rounds if one else 0):
        made = cut(assign(rows, books, scale), "codes")
        if sums is not None:
            forget(rows)
        rows, change = made, changes(made, books, scale)
        both = change if sums is None else sums.unionByName(change).groupBy("part", "entry", "at").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
        sums, old = cut(both, "code_sums"), sums
        forget(old)
        books = _moved(books, sums)
    last = cut(assign(rows, books, scale), "codes") if one else rows.withColumn("code", F.lit(None).cast("binary")).withColumn("error", F.lit(0).cast("bigint"))
    if sums is not None:
        forget(rows)
        forget(sums)
    return last.select(F.col("i").alias(vec_id), *[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)], "code", "error"), books


def decode(codes: DataFrame, books: Codebooks, code: str = "code", out: str = "decoded") -> DataFrame:
    """``codes`` with the integers that each code stands for. A null code: null."""
    schema = ", ".join([*(f"`{c}` {k}" for c, k in codes.dtypes), f"`{out}` array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if c is None else [int(x) for p, e in enumerate(c) for x in books.entries[p][e]] for c in batch.column(batch.schema.names.index(code)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int64()))], names=[*batch.schema.names, out])

    return codes.mapInArrow(run, schema)


def summed(rows: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``, the sum of ``value`` over the rows of equal ``by``, nulls together; within a long. Sums are
    taken before the join, so a value that very many rows share is one row on the other side."""
    far = F.lit(str((1 << 63) - 1)).cast("decimal(38,0)")
    total = rows.groupBy(F.col(f"`{by}`").alias("by_")).agg(F.least(F.sum(F.col(f"`{value}`").cast("decimal(19,0)")).cast("decimal(38,0)"), far).cast("bigint").alias(out))
    return rows.join(total, F.col(f"`{by}`").eqNullSafe(F.col("by_"))).drop("by_")
