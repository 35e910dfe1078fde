"""Exact top-k search by integer inner product: a ball tree in every shard, branch and bound.

Rows are dealt to cells, each row to the nearest of at most CELLS pivots, and the rows of a cell to shards of bounded
size, so a shard's rows lie close together. A first round sends each query to one shard of its own cell and of the next
nearest. The k-th score it finds there is known to all that follows: a cell is left out for a query whose upper bound
q.c + |q| r, from the cell's centre and radius, is under that score, and in the shards of the other cells the nodes of
the tree are visited best bound first and left out the same way, against the current k-th score.

A shard is one sorted stream: its rows, of which a tree is built once, and then the queries, a batch at a time. Vectors
are not copied; what is sent is queries, and only to the shards that may better them.

How much is pruned depends on the vectors. Where they have no clusters (isotropic directions in 64 dimensions) no ball
excludes anything and every pair is compared; the result is exact all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, forget

#: Below every score; its negative is a long too. Scores beyond it either way count as it.
LEAST_SCORE = -(1 << 62)
#: Rows of a shard on average, cells at most, queries that one task may take to a shard, rows of a leaf.
SHARD_ROWS, CELLS, BLOCK_QUERIES, LEAF_ROWS = 4096, 256, 1 << 17, 64


class BallTree:
    """Nodes in level order: node i has the children 2i+1 and 2i+2; ``order`` puts each node's rows side by side."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(x))
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(x) / leaf)))))
        self.cuts = np.array([0, len(x)])
        centres, radii = [], []
        for level in range(self.depth + 1):
            for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
                rows = x[self.order[a:b]]
                centre = rows.mean(axis=0) if len(rows) else np.zeros(x.shape[1])
                away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
                centres.append(centre)
                radii.append(away.max() if len(rows) else 0.0)
                if level < self.depth and b - a > 1:  # halve along the line between two far points
                    far = rows[np.argmax(away)]
                    other = rows[np.argmax(((rows - far) ** 2).sum(axis=1))]
                    self.order[a:b] = self.order[a:b][np.argsort(rows @ (other - far), kind="stable")]
            if level < self.depth:
                self.cuts = np.insert(self.cuts, np.arange(1, len(self.cuts)), (self.cuts[:-1] + self.cuts[1:]) // 2)
        self.centres, self.radii = np.array(centres), np.array(radii)


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where its integers reach far enough, by Python's where longs may
    not, which are then held within the range of a score."""
    bound = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * q.shape[1]
    if bound < 2**52:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return q @ x.T
    return np.clip(q.astype(object) @ x.T.astype(object), LEAST_SCORE + 1, -LEAST_SCORE - 1).astype(np.int64)


class Shard:
    """A shard's rows and their tree; answers queries by branch and bound. ``compared`` counts the pairs looked at."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.x, self.ids, self.rows, self.compared = x, ids, rows, 0
        self.tree = BallTree(x.astype(np.float64))

    def __call__(self, q: np.ndarray, q_row: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, vec_id, score) of each query's k best rows here with at least the score ``least``."""
        tree = self.tree
        qf = q.astype(np.float64)
        norm = np.sqrt((qf**2).sum(axis=1))
        bound = qf @ tree.centres.T + norm[:, None] * tree.radii
        bound += 1 + 1e-9 * np.abs(bound)  # over rounding
        first_leaf = 2**tree.depth - 1
        best_s, best_i = np.full((len(q), k), LEAST_SCORE), np.full((len(q), k), np.iinfo(np.int64).max)
        kth = least.astype(np.int64).copy()

        def visit(node: int, among: np.ndarray) -> None:
            among = among[bound[among, node] >= kth[among]]
            if not len(among):
                return
            if node < first_leaf:
                a, b = 2 * node + 1, 2 * node + 2
                if bound[among, a].sum() < bound[among, b].sum():
                    a, b = b, a
                visit(a, among)
                visit(b, among)
                return
            rows = tree.order[tree.cuts[node - first_leaf] : tree.cuts[node - first_leaf + 1]]
            s = _product(q[among], self.x[rows])
            self.compared += s.size
            s[q_row[among][:, None] == self.rows[rows]] = LEAST_SCORE
            good = (s >= kth[among][:, None]).any(axis=1)
            among, s = among[good], s[good]
            if not len(among):
                return
            s = np.concatenate([best_s[among], s], axis=1)
            i = np.concatenate([best_i[among], np.broadcast_to(self.ids[rows], (len(among), len(rows)))], axis=1)
            top = np.lexsort((i, -s), axis=-1)[:, :k]
            best_s[among], best_i[among] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
            kth[among] = np.maximum(kth[among], best_s[among][:, k - 1])

        # queries that favour the same part of the tree go together
        home = np.argmax(bound[:, first_leaf:], axis=1)
        for group in np.array_split(np.argsort(home, kind="stable"), max(1, len(q) // 64)):
            visit(0, group)
        number, place = np.nonzero((best_s > LEAST_SCORE) & (best_s >= least[:, None]))
        return number, best_i[number, place], best_s[number, place]


def _matrix(column: pa.Array) -> np.ndarray:
    return pa.compute.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


_FOUND = "row bigint, query_id bigint, vec_id bigint, score bigint"


def _answers(k: int):
    """Reads streams sorted by shard, with a shard's rows (kind 0) before its queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            key, kind = batch.column("at").to_numpy(), batch.column("kind").to_numpy()
            ends = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]), True])
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                if key[a] != now:
                    now, held, shard = key[a], [], None
                if kind[a] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if shard is None:
                    x = np.concatenate([_matrix(p.column("v")) for p in held])
                    shard = Shard(x, np.concatenate([p.column("id").to_numpy() for p in held]), np.concatenate([p.column("row").to_numpy() for p in held]))
                least = part.column("least").fill_null(LEAST_SCORE).to_numpy()
                q_row, q_id = part.column("row").to_numpy(), part.column("id").to_numpy()
                n, i, s = shard(_matrix(part.column("v")), q_row, least, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_row[n]), pa.array(q_id[n]), pa.array(i), pa.array(s)], names=["row", "query_id", "vec_id", "score"])

    return run


def _dealt(rows: DataFrame, pivots: list[tuple]) -> DataFrame:
    """``rows`` with ``cell``, the place of the nearest pivot of their length, ``away``, how far it is, and ``near``, the
    place of the next nearest."""
    tables = {dim: (np.array([p[1] for p in pivots if p[0] == dim], np.int32), np.array([p[2] for p in pivots if p[0] == dim], np.float64)) for dim in {p[0] for p in pivots}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, near, away = np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                cells, p = tables[dim]
                x = _matrix(batch.column("v").take(pa.array(own))).astype(np.float64)
                order = np.argsort((p * p).sum(axis=1) - 2 * x @ p.T, axis=1, kind="stable")
                cell[own], near[own] = cells[order[:, 0]], cells[order[:, min(1, len(cells) - 1)]]
                away[own] = np.sqrt(((x - p[order[:, 0]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near), pa.array(away)], names=[*batch.schema.names, "cell", "near", "away"])

    return rows.mapInArrow(run, "dim int, row bigint, id bigint, v array<bigint>, cell int, near int, away double")


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``query_every``, its k best other rows.

    Components become floor(scale * x), held within a long; score is the integer inner product, held within +-(2**62 - 1);
    ties go to the smaller id. Null ids and vectors that are null, empty or hold a null or non-finite component take no
    part; vectors of another length are not compared. Rows with the same id are rows of their own: only the query's own
    row is left out. Fewer than k others: all of them. No query, or an empty table: no rows. Other columns are not read.
    """
    v = F.col(f"`{embedding}`")
    fine = F.col(f"`{vec_id}`").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    made = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.when(fine, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))).alias("v")).filter("v is not null")
    plain = cut(made.select(F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row"), "id", "v"), "vectors")
    every, lengths = plain.agg(F.count("*"), F.count_distinct("dim")).first()
    wanted = max(1, min(CELLS, every // shard_rows) // max(1, lengths))
    h = F.xxhash64("v")  # equal vectors are one pivot
    picked = plain.groupBy("dim", F.pmod(h, F.lit(wanted)).alias("b")).agg(F.min_by("v", h).alias("v")).collect()
    pivots = [(r["dim"], cell, r["v"]) for cell, r in enumerate(sorted(picked, key=lambda r: (r["dim"], r["b"])))]
    rows = cut(_dealt(plain, pivots).withColumn("query", F.pmod(F.col("id"), F.lit(query_every)) == 0), "dealt")
    forget(plain)
    spark = vectors.sparkSession
    centres = spark.createDataFrame([(cell, [float(x) for x in v]) for _, cell, v in pivots], "cell int, centre array<double>")  # a row for each cell
    sized = rows.groupBy("cell", "dim").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    cells = cut(sized.join(F.broadcast(centres), "cell").select("cell", "dim", "centre", "radius", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards")), "cells")
    small = F.broadcast(cells.select("cell", "shards"))
    shard = F.pmod(F.xxhash64("row"), F.col("shards")).cast("int")
    data = rows.join(small, "cell").select("cell", shard.alias("shard"), "row", "id", "v")
    queries = rows.filter("query").select("row", "id", "v", "dim", F.col("cell").alias("home"), "near")
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    block = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(blocks)).cast("int")

    def meet(q: DataFrame) -> DataFrame:
        """``q``: cell, shard, row, id, v, least. What each query finds in that shard."""
        left = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("cell", "shard", "block", F.lit(0).alias("kind"), "row", "id", "v", F.lit(None).cast("long").alias("least"))
        both = left.unionByName(q.select("cell", "shard", block.alias("block"), F.lit(1).alias("kind"), "row", "id", "v", "least"))
        at = ((F.col("shard").cast("long") * max(1, len(pivots)) + F.col("cell")) * blocks + F.col("block")).alias("at")
        return both.select(at, "kind", "row", "id", "v", "least").repartition("at").sortWithinPartitions("at", "kind").mapInArrow(_answers(k), _FOUND)

    two = F.explode(F.array_distinct(F.array("home", "near"))).alias("cell")
    begin = queries.select("row", "id", "v", two).join(small, "cell").select("cell", shard.alias("shard"), "row", "id", "v", F.lit(None).cast("long").alias("least"))
    first = cut(meet(begin), "first-round")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc()))
    least = first.withColumn("p", place).filter(F.col("p") == k).select("row", F.col("score").alias("least"))
    q = queries.join(least, "row", "left").withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b.cast("double") * b)))
    bound = F.aggregate(F.zip_with(F.col("v"), F.col("centre"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) + F.col("norm") * F.col("radius")
    open_ = q.join(F.broadcast(cells), "dim").filter(F.col("least").isNull() | (bound + 1 + 1e-9 * F.abs(bound) >= F.col("least")))
    met = ((F.col("cell") == F.col("home")) | (F.col("cell") == F.col("near"))) & (F.col("other") == shard)
    other = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).filter(~met)
    found = first.unionByName(meet(other.select("cell", F.col("other").alias("shard"), "row", "id", "v", "least")))
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
