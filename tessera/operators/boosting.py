"""Gradient-boosted trees of two classes, all grown within one job.

A learner that asks the driver for every level of every tree runs hundreds of jobs one after another, however few the
rows. Here a task keeps its rows, cut into bins, and the tasks exchange their sums a level at a time (barrier mode).
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task keeps at least, if there are so many, and rows of the sample that bins are cut by.
TASK_ROWS, SAMPLE = 250_000, 10_000
#: A difference that a double does not tell from none, beside 1.
EPSILON = 2.0**-52


def thresholds(values: np.ndarray, most: int) -> list[float]:
    """Up to ``most`` limits between the values, with about as many values between any two; between all, if few differ."""
    value, count = np.unique(values, return_counts=True)
    between = ((value[:-1] + value[1:]) / 2).tolist()
    if len(between) <= most:
        return between
    stride, done, count = len(values) / (most + 1), count[0], count.tolist()
    out, target = [], stride
    for k in range(1, len(count)):
        before, done = done, done + count[k]
        if abs(before - target) < abs(done - target):
            out.append(between[k - 1])
            target += stride
    return out


def bin_of(limits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of the limit that each value equals, else how many are less. Limits between neighbouring doubles may be
    equal; which of those a value gets is what halving the range comes upon first, as in the library."""
    low, high = np.zeros(len(values), "i8"), np.full(len(values), len(limits) - 1)
    while (search := np.flatnonzero(low <= high)).size:
        middle = (low[search] + high[search]) >> 1
        at, value = limits[middle], values[search]
        up, down = at < value, at > value
        low[search[up]] = middle[up] + 1
        high[search[down]] = middle[down] - 1
        met = ~(up | down)
        low[search[met]], high[search[met]] = middle[met], -1
    return low


def spread(sums: np.ndarray) -> np.ndarray:
    """Variances of rows whose number, sum and sum of squares are the last axis."""
    n, s, q = sums[..., 0], sums[..., 1], sums[..., 2]
    some = np.where(n > 0, n, 1.0)
    return np.where(n > 0, (q - s * s / some) / some, 0.0)


def best_split(sums: np.ndarray, widths: list[int], whole: np.ndarray | None, least: int) -> tuple | None:
    """Feature, bin, and the sums of both sides of the split of the greatest gain, ties to the first; None without gain.
    ``sums``: features by bins by (number, sum, sum of squares); ``whole``: those of the node, None at the root."""
    left = np.cumsum(sums, axis=1)
    best, found = 0.0, None
    impurity = None if whole is None else spread(whole)
    for f, width in enumerate(widths):
        if not width:
            continue
        a = left[f, :width]
        b = left[f, width] - a
        if impurity is None:
            impurity = spread(a[0] + b[0])
        n = np.maximum(a[:, 0] + b[:, 0], 1.0)
        gain = impurity - a[:, 0] / n * spread(a) - b[:, 0] / n * spread(b)
        gain[(a[:, 0] < least) | (b[:, 0] < least)] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = gain[k], (f, k, a[k], b[k])
    return found


def grown(bins: np.ndarray, target: np.ndarray, limits: list[np.ndarray], depth: int, least: int, add) -> tuple[list[tuple], np.ndarray]:
    """A regression tree as (node, feature, bin, value), children of node k being 2k and 2k + 1, leaves without a feature; and
    the value of each row. ``add`` sums an array over all tasks."""
    widths = [len(v) for v in limits]
    features, wide = len(widths), max(widths, default=0) + 1
    same = [np.append(np.searchsorted(v, v, side="right") - 1, len(v)) for v in limits]  # bins with equal limits stay together
    cell = bins + np.arange(features) * wide
    at = np.ones(len(bins), "i8")
    tree, value, open_ = [], np.zeros(len(bins)), {1: None}
    mean = lambda v: float(v[1] / v[0]) if v[0] else 0.0
    if not any(widths):
        whole = add(np.array([len(target), target.sum(), (target * target).sum()]))
        return [(1, None, None, mean(whole))], np.full(len(bins), mean(whole))
    for level in range(depth):
        names = sorted(open_)
        place = np.searchsorted(names, at)
        inside = np.isin(at, names)
        size = len(names) * features * wide
        slot = (place[inside, None] * (features * wide) + cell[inside]).T.ravel()
        y = np.tile(target[inside], features)
        sums = add(np.stack([np.bincount(slot, minlength=size).astype(float), np.bincount(slot, y, size), np.bincount(slot, y * y, size)], axis=-1))
        sums = sums.reshape(len(names), features, wide, 3)
        for k, node in enumerate(names):
            rows = at == node
            whole = open_.pop(node)
            split = best_split(sums[k], widths, whole, least)
            if split is None:
                total = sums[k, 0].sum(axis=0) if whole is None else whole
                tree.append((node, None, None, mean(total)))
                value[rows] = mean(total)
                continue
            f, cut, *sides = split
            tree.append((node, f, cut, mean(sides[0] + sides[1])))
            at[rows] = 2 * node + (same[f][bins[rows, f]] > same[f][cut])
            for child, side in zip((2 * node, 2 * node + 1), sides, strict=True):
                if level + 1 < depth and abs(spread(side)) >= EPSILON:
                    open_[child] = side
                else:
                    tree.append((child, None, None, mean(side)))
                    value[at == child] = mean(side)
        if not open_:
            break
    return tree, value


@dataclass
class BoostedModel:
    """Trees as {node: (feature, limit, value)}, each counting ``rate``, the first one wholly."""

    trees: list[dict[int, tuple[int, float, float]]]
    features: str
    rate: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for number, tree in enumerate(self.trees):
            at, value = np.ones(len(x), "i8"), np.zeros(len(x))
            for node in sorted(tree):
                feature, limit, own = tree[node]
                rows = np.flatnonzero(at == node)
                if feature < 0:
                    value[rows] = own
                else:
                    at[rows] = 2 * node + (x[rows, feature] > limit)
            total += value * (self.rate if number else 1.0)
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with probability (a vector of both classes) and prediction."""

        @F.pandas_udf("double")
        def margin(rows: pd.Series) -> pd.Series:
            return pd.Series(self.margins(np.stack(rows.to_numpy())) if len(rows) else [], dtype="float64")

        m = F.col("margin")
        made = df.withColumn("margin", margin(vector_to_array(F.col(f"`{self.features}`"))))
        up = 1 / (1 + F.exp(-2 * m))
        return made.withColumn("probability", array_to_vector(F.array(1 - up, up))).withColumn("prediction", (m > 0).cast("double")).drop("margin")


@dataclass
class BoostedTrees:
    """Trees of up to ``maxDepth`` levels on the negative gradients of the log loss, as GBTClassifier grows them: limits
    from a sample of about SAMPLE rows (all, if there are no more), variance as impurity, the first of equal gains.

    All rows are trained on. They are dealt to a task for every TASK_ROWS, as many at most as run at once; with more than
    one, every level of a tree is one exchange of sums, whose size is that of the bins. No rows: no trees."""

    featuresCol: str = "features"
    labelCol: str = "label"
    maxIter: int = 20
    maxDepth: int = 5
    maxBins: int = 32
    stepSize: float = 0.1
    minInstancesPerNode: int = 1
    seed: int = 42

    def setMaxIter(self, value: int) -> BoostedTrees:
        self.maxIter = value
        return self

    def getMaxIter(self) -> int:
        return self.maxIter

    def getStepSize(self) -> float:
        return self.stepSize

    def limits(self, x: DataFrame, count: int) -> list[list[float]]:
        most = min(self.maxBins, count) - 1
        some = x if count <= SAMPLE else x.sample(fraction=SAMPLE / count, seed=self.seed)

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"k": [key[0]], "limits": [thresholds(rows["v"].to_numpy(), most)]})

        made = some.select(F.posexplode("x").alias("k", "v")).groupBy("k").applyInPandas(run, "k int, limits array<double>")
        return [list(r.limits) for r in sorted(made.collect(), key=lambda r: r.k)]

    def fit(self, df: DataFrame, tasks: int | None = None) -> BoostedModel:
        x = df.select(vector_to_array(F.col(f"`{self.featuresCol}`")).alias("x"), F.col(f"`{self.labelCol}`").cast("double").alias("y"))
        count = x.count()
        if not count:
            return BoostedModel([], self.featuresCol, self.stepSize)
        limits = [np.array(v) for v in self.limits(x, count)]
        widths = [len(v) for v in limits]
        tasks = tasks or min(math.ceil(count / TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)
        rounds, depth, least, rate = self.maxIter, self.maxDepth, self.minInstancesPerNode, self.stepSize

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def add(sums: np.ndarray) -> np.ndarray:
                if tasks == 1:
                    return sums
                told = BarrierTaskContext.get().allGather(base64.b64encode(sums.tobytes()).decode())
                return sum((np.frombuffer(base64.b64decode(v)).reshape(sums.shape) for v in told), np.zeros(sums.shape))

            bins, labels = [np.empty((0, len(widths)), "u1" if max(widths) < 256 else "i4")], [np.array([])]
            for batch in batches:
                rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(widths))
                bins.append(np.stack([bin_of(v, rows[:, k]) for k, v in enumerate(limits)], axis=1).astype(bins[0].dtype))
                labels.append(batch.column(1).to_numpy(zero_copy_only=False) * 2 - 1)
            bins, label = np.concatenate(bins), np.concatenate(labels)
            margin, target, rows = np.zeros(len(label)), label, []
            for number in range(rounds):
                tree, value = grown(bins, target, limits, depth, least, add)
                margin += value * (rate if number else 1.0)
                target = 4 * label / (1 + np.exp(2 * label * margin))
                rows += [(number, node, -1 if f is None else f, 0.0 if f is None else float(limits[f][k]), v) for node, f, k, v in tree]
            if TaskContext.get().partitionId() == 0:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["tree", "node", "feature", "bound", "value"])

        dealt = x.coalesce(1) if tasks == 1 else x.repartition(tasks)
        trees: list[dict] = [{} for _ in range(rounds)]
        for r in dealt.mapInArrow(run, "tree int, node bigint, feature int, bound double, value double", barrier=tasks > 1).collect():
            trees[r.tree][r.node] = (r.feature, r.bound, r.value)
        return BoostedModel(trees, self.featuresCol, self.stepSize)
