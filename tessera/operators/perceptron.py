"""A small network of two classes, trained on a whole table until rows held back stop getting better."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Weights = list[tuple[np.ndarray, np.ndarray]]


def begun(sizes: tuple[int, ...], seed: int) -> Weights:
    """Uniform weights whose spread fits the number of nodes on both sides."""
    rng = np.random.default_rng(seed)
    return [(rng.uniform(-1, 1, (a, b)) * (6 / (a + b)) ** 0.5, rng.uniform(-1, 1, b) * (6 / (a + b)) ** 0.5) for a, b in zip(sizes, sizes[1:], strict=False)]


def outputs(weights: Weights, x: np.ndarray) -> list[np.ndarray]:
    """What every layer gives out, the input first; the last one is the log odds."""
    out = [x]
    for k, (w, b) in enumerate(weights):
        z = out[-1] @ w + b
        out.append(z if k == len(weights) - 1 else np.maximum(z, 0))
    return out


def odds_to_share(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))


def gradient(weights: Weights, x: np.ndarray, y: np.ndarray) -> Weights:
    """Of the log loss summed over the rows."""
    out, made = outputs(weights, x), []
    back = odds_to_share(out[-1]) - y[:, None]
    for k in range(len(weights) - 1, -1, -1):
        made.append((out[k].T @ back, back.sum(axis=0)))
        if k:
            back = (back @ weights[k][0].T) * (out[k] > 0)
    return made[::-1]


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([x.ravel() for pair in weights for x in pair])


def shaped(values: np.ndarray, like: Weights) -> Weights:
    made, at = [], 0
    for pair in like:
        two = []
        for x in pair:
            two.append(values[at : at + x.size].reshape(x.shape))
            at += x.size
        made.append((two[0], two[1]))
    return made


@dataclass
class NetworkModel:
    """The trained weights, the share of held-back rows that every epoch got right, and the epoch whose weights these are."""

    weights: Weights
    features: str
    shares: list[float]
    best: int

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with probability (a vector of both classes) and prediction; null where the features are null."""
        weights = self.weights

        @F.pandas_udf("double")
        def share(rows: pd.Series) -> pd.Series:
            out = np.full(len(rows), np.nan)
            there = rows.notna().to_numpy()
            if there.any():
                out[there] = odds_to_share(outputs(weights, np.stack(rows[there].to_numpy()))[-1][:, 0])
            return pd.Series(out, dtype="Float64").where(there)

        made = df.withColumn("probability", share(_array(df, self.features)))
        p = F.col("probability")
        prediction = F.when(p.isNotNull(), (p > 0.5).cast("double"))
        return made.withColumn("prediction", prediction).withColumn("probability", F.when(p.isNotNull(), array_to_vector(F.array(1 - p, p))))


def _array(df: DataFrame, name: str):
    """The features as an array, whether they are a vector or already one."""
    return F.col(f"`{name}`") if dict(df.dtypes)[name].startswith("array") else F.when(F.col(f"`{name}`").isNotNull(), vector_to_array(F.col(f"`{name}`")))


@dataclass
class EarlyStoppedNetwork:
    """Hidden layers of ``hidden`` nodes (rectified), a logistic end, steps by Adam, a penalty on squared weights.

    A tenth of the rows (``held``), told by a hash of their values, is held back. An epoch goes through the others in
    ``batches`` batches, dealt anew by a hash each time. A step is one job: every partition sums the gradient of its rows of
    the batch, the sums are added up by weight, and the driver gets one number a weight. The first step of an epoch also
    counts what the weights of the epoch before get right of the rows held back. After ``patience`` epochs in a row that do
    not raise the best share by ``tolerance``, or ``epochs``, training ends; the best epoch's weights are taken (the
    earliest of equal ones). Rows with a null feature vector or label take no part; repeated rows fall into the same batch; without rows to
    hold back, all epochs run and the last weights are taken; without rows at all, the first weights stay."""

    featuresCol: str = "features"
    labelCol: str = "label"
    hidden: tuple[int, ...] = (16, 8)
    epochs: int = 500
    batches: int = 4
    rate: float = 0.001
    penalty: float = 1e-4
    held: float = 0.1
    patience: int = 10
    tolerance: float = 1e-4
    seed: int = 42
    decay: tuple[float, float] = field(default=(0.9, 0.999))

    def fit(self, df: DataFrame) -> NetworkModel:
        x = df.select(_array(df, self.featuresCol).alias("x"), F.col(f"`{self.labelCol}`").cast("double").alias("y")).filter("x is not null and y is not null")
        place = F.pmod(F.xxhash64(F.lit(self.seed), "x"), F.lit(1 << 20)) / float(1 << 20)
        x = x.withColumn("kept", place < self.held).persist()
        try:
            first = x.select(F.size("x").alias("n")).first()
            if first is None:
                return NetworkModel(begun((1, *self.hidden, 1), self.seed), self.featuresCol, [], 0)
            return self._trained(x, begun((first.n, *self.hidden, 1), self.seed))
        finally:
            x.unpersist()

    def _trained(self, x: DataFrame, weights: Weights) -> NetworkModel:
        size = flat(weights).size
        shrink = flat([(np.ones_like(w), np.zeros_like(b)) for w, b in weights])
        mean, square, step = np.zeros(size), np.zeros(size), 0
        shares, best, best_epoch, worse = [], weights, 0, 0
        for epoch in range(self.epochs + 1):
            for batch in range(self.batches):
                got = self._sums(x, weights, epoch, batch)
                if batch == 0 and epoch and got[size + 2]:
                    shares.append(got[size + 1] / got[size + 2])
                    top = max(shares[:-1], default=-np.inf)
                    worse = worse + 1 if shares[-1] < top + self.tolerance else 0
                    if shares[-1] > top:
                        best, best_epoch = weights, epoch
                    if worse > self.patience:
                        return NetworkModel(best, self.featuresCol, shares, best_epoch)
                if epoch == self.epochs:
                    break
                if got[size] == 0:
                    continue
                step += 1
                now = flat(weights)
                g = (got[:size] + self.penalty * shrink * now) / got[size]
                mean = self.decay[0] * mean + (1 - self.decay[0]) * g
                square = self.decay[1] * square + (1 - self.decay[1]) * g * g
                pace = self.rate * (1 - self.decay[1] ** step) ** 0.5 / (1 - self.decay[0] ** step)
                weights = shaped(now - pace * mean / (np.sqrt(square) + 1e-8), weights)
        return NetworkModel(best if shares else weights, self.featuresCol, shares, best_epoch if shares else self.epochs)

    def _sums(self, x: DataFrame, weights: Weights, epoch: int, batch: int) -> np.ndarray:
        """The gradient over the batch, its number of rows, and of the rows held back (asked with the first batch of an epoch)
        how many are right and how many there are."""
        size = flat(weights).size

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + 3)
            for part in parts:
                if not part.num_rows:
                    continue
                rows, y = np.stack(part.column(0).to_numpy(zero_copy_only=False)), part.column(1).to_numpy()
                kept = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                if (~kept).any():
                    total[:size] += flat(gradient(weights, rows[~kept], y[~kept]))
                total[size] += (~kept).sum()
                total[size + 1] += ((outputs(weights, rows[kept])[-1][:, 0] > 0) == (y[kept] > 0.5)).sum()
                total[size + 2] += kept.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 3, dtype="i4")), pa.array(total)], names=["k", "v"])

        own = F.pmod(F.xxhash64(F.lit(self.seed + 1), F.lit(epoch), "x"), F.lit(self.batches)) == batch
        wanted = x.filter((~F.col("kept") & own) | (F.col("kept") & F.lit(batch == 0)))
        out = np.zeros(size + 3)
        for k, v in wanted.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v")).collect():  # one row a weight
            out[k] = v
        return out
