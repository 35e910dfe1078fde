"""Regressions of many groups at once: sums of products by aggregation, small systems solved on one row a group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.bootstrap import uniform


def two_regressors(x: str, z: str, y: str) -> dict[str, Column]:
    """Aggregates of y on a constant, x and z: n, b0, bx, bz, rss and r2. Where x and z are collinear z is left out."""
    n = F.count("*")
    sxx, szz, sxz = F.var_pop(x) * n, F.var_pop(z) * n, F.covar_pop(x, z) * n
    sxy, szy, syy = F.covar_pop(x, y) * n, F.covar_pop(z, y) * n, F.var_pop(y) * n
    det = sxx * szz - sxz * sxz
    full = det > 1e-10 * sxx * szz
    bx = F.when(full, F.try_divide(sxy * szz - szy * sxz, det)).otherwise(F.try_divide(sxy, sxx))
    bz = F.when(full, F.try_divide(szy * sxx - sxy * sxz, det)).otherwise(F.lit(0.0))
    rss = syy - bx * sxy - bz * szy
    return {"n": n, "b0": F.avg(y) - bx * F.avg(x) - bz * F.avg(z), "bx": bx, "bz": bz, "rss": rss, "r2": 1 - F.try_divide(rss, syy)}


def newey_west(df: DataFrame, y: str, xs: list[str], lags: int = 5, key: str = "grp", order: str = "ts") -> DataFrame:
    """key, n, r2, and arrays beta and t (constant first) of the regression of ``y`` on a constant and ``xs``, with
    Newey-West errors (Bartlett weights). Rows with a null take no part.

    Two passes of aggregation: the sums of products, and the sums of the scores' products with the weighted scores of the
    rows before. Only one row a group is handed to the solver.
    """
    k = len(xs) + 1
    d = df.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(y).cast("double").alias("y"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in xs]).alias("x")).filter(F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    x = F.col("x")
    sums = d.groupBy("key").agg(F.array(*[F.sum(x[i] * x[j]) for i, j in upper]).alias("xx"), F.array(*[F.sum(x[i] * F.col("y")) for i in range(k)]).alias("xy"), F.count("*").alias("n"), (F.var_pop("y") * F.count("*")).alias("syy"), F.sum(F.col("y") * F.col("y")).alias("yy"))

    def square(v) -> np.ndarray:
        a = np.zeros((k, k))
        a[tuple(zip(*upper, strict=True))] = v
        return a + np.triu(a, 1).T

    def inverse(v) -> np.ndarray:
        a = square(v)
        scale = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
        return np.linalg.pinv(a * scale[:, None] * scale) * scale[:, None] * scale

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["beta"] = [(inverse(a) @ np.asarray(b)).tolist() for a, b in zip(f["xx"], f["xy"], strict=True)]
            yield f[["key", "n", "syy", "yy", "xx", "xy", "beta"]]

    kind = dict(d.dtypes)["key"]
    solved = sums.select("key", "n", "syy", "yy", "xx", "xy").mapInPandas(solve, f"key {kind}, n bigint, syy double, yy double, xx array<double>, xy array<double>, beta array<double>")
    u = F.col("y") - F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = d.join(solved.select("key", "beta"), "key").select("key", "at", F.transform("x", lambda v: v * u).alias("s"))
    w = Window.partitionBy("key").orderBy("at")

    def weighted(lag: int, weight: float) -> Column:
        return F.transform(F.lag("s", lag).over(w), lambda v: v * weight)

    v = F.transform("s", lambda x: x * 0.5)
    for lag in range(1, lags + 1):
        b = weighted(lag, 1 - lag / (lags + 1))
        v = F.when(b.isNotNull(), F.zip_with(v, b, lambda p, q: p + q)).otherwise(v)
    meat = scored.withColumn("v", v).groupBy("key").agg(F.array(*[F.sum(F.col("s")[i] * F.col("v")[j] + F.col("v")[i] * F.col("s")[j]) for i, j in upper]).alias("meat"))

    def errors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key_, n, syy, yy, xx, xy, beta, m in zip(*(f[c] for c in ("key", "n", "syy", "yy", "xx", "xy", "beta", "meat")), strict=True):
                inv = inverse(xx)
                se = np.sqrt(np.maximum(np.diag(inv @ square(m) @ inv), 0))
                rss = yy - float(np.dot(beta, xy))
                out.append((key_, n, 1 - rss / syy if syy else None, list(beta), [b / e if e else None for b, e in zip(beta, se, strict=True)]))
            yield pd.DataFrame(out, columns=["key", "n", "r2", "beta", "t"])

    return solved.join(meat, "key").mapInPandas(errors, f"key {kind}, n bigint, r2 double, beta array<double>, t array<double>").withColumnRenamed("key", key)


#: Chance that a Poisson variable of mean 1 is at most 0, 1, 2 and so on, as far as a double tells it from 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)]).tolist()


def poisson_weight(seed: int, *of: str | Column) -> Column:
    """How often a row counts in a resample: a Poisson number of mean 1 that follows from the values of ``of`` alone."""
    u = uniform(seed, *of)
    return sum(((u >= limit).cast("int") for limit in POISSON[1:]), (u >= POISSON[0]).cast("int"))


def bootstrap_breakpoints(df: DataFrame, x: str, y: str, breaks: list[float], reps: int = 1000, seed: int = 42, key: str = "grp", order: str = "ts") -> DataFrame:
    """key, rep (from 0), breakpoint: the break of the best two-part fit of each resample of a group's rows, ties to the first.

    A row counts as often as its own Poisson number says, so no resample is written out and none needs the whole group.
    Rows are summed between two breaks (``breaks`` ascend), by group, repetition and stretch, before anything is shuffled;
    the sums from a break on make its fit. Null and NaN sides take no part; rows with the same order are drawn together; a
    resample without spread has no breakpoint (null). Empty table: no rows.
    """
    rows = df.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    centre = rows.groupBy("key").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))  # sums of products keep their digits
    stretch = sum(((F.col("x") > c).cast("int") for c in breaks), F.lit(0))
    rows = rows.withColumn("stretch", stretch).join(centre, "key").withColumn("x", F.col("x") - F.col("mx")).withColumn("y", F.col("y") - F.col("my"))
    drawn = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("w", poisson_weight(seed, "key", "at", "rep")).filter("w > 0")
    products = {"n": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y")}
    sums = drawn.groupBy("key", "rep", "mx", "stretch").agg(*[F.sum(F.col("w") * v).alias(f"s_{k}") for k, v in products.items()])
    each = sums.select("*", F.posexplode(F.array(*[F.lit(float(c)) for c in breaks])).alias("i", "raw"))
    beyond = F.col("stretch") > F.col("i")
    fits = each.groupBy("key", "rep", "mx", "i", "raw").agg(*[F.sum(f"s_{k}").alias(k) for k in products], *[F.sum(F.when(beyond, F.col(f"s_{k}")).otherwise(0.0)).alias(f"h_{k}") for k in products])
    c = F.col("raw") - F.col("mx")
    n, z = F.col("n"), F.col("h_x") - c * F.col("h_n")
    sxx, syy, sxy = F.col("xx") - F.col("x") * F.col("x") / n, F.col("yy") - F.col("y") * F.col("y") / n, F.col("xy") - F.col("x") * F.col("y") / n
    szz = F.col("h_xx") - 2 * c * F.col("h_x") + c * c * F.col("h_n") - z * z / n
    sxz, szy = F.col("h_xx") - c * F.col("h_x") - F.col("x") * z / n, F.col("h_xy") - c * F.col("h_y") - z * F.col("y") / n
    fits = fits.select("key", "rep", "i", "raw", sxx.alias("sxx"), syy.alias("syy"), sxy.alias("sxy"), szz.alias("szz"), sxz.alias("sxz"), szy.alias("szy"))
    det = F.col("sxx") * F.col("szz") - F.col("sxz") * F.col("sxz")
    both = (F.col("sxy") * (F.col("sxy") * F.col("szz") - F.col("szy") * F.col("sxz")) + F.col("szy") * (F.col("szy") * F.col("sxx") - F.col("sxy") * F.col("sxz")))
    taken = F.when(det > 1e-10 * F.col("sxx") * F.col("szz"), F.try_divide(both, det)).otherwise(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")))
    share = 1 - F.try_divide(taken, F.col("syy"))
    best = fits.groupBy("key", "rep").agg(F.min_by("raw", F.when(share.isNotNull(), F.struct(F.round(share, 10), "i"))).alias("breakpoint"))
    return best.withColumnRenamed("key", key)


def break_rss(x: np.ndarray, y: np.ndarray, breaks: list[float]) -> list[float]:
    """Residual sums of squares of y on a constant, x and max(0, x - c), for every c."""
    out = []
    for c in breaks:
        a = np.column_stack([np.ones(len(x)), x, np.maximum(0, x - c)])
        b = np.linalg.solve(a.T @ a + 1e-12 * np.eye(3), a.T @ y)
        out.append(float(((y - a @ b) ** 2).sum()))
    return out
