"""Sharpe ratios with their errors: a stationary block bootstrap, and the errors that follow from autocorrelation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR, NORMAL_975 = 252, 1.959963984540054


def uniform(seed: int, *of: str | Column) -> Column:
    """A number from 0 to below 1 that follows from the values of ``of`` alone, so that a lost task is made anew alike."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 53)).cast("double") / float(1 << 53)


def placed(df: DataFrame, r: str, keys: tuple[str, ...], order: str) -> DataFrame:
    """keys, place (from 0), r, n and mean of the group, and the running sums s1, s2 of r - mean and its square.

    Null and NaN returns take no part. Centred first, the running sums stay near zero and their differences keep their
    digits."""
    rows = df.filter(F.col(r).isNotNull() & ~F.isnan(F.col(r))).select(*keys, order, F.col(r).cast("double").alias("r"))
    group, line = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    x = rows.withColumn("n", F.count("*").over(group)).withColumn("mean", F.avg("r").over(group)).withColumn("place", F.row_number().over(line).cast("long") - 1)
    off, past = F.col("r") - F.col("mean"), line.rowsBetween(Window.unboundedPreceding, 0)
    return x.select(*keys, "place", "r", "n", "mean", F.sum(off).over(past).alias("s1"), F.sum(off * off).over(past).alias("s2"))


def draws(rows: DataFrame, reps: int = 1000, length: float = 20.0, seed: int = 42, keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    """keys, n, rep (from 1), place, start: the blocks of every repetition. A block begins at place 0 and, with probability
    1 / ``length``, at any other; it takes the rows from ``start`` on, round the end, until the next block begins."""
    every = rows.select(*keys, "n", "place", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    begins = every.filter((F.col("place") == 0) | (uniform(seed, *keys, "rep", "place") < 1 / length))
    return begins.select(*keys, "n", "rep", "place", F.floor(uniform(seed + 1, *keys, "rep", "place") * F.col("n")).alias("start"))


def sharpe_bootstrap(df: DataFrame, r: str = "r", reps: int = 1000, length: float = 20.0, seed: int = 42, keys: tuple[str, ...] = ("grp",), order: str = "t_idx", year: int = YEAR) -> DataFrame:
    """keys, rep, sharpe of every repetition; null where a resample does not vary. Empty table: no rows.

    Resamples are never written out. A block is a stretch of the series (two where it goes round the end), and its sums
    are differences of the running sums at its ends: what is shuffled are the ends of n / ``length`` blocks a repetition,
    by group and place, so neither a long group nor a repetition is in one task."""
    rows = placed(df, r, keys, order)
    blocks = draws(rows, reps, length, seed, keys)
    until = F.lead("place", 1).over(Window.partitionBy(*keys, "rep").orderBy("place"))
    end = F.col("start") + F.coalesce(until, F.col("n")) - F.col("place")
    blocks = blocks.withColumn("end", end).withColumn("around", F.col("end") > F.col("n"))
    point = lambda k, sign: F.struct(k.cast("long").alias("k"), F.lit(sign).alias("sign"))
    whole = F.when(F.col("around"), F.array(point(F.col("n"), 1))).otherwise(F.array().cast("array<struct<k:bigint,sign:int>>"))
    last = F.when(F.col("around"), F.col("end") - F.col("n")).otherwise(F.col("end"))
    ends = blocks.select(*keys, "rep", F.explode(F.concat(F.array(point(F.col("start"), -1), point(last, 1)), whole)).alias("e")).select(*keys, "rep", "e.k", "e.sign")
    ends = ends.filter("k > 0").groupBy(*keys, "k", "rep").agg(F.sum("sign").alias("times")).filter("times <> 0")
    sums = ends.join(rows.select(*keys, (F.col("place") + 1).alias("k"), "s1", "s2"), [*keys, "k"])
    sums = sums.groupBy(*keys, "rep").agg(F.sum(F.col("times") * F.col("s1")).alias("t1"), F.sum(F.col("times") * F.col("s2")).alias("t2"))
    size = rows.filter("place = 0").select(*keys, "n", "mean", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    x = size.join(sums, [*keys, "rep"], "left").select(*keys, "rep", "n", "mean", F.coalesce("t1", F.lit(0.0)).alias("t1"), F.coalesce("t2", F.lit(0.0)).alias("t2"))
    left = F.try_divide(F.col("t2") - F.col("t1") * F.col("t1") / F.col("n"), F.col("n") - 1)
    ratio = (F.col("mean") + F.col("t1") / F.col("n")) / F.sqrt(F.when(left > 1e-12 * F.col("t2") / F.col("n"), left))
    return x.select(*keys, "rep", (ratio * year**0.5).alias("sharpe"))


def sharpe_interval(df: DataFrame, r: str = "r", lags: int = 5, keys: tuple[str, ...] = ("grp",), order: str = "t_idx", year: int = YEAR) -> DataFrame:
    """keys, n, sharpe, se_iid, se, low, high: the yearly ratio, its error for independent returns and the one that counts
    autocorrelation up to ``lags`` rows (Bartlett weights), and the 95 % interval by the latter.

    The error is that of the mean of each row's influence on the ratio, z - sharpe (z^2 - 1) / 2 for standardised returns z.
    Null and NaN returns take no part; a constant series has no ratio, a single row neither."""
    rows = df.filter(F.col(r).isNotNull() & ~F.isnan(F.col(r))).select(*keys, order, F.col(r).cast("double").alias("r"))
    of = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"))
    z = F.try_divide(F.col("r") - F.col("mean"), F.col("sd"))
    x = rows.join(of, [*keys]).withColumn("sr", F.try_divide("mean", "sd")).withColumn("u", z - F.col("sr") / 2 * (z * z - 1))
    line = Window.partitionBy(*keys).orderBy(order)
    near = sum((F.coalesce(F.lag("u", k).over(line), F.lit(0.0)) * (1 - k / (lags + 1)) for k in range(1, lags + 1)), F.lit(0.0))
    g = x.withColumn("near", near).groupBy(*keys).agg(F.first("n").alias("n"), F.first("sr").alias("sr"), F.sum(F.col("u") * (F.col("u") + 2 * F.col("near"))).alias("v"))
    n, scale = F.col("n"), year**0.5
    se = F.sqrt(F.greatest(F.col("v"), F.lit(0.0))) / n * scale
    iid = F.when(F.col("sr").isNotNull(), F.sqrt((1 + F.col("sr") * F.col("sr") / 2) / n)) * scale
    s = F.col("sr") * scale
    error = F.when(F.col("sr").isNotNull(), se)
    return g.select(*keys, "n", s.alias("sharpe"), iid.alias("se_iid"), error.alias("se"), (s - NORMAL_975 * error).alias("low"), (s + NORMAL_975 * error).alias("high"))
