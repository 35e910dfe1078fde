"""Performance measures of return series (columns grp, ts, t_idx, r)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.rolling import equity, in_order, so_far

YEAR = 252


def with_equity(s: DataFrame) -> DataFrame:
    cum = s.withColumn("cum", equity(F.col("r")))
    return cum.withColumn("dd", F.col("cum") / F.max("cum").over(so_far()) - 1)


def performance(s: DataFrame, keys=("grp",), year: int = YEAR) -> DataFrame:
    """n, ann_ret, ann_vol, sharpe, total_ret, cagr, max_dd, calmar, hit_daily. Undefined ratios are null."""
    out = with_equity(s).groupBy(*keys).agg(
        F.count("r").alias("n"), (F.avg("r") * year).alias("ann_ret"), (F.stddev_samp("r") * F.sqrt(F.lit(float(year)))).alias("ann_vol"),
        (F.try_divide(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.lit(float(year)))).alias("sharpe"), (F.max_by("cum", "t_idx") - 1).alias("total_ret"),
        (F.pow(F.max_by("cum", "t_idx"), F.lit(float(year)) / F.count("r")) - 1).alias("cagr"), F.min("dd").alias("max_dd"), F.avg((F.col("r") > 0).cast("double")).alias("hit_daily"),
    )
    return out.withColumn("calmar", F.coalesce(F.try_divide(F.col("cagr"), F.abs("max_dd")), F.lit(0.0)))


def turnover(positions: DataFrame, year: int = YEAR) -> DataFrame:
    """``positions``: grp, t_idx, pos. Switches, their number a year, time in the market."""
    d = positions.withColumn("step", F.abs(F.col("pos") - F.lag("pos").over(in_order())))
    return d.groupBy("grp").agg(F.sum("step").alias("total_turnover"), F.count(F.when(F.col("step") > 0, 1)).alias("switches"), (F.sum("step") / (F.count("*") / year)).alias("turnover_year"), F.avg("pos").alias("in_market"))
