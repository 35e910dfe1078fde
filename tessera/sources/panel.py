"""Long-format price panels (grp, asset, ts, px) and the shaping that turns them into returns."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Training ends here for panels of 1995 to 2001.
TRAIN_END = "1998-12-31"
#: Rows up to which a table of keys may be sent to every task.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(keyed: DataFrame) -> DataFrame:
    """A table that facts are joined to by its key. Beyond BROADCAST_ROWS rows both sides are dealt by the key, however small
    its file is, as a broadcast would pass it whole through the driver."""
    return keyed.hint("shuffle_hash") if keyed.count() > BROADCAST_ROWS else keyed


def fetch(read: Callable[[object], DataFrame], assets: Iterable, tries: int = 3, wait: float = 0.0) -> tuple[DataFrame | None, list]:
    """The assets' tables as one, and the assets of which none came: ``read`` raised or gave no row ``tries`` times, with
    ``wait`` seconds between. No asset at all: None."""
    got, failed = None, []
    for asset in assets:
        for attempt in range(tries):
            try:
                one = read(asset)
                if not one.isEmpty():
                    got = one if got is None else got.unionByName(one)
                    break
            except (OSError, PySparkException):
                pass
            if wait and attempt + 1 < tries:
                time.sleep(wait)
        else:
            failed.append(asset)
    return got, failed


def bars(events: DataFrame, unit: str, grp, asset, ts, value) -> DataFrame:
    """Mean of ``value`` per group, asset and calendar unit."""
    return events.groupBy(grp.alias("grp"), asset.alias("asset"), F.date_trunc(unit, ts).alias("ts")).agg(F.avg(value).alias("px"))


def ship_brand(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """25 brands in 5 blocks; price is the mean extended price of what was shipped."""
    block = F.concat(F.lit("B"), F.floor((F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") - 1) / 5).cast("string"))
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", block.alias("block")))  # read from the name once a part, not once a row
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return bars(rows, unit, F.col("block"), F.col("p_brand"), F.col("l_shipdate"), F.col("l_extendedprice"))


def ship_type(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """Six part types in one group."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice").join(spread(table(spark, sf_dir, "part").select("p_partkey", "p_type")), F.col("l_partkey") == F.col("p_partkey"))
    return bars(rows, unit, F.lit("ALL"), F.col("p_type"), F.col("l_shipdate"), F.col("l_extendedprice"))


def nation(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """Nations by region; price is the mean order total."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return bars(rows, unit, F.col("r_name"), F.col("n_name"), F.col("o_orderdate"), F.col("o_totalprice"))


def event_bars(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """Bars of ``minutes`` from the event stream: mean and last value, number of events."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.lit("ALL").alias("grp"), F.col("event_type").alias("asset"), F.window("ts", f"{minutes} minutes")["start"].alias("ts")).agg(F.avg("value").alias("px"), F.max_by("value", F.struct("ts", "event_id")).alias("last_px"), F.count("*").alias("n"))


def coverage(panel: DataFrame, share: float = 0.8) -> DataFrame:
    """Assets priced on more than ``share`` of their group's dates."""
    dates = panel.groupBy("grp").agg(F.count_distinct("ts").alias("dates"))
    held = panel.filter("px is not null").groupBy("grp", "asset").agg(F.count("*").alias("held"))
    return held.join(dates, "grp").filter(F.col("held") > share * F.col("dates")).select("grp", "asset")


def forward_fill(panel: DataFrame) -> DataFrame:
    """Every asset on every date of its group; gaps take the last price before them."""
    grid = panel.select("grp", "ts").distinct().join(panel.select("grp", "asset").distinct(), "grp")
    before = Window.partitionBy("grp", "asset").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(panel.select("grp", "asset", "ts", "px"), ["grp", "asset", "ts"], "left").withColumn("px", F.last("px", ignorenulls=True).over(before))


def complete_dates(panel: DataFrame) -> DataFrame:
    """Dates on which every asset of the group has a price."""
    n = panel.groupBy("grp").agg(F.count_distinct("asset").alias("n"))
    full = panel.groupBy("grp", "ts").agg(F.count("px").alias("c")).join(n, "grp").filter("c = n").select("grp", "ts")
    return panel.join(full, ["grp", "ts"], "left_semi")


def clean(panel: DataFrame, share: float = 0.8) -> DataFrame:
    return complete_dates(forward_fill(panel.join(coverage(panel, share), ["grp", "asset"], "left_semi")))


def returns(panel: DataFrame, log: bool = True) -> DataFrame:
    """grp, asset, ts, t_idx (0, 1, ... on the group's calendar), r; the first date has no return and is left out."""
    w = Window.partitionBy("grp", "asset").orderBy("ts")
    ratio = F.try_divide(F.col("px"), F.lag("px").over(w))
    r = F.ln(ratio) if log else ratio - 1
    return panel.withColumn("r", r).withColumn("t_idx", (F.row_number().over(w) - 2).cast("int")).filter("t_idx >= 0").select("grp", "asset", "ts", "t_idx", "r")
