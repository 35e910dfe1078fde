"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, forget


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours the least of its neighbourhood and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns ``node`` and ``root``, the least node of its component, for every node with a link to another.

    Links with a null end and loops are left out; repeated links count once. Rows per round are the links of the round;
    minima are taken before the shuffle and the joins are by node against one row a node, so a hub with very many
    links is split like any skewed join. The links are written to the shared folder every round; the driver sees two
    numbers a round. No links: no rows.
    """
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    e = edges.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    now, seen = cut(e.distinct(), "links"), None
    while True:
        sign = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if sign[0] == 0 or sign == seen:
            break
        seen, before = sign, now
        now = cut(_small_star(_large_star(now).distinct()).distinct(), "links")
        forget(before)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
