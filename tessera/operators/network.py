"""Correlation networks: rolling pair correlations and what follows from them relationally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, TAU = 60, 0.30


def pairs(rets: DataFrame) -> DataFrame:
    """Every pair a < b of a group on every date, by an equi-join on group and date."""
    x = rets.select("grp", "ts", "t_idx", F.col("asset").alias("a"), F.col("r").alias("ra"))
    y = rets.select("grp", "ts", F.col("asset").alias("b"), F.col("r").alias("rb"))
    return x.join(y, ["grp", "ts"]).filter("a < b")


def complete(x: Column, y: Column) -> Column:
    """Both sides are numbers."""
    return x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)


def pair_corr(x, y) -> Column:
    """Pearson correlation, as an aggregate, over the rows on which both sides are numbers; null if a side is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    ok = complete(x, y)
    x, y = F.when(ok, x), F.when(ok, y)
    vary = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))  # a deviation may be a rounding of merged means instead of 0
    return F.when(vary, F.nanvl(F.try_divide(F.try_divide(F.covar_samp(x, y), F.stddev_samp(x)), F.stddev_samp(y)), F.lit(None).cast("double")))


MOMENTS = ("n", "mx", "my", "xx", "yy", "xy")


def co_moments(x: Column, y: Column, part, order) -> dict[str, Column]:
    """State of the rows of a frame that grows from one end: number of complete pairs, both means, both sums of squared
    deviations and the sum of their products.

    Sums are taken of differences from the frame's first complete pair. That pair is one of those summed, so no sum is more
    than n + 1 times what remains of it, and nothing is lost whatever the scale of rows outside the frame."""
    frame = part.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ok = complete(x, y)
    x0, y0 = F.first(F.when(ok, x), ignorenulls=True).over(frame), F.first(F.when(ok, y), ignorenulls=True).over(frame)
    u, v = F.when(ok, x - x0), F.when(ok, y - y0)
    total = lambda c: F.coalesce(F.sum(c).over(frame), F.lit(0.0))
    n = F.count(u).over(frame).cast("double")
    su, sv, each = total(u), total(v), F.greatest(n, F.lit(1.0))
    left = lambda a, b, c: F.when(n > 0, total(a * b) - c).otherwise(0.0)
    return {"n": n, "mx": F.coalesce(x0, F.lit(0.0)) + su / each, "my": F.coalesce(y0, F.lit(0.0)) + sv / each, "xx": left(u, u, su * su / each), "yy": left(v, v, sv * sv / each), "xy": left(u, v, su * sv / each)}


def merged(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """The state of the rows of two states together."""
    n = a["n"] + b["n"]
    share = F.when((a["n"] > 0) & (b["n"] > 0), a["n"] * b["n"] / n).otherwise(0.0)
    dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
    return {"n": n, "xx": a["xx"] + b["xx"] + dx * dx * share, "yy": a["yy"] + b["yy"] + dy * dy * share, "xy": a["xy"] + b["xy"] + dx * dy * share}


def rolling_corr(rets: DataFrame, window: int = WINDOW, inclusive: bool = False) -> DataFrame:
    """grp, ts, t_idx, a, b, rho. Exclusive: the ``window`` rows before the date; inclusive: up to the date. Of the rows of a
    window those count on which both returns are numbers; with fewer than two, or with a constant side, there is no
    correlation (null). Dates without a full window of rows are left out.

    A pair's rows are cut into blocks of ``window`` rows. Any window is the end of one block and the beginning of the next,
    whose states are running aggregates from both ends of the blocks and merge, so a row costs the same whatever the
    window, and rows outside a window leave no trace in it.
    """
    keys = ("grp", "a", "b")
    order, part = Window.partitionBy(*keys).orderBy("t_idx"), Window.partitionBy(*keys, "block")
    p = pairs(rets).withColumn("n_", F.row_number().over(order) - 1).withColumn("block", F.floor(F.col("n_") / window))
    x, y = F.col("ra"), F.col("rb")
    ahead, back = (co_moments(x, y, part, F.col("t_idx").asc()), co_moments(x, y, part, F.col("t_idx").desc()))
    p = p.select("*", *[v.alias(f"p_{k}") for k, v in ahead.items()]).select("*", *[v.alias(f"s_{k}") for k, v in back.items()])
    split = F.col("n_") % window < window - 1  # else the window is the block
    start = {k: F.when(split, F.lag(f"s_{k}", window - 1).over(order)).otherwise(0.0).alias(f"q_{k}") for k in MOMENTS}
    p = p.select("*", *start.values())
    m = merged({k: F.col(f"q_{k}") for k in MOMENTS}, {k: F.col(f"p_{k}") for k in MOMENTS})
    fine = (m["n"] >= 2) & (m["xx"] > 0) & (m["yy"] > 0)
    rho = F.when(fine, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m["xy"] / (F.sqrt(m["xx"]) * F.sqrt(m["yy"])))))
    made = p.select("grp", "ts", "t_idx", "a", "b", "n_", F.when(~F.isnan(rho), rho).alias("rho"))
    if not inclusive:
        made = made.withColumn("rho", F.lag("rho").over(order))
    return made.filter(F.col("n_") >= (window - 1 if inclusive else window)).select("grp", "ts", "t_idx", "a", "b", "rho")


def strided_corr(rets: DataFrame, window: int = WINDOW, stride: int = 20) -> DataFrame:
    """``rolling_corr`` (exclusive) on every ``stride``-th date from the first full window on. The dates are chosen first:
    a row enters only the windows that are kept, ``window`` / ``stride`` of them, and those are aggregated."""
    w, k = F.lit(window), F.lit(stride)
    first = F.greatest(F.lit(0), F.floor((F.col("t_idx") - w) / k) + 1)  # dates w + k j with k j <= t_idx < w + k j
    last = F.floor(F.col("t_idx") / k)
    p = pairs(rets).withColumn("j", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    made = p.groupBy("grp", "a", "b", (F.col("j") * k + w).cast("int").alias("t_idx")).agg(pair_corr("ra", "rb").alias("rho"))
    return made.join(rets.select("grp", "t_idx", "ts").distinct(), ["grp", "t_idx"]).select("grp", "ts", "t_idx", "a", "b", "rho")


def both_ways(edges: DataFrame, *values: str) -> DataFrame:
    return edges.select("grp", "ts", "a", "b", *values).unionByName(edges.select("grp", "ts", F.col("b").alias("a"), F.col("a").alias("b"), *values))


def distance(rho: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - rho)))


def degrees(corr: DataFrame, tau: float = TAU) -> DataFrame:
    """grp, ts, a, deg: summed weight above ``tau`` of every node, 0 where isolated."""
    return both_ways(corr, "rho").groupBy("grp", "ts", "a").agg(F.sum(F.when(F.col("rho") > tau, F.col("rho")).otherwise(0.0)).alias("deg"))


def laplacian_edges(corr: DataFrame, tau: float = TAU, normalized: bool = True) -> DataFrame:
    """grp, ts, a, b, l: off-diagonal entries of the Laplacian for edges above ``tau``, both ways."""
    e = both_ways(corr, "rho").filter(F.col("rho") > tau)
    if not normalized:
        return e.select("grp", "ts", "a", "b", (-F.col("rho")).alias("l"))
    at = lambda node: F.sum("rho").over(Window.partitionBy("grp", "ts", node))
    return e.withColumn("da", at("a")).withColumn("db", at("b")).select("grp", "ts", "a", "b", (-F.col("rho") / F.sqrt(F.col("da") * F.col("db"))).alias("l"))


def network_features(corr: DataFrame) -> DataFrame:
    return corr.groupBy("grp", "ts", "t_idx").agg(F.avg("rho").alias("mean_corr"), F.stddev_pop("rho").alias("std_corr"))


def rng_edges(corr: DataFrame) -> DataFrame:
    """Edges (a, b, d) of the relative neighbourhood graph: no third node nearer to both ends. Ties go by (d, a, b)."""
    d = corr.select("grp", "ts", "a", "b", distance(F.col("rho")).alias("d"))
    full = both_ways(d, "d").withColumn("k", F.struct("d", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")))
    one = full.select("grp", "ts", "a", F.col("b").alias("c"), F.col("k").alias("k1"))
    two = full.select("grp", "ts", F.col("a").alias("b"), F.col("b").alias("c"), F.col("k").alias("k2"))
    blocked = d.withColumn("k", F.struct("d", F.col("a").alias("x"), F.col("b").alias("y"))).join(one, ["grp", "ts", "a"]).join(two, ["grp", "ts", "b", "c"]).filter("k1 < k and k2 < k").select("grp", "ts", "a", "b")
    return d.join(blocked, ["grp", "ts", "a", "b"], "left_anti")


def h1_counts(corr: DataFrame) -> DataFrame:
    """grp, ts, n_assets, h1_count: loops of the full filtration = relative neighbour edges beyond a spanning tree."""
    n = corr.groupBy("grp", "ts").agg(F.expr("cast((1 + sqrt(1 + 8 * count(*))) / 2 as int)").alias("n_assets"))
    return rng_edges(corr).groupBy("grp", "ts").agg(F.count("*").alias("edges")).join(n, ["grp", "ts"]).select("grp", "ts", "n_assets", (F.col("edges") - F.col("n_assets") + 1).cast("int").alias("h1_count"))


def corr_vectors(corr: DataFrame) -> DataFrame:
    """One row a window: assets and the row-major upper triangle of rho, for the dense kernels."""
    return corr.groupBy("grp", "ts").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))).alias("assets"), F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "rho"))), lambda s: s["rho"]).alias("rho"))
