"""Receiver operating characteristic of scores against labels, and DeLong's comparison of two areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(df: DataFrame, score: str, label: str, keys: tuple[str, ...] = ("grp",), width: float = 0.01) -> DataFrame:
    """For each distinct score s of a group: pos and neg (rows of either label), tp and fp (those at s or above), m and n (all).

    Rows with a null or NaN score or a null label take no part. Scores are counted first; running counts go over buckets of
    ``width`` and then inside each bucket, so a long group runs in as many tasks as it has buckets."""
    s = F.col(score)
    rows = df.filter(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull())
    one = rows.groupBy(*keys, s.alias("s")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg")).withColumn("bucket", F.floor(F.col("s") / width))
    higher, group = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    over = one.groupBy(*keys, "bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    over = over.select(*keys, "bucket", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"over_{c}") for c in "pq"], F.sum("p").over(group).alias("m"), F.sum("q").over(group).alias("n"))
    inside = Window.partitionBy(*keys, "bucket").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    made = one.join(over, [*keys, "bucket"])
    return made.select(*keys, "s", "pos", "neg", (F.col("over_p") + F.sum("pos").over(inside)).alias("tp"), (F.col("over_q") + F.sum("neg").over(inside)).alias("fp"), "m", "n")


def curve(counts: DataFrame, keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    """threshold, tpr, fpr of calling positive what scores the threshold or more; a rate without rows is null."""
    return counts.select(*keys, F.col("s").alias("threshold"), F.try_divide("tp", "m").alias("tpr"), F.try_divide("fp", "n").alias("fpr"))


def best(counts: DataFrame, keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    """The threshold with the greatest difference of both rates, ties to the higher one; and the area under the curve."""
    order = F.struct((F.col("tp") * F.col("n") - F.col("fp") * F.col("m")).alias("gain"), "s")
    area = F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2))
    top = counts.groupBy(*keys).agg(F.max_by(F.struct("s", "tp", "fp"), order).alias("x"), F.first("m").alias("m"), F.first("n").alias("n"), area.alias("area"))
    return top.select(*keys, F.col("x.s").alias("threshold"), F.try_divide("x.tp", "m").alias("tpr"), F.try_divide("x.fp", "n").alias("fpr"), F.try_divide(F.col("area"), F.col("m") * F.col("n")).alias("auc"))


def _placement(label: Column, of: str) -> Column:
    """Share of the other label's rows that a row is on the right side of, ties half."""
    c = lambda name: F.col(f"{of}.{name}")
    return F.when(label == 1, F.try_divide(c("n") - c("fp") + c("neg") / 2, c("n"))).otherwise(F.try_divide(c("tp") - c("pos") / 2, c("m")))


def delong(df: DataFrame, a: str, b: str, label: str, keys: tuple[str, ...] = ("grp",), width: float = 0.01) -> DataFrame:
    """auc_a, auc_b, difference, se and z of two scores of the same rows. Rows count that have both scores and a label; z is
    null with fewer than two rows of a label, or where both scores order the rows alike."""
    good = [F.col(c).isNotNull() & ~F.isnan(F.col(c)) for c in (a, b)]
    x = df.filter(good[0] & good[1] & F.col(label).isNotNull()).select(*keys, F.col(a).alias("a_"), F.col(b).alias("b_"), F.col(label).alias("y_"))
    for of, score in (("a", "a_"), ("b", "b_")):
        c = counted(x, score, "y_", keys, width)
        c = c.select(*keys, F.col("s").alias(score), F.struct("pos", "neg", "tp", "fp", "m", "n").alias(of))
        x = x.join(c, [*keys, score])
    x = x.select(*keys, "y_", _placement(F.col("y_"), "a").alias("va"), _placement(F.col("y_"), "b").alias("vb"))
    up, gap = F.col("y_") == 1, F.col("va") - F.col("vb")
    part = lambda which: F.try_divide(F.var_samp(F.when(which, gap)), F.count(F.when(which, gap)))
    g = x.groupBy(*keys).agg(F.avg(F.when(up, F.col("va"))).alias("auc_a"), F.avg(F.when(up, F.col("vb"))).alias("auc_b"), F.sqrt(part(up) + part(~up)).alias("se"))
    difference = F.col("auc_a") - F.col("auc_b")
    return g.select(*keys, "auc_a", "auc_b", difference.alias("difference"), "se", F.try_divide(difference, F.col("se")).alias("z"))
