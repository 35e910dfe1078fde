import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import scan
from tessera.operators.permute import shuffled_place

KIND = "grp string, t_idx long, r double, block_ string"


def lines():
    """Two long lines with gaps in order and values, a return of -1 at the end of one, a line of one row, one without values."""
    rng = np.random.default_rng(3)
    rows = []
    for g, n in (("long", 300), ("short", 41)):
        for t in sorted(rng.choice(5 * n, n, replace=False).tolist()):
            rows.append((g, t - 50, None if rng.random() < 0.2 else float(rng.normal(0, 0.2)), "x"))
    rows[-1] = (*rows[-1][:2], -1.0, "x")
    return [*rows, ("one", 7, 0.5, None), ("none", 1, None, None), ("none", 2, None, None)]


def walked(rows, step, out):
    """``out`` of the state that ``step`` makes of the state before and the row, row by row."""
    made, held = {}, {}
    for g, t, r, _ in sorted(rows, key=lambda x: x[:2]):
        held[g] = step(held.get(g), r, t)
        made[g, t] = out(held[g])
    return made


def same(made, want):
    assert set(made) == set(want)
    for k, v in want.items():
        assert (made[k] is None) == (v is None) and (v is None or made[k] == pytest.approx(v, abs=1e-12)), k


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_blocks_are_a_plain_walk(spark, size):
    rows = lines()
    df = spark.createDataFrame(rows, KIND).repartition(5)
    by = lambda d, c: {(r.grp, r.t_idx): r[c] for r in d.collect()}

    def grown(s, r, _):
        cum, top = s or (None, None)
        if r is not None:
            cum = (1 + r) * (1 if cum is None else cum)
        return (cum, cum if top is None else max(top, cum))

    same(by(scan.equity(df, "r", size=size), "cum"), walked(rows, grown, lambda s: s[0]))
    d = scan.drawdown(df, "r", size=size)
    assert d.columns == [*df.columns, "cum", "dd"] and d.count() == len(rows)
    same(by(d, "dd"), walked(rows, grown, lambda s: None if s[0] is None else s[0] / s[1] - 1))
    set_on = F.when(F.col("t_idx") % 5 == 0, F.col("r"))
    same(by(scan.hold(df, set_on, "v", size=size), "v"), walked(rows, lambda s, r, t: r if t % 5 == 0 and r is not None else s, lambda s: s))
    step = lambda s, r, _: s if r is None else r if s is None else 0.85 * r + 0.15 * s
    same(by(scan.recurrence(df, "r", 0.85, 0.15, "v", size=size), "v"), walked(rows, step, lambda s: s))
    drift = lambda s, r, _: s if r is None else r if s is None else r + s
    same(by(scan.recurrence(df.withColumnRenamed("r", "s"), "s", 1.0, 1.0, "s0", size=size), "s0"), walked(rows, drift, lambda s: s))
    order = {k: 0 for k in {x[0] for x in rows}}
    places = {}
    for g, t, *_ in sorted(rows, key=lambda x: x[:2]):
        places[g, t] = order[g]
        order[g] += 1
    same(by(scan.place(df, "n", size=size), "n"), places)


def test_scans_of_nothing_and_of_nulls(spark):
    empty = spark.createDataFrame([], KIND)
    assert all(d.count() == 0 for d in (scan.equity(empty, "r"), scan.drawdown(empty, "r"), scan.hold(empty, F.col("r"), "v"), scan.recurrence(empty, "r", 0.5, 0.5, "v"), scan.place(empty, "n")))
    lost = spark.createDataFrame([(None, 1, 0.5, "a"), ("g", None, 0.5, "b"), ("g", 1, float("nan"), "c"), ("g", 2, 0.5, "d")], KIND)
    made = {r.block_: r.cum for r in scan.equity(lost, "r", size=1).collect()}
    assert made["a"] is None and made["b"] is None and math.isnan(made["c"]) and math.isnan(made["d"])


def test_a_long_line_is_not_one_task(spark):
    """No exchange gathers rows by the group alone, but for the ends of its blocks."""
    df = spark.range(20_000).select(F.lit("g").alias("grp"), F.col("id").alias("t_idx"), F.lit(1e-4).alias("r"))
    plan = scan.equity(df, "r", size=1000)
    text = plan._jdf.queryExecution().executedPlan().toString()
    by_group = [x for x in text.splitlines() if "Exchange hashpartitioning(grp#" in x and "block_" not in x]
    assert len(by_group) <= 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        last = plan.withColumn("task", F.spark_partition_id()).agg(F.max_by("cum", "t_idx"), F.count_distinct("task")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert last[0] == pytest.approx(1.0001**20_000, rel=1e-9) and last[1] > 1


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 97, 150, 1000, 4097])
def test_places_are_shuffled_one_to_one(spark, n):
    of = spark.range(n).select("id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rep"))
    made = of.select("id", "rep", shuffled_place(F.col("id"), F.lit(n), 42, "rep").alias("to")).toPandas().sort_values(["rep", "id"])
    orders = [tuple(v) for _, v in made.groupby("rep")["to"]]
    assert all(sorted(x) == list(range(n)) for x in orders)
    if n >= 97:
        assert len(set(orders)) == 6
        for x in orders:  # no trace of the old order
            assert abs(np.corrcoef(x, range(n))[0, 1]) < 5 / math.sqrt(n)


def test_every_permutation_of_few_places_occurs_about_as_often(spark):
    reps = 12_000
    of = spark.range(4).select("id", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    to = of.withColumn("to", shuffled_place(F.col("id"), F.lit(4), 1, "rep")).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("id", "to"))).alias("x"))
    seen = [r["count"] for r in to.groupBy(F.transform("x", lambda s: s["to"]).alias("p")).count().collect()]
    assert len(seen) == 24 and sum((c - reps / 24) ** 2 / (reps / 24) for c in seen) < 60  # 23 degrees of freedom
