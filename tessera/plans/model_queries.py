"""Generators, sinks and reports, classification (G, S, M, U)."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.operators import rolling as R
from tessera.operators import spectral as S
from tessera.operators.boosting import BoostedTrees
from tessera.operators.metrics import performance
from tessera.operators.network import network_features
from tessera.plans.network_queries import TAU, cv_and_rho, vectors
from tessera.plans.oracle import EW, FEATURES, base
from tessera.plans.panel_queries import CUM, RV, clean, corr, ew, r6, realized_vol, ret, scratch, shared
from tessera.plans.registry import query as q
from tessera.plans.strategy_queries import POS, fiedler, held, regime, sharpe, t_p, train
from tessera.sources import panel as P

RET = base()
INPUTS = ["mean_corr", "std_corr", "lap_lambda1", "lap_lambda2", "lap_gap", "fiedler", "rv"]


_BAR_SQL = RET + " SELECT grp, asset, ts, round(px, 4) AS px FROM panel"


def _through(s, df, name, write, read):
    path = scratch(s, name)
    write(df.write, path)
    return read(path)


@q("s04", _BAR_SQL)
def s04(s, d):
    """Bars as delimited text with a header, read with a declared schema, sorted by nothing: order is not part of data."""
    p = clean(s, d)
    return _through(s, p, "bars", lambda w, x: w.option("header", True).csv(x), lambda x: s.read.schema(p.schema).option("header", True).csv(x)).select("grp", "asset", "ts", r6("px", n=4))


@q("s06", _BAR_SQL)
def s06(s, d):
    """A wide file, a date index and a column for each asset, read by declared types and made long again."""
    p = clean(s, d).select(F.concat_ws("|", "grp", "asset").alias("name"), "ts", "px")
    names = sorted(r[0] for r in p.select("name").distinct().collect())  # the assets: the columns of the file
    if not names:
        return s04(s, d)
    wide = p.groupBy("ts").pivot("name", names).agg(F.first("px")).orderBy("ts")
    path = scratch(s, "wide")
    wide.write.option("header", True).csv(path)
    back = s.read.schema(wide.schema).option("header", True).csv(path)
    long = back.select("ts", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"`{n}`") for n in names]))).alias("name", "px")).filter("px is not null")
    return long.select(F.split_part("name", F.lit("|"), F.lit(1)).alias("grp"), F.split_part("name", F.lit("|"), F.lit(2)).alias("asset"), "ts", r6("px", n=4))


@q("s07", RET + " SELECT grp, asset, t_idx, round(r, 6) AS r FROM ret")
def s07(s, d):
    x = ret(s, d).select("grp", "asset", "t_idx", "r")
    return _through(s, x, "returns", lambda w, p: w.partitionBy("grp").parquet(p), lambda p: s.read.schema(x.schema).parquet(p)).select("grp", "asset", "t_idx", r6("r"))


@q("s08", RET + EW + " SELECT grp, count(*) AS n, round(avg(r), 6) AS mean FROM ew GROUP BY 1")
def s08(s, d):
    x = ew(s, d).groupBy("grp").agg(F.count("*").alias("n"), r6("mean", F.avg("r")))
    return _through(s, x, "results", lambda w, p: w.json(p), lambda p: s.read.schema(x.schema).json(p))


@q("s09")
def s09(s, d):
    """Rows of a typeset table, best Sharpe ratio first."""
    p = performance(ew(s, d)).select("grp", "sharpe", "max_dd")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("sharpe").desc(), "grp"))
    return p.select(place.alias("line"), F.concat(F.col("grp"), F.lit(" & "), F.format_number("sharpe", 3), F.lit(" & "), F.format_number("max_dd", 3), F.lit(" \\\\")).alias("tex"))


COSTS = (0, 5, 15, 25)
_TABLE31 = (
    RET + POS + ", n AS (SELECT grp, bps, (avg(pnl) * 252 - sum(step) * bps / 1e4 / (count(pnl) / 252.0)) / (stddev_samp(pnl) * sqrt(252)) AS s"
    " FROM st, (SELECT unnest([0, 5, 15, 25]) AS bps) GROUP BY 1, 2), t AS (SELECT grp, sum(step) / (count(*) / 252.0) * 100 AS turn"
    " FROM st GROUP BY 1)"
)


@q("s10", _TABLE31 + " SELECT t.grp, printf('%-15s %10.0f %+8.2f %+8.2f %+8.2f %+8.2f', t.grp, turn, max(s) FILTER (WHERE bps = 0),"
    " max(s) FILTER (WHERE bps = 5), max(s) FILTER (WHERE bps = 15), max(s) FILTER (WHERE bps = 25)) AS line FROM t JOIN n USING (grp)"
    " GROUP BY t.grp, turn")
def s10(s, d):
    """Lines of the cost table: yearly turnover in percent, Sharpe ratios before costs and at 5, 15 and 25 basis points."""
    x = held(s, d).groupBy("grp").agg((F.sum("step") / (F.count("*") / 252) * 100).alias("turn"), *[F.try_divide(F.avg("pnl") * 252 - F.sum("step") * c / 1e4 / (F.count("pnl") / 252), F.stddev_samp("pnl") * F.sqrt(F.lit(252.0))).alias(f"s{c}") for c in COSTS])
    return x.select("grp", F.format_string("%-15s %10.0f %+8.2f %+8.2f %+8.2f %+8.2f", "grp", "turn", *[f"s{c}" for c in COSTS]).alias("line"))


@q("s10_performance")
def s10_performance(s, d):
    """Lines of the performance table: mean correlation, spread of loop lifetimes, Sharpe ratio, CAGR, drawdown, p, status."""
    f = cv_and_rho(s, d).groupBy("grp").agg(F.avg("mean_corr").alias("rho"), F.avg("h1_cv").alias("cv"))
    p = performance(ew(s, d)).withColumn("p", t_p(F.col("sharpe") * F.sqrt(F.col("n") / 252), F.col("n") - 1))
    status = F.when((F.col("sharpe") > 0.15) & (F.col("p") < 0.05), "Success").when(F.col("sharpe") > 0, "Marginal").otherwise("Failed")
    x = p.join(f, "grp", "left").withColumn("status", status)
    line = F.format_string("%-15s %8.2f %8.2f %+7.2f %+7.1f%% %7.1f%% %10.4f %-10s", "grp", "rho", "cv", "sharpe", F.col("cagr") * 100, F.col("max_dd") * 100, "p", "status")
    return x.select("grp", "status", line.alias("line"))


_TABLE30 = RET + EW + ", h AS (SELECT grp, ts <= TIMESTAMP '1998-12-31' AS early, avg(r) / stddev_samp(r) * sqrt(252) AS s FROM ew GROUP BY 1, 2)"


@q("s10_periods", _TABLE30 + " SELECT grp, printf('%-15s', grp) || coalesce(printf('%+8.2f', max(s) FILTER (WHERE early)), '     ---') ||"
    " coalesce(printf('%+8.2f', max(s) FILTER (WHERE NOT early)), '     ---') AS line FROM h GROUP BY grp")
def s10_periods(s, d):
    """Lines of the table of two periods; a period without the group shows dashes."""
    x = ew(s, d).groupBy("grp", train().alias("early")).agg(sharpe().alias("s"))
    one = lambda early: F.coalesce(F.when(F.max(F.when(F.col("early") == early, F.col("s"))).isNotNull(), F.format_string("%+8.2f", F.max(F.when(F.col("early") == early, F.col("s"))))), F.lit("     ---"))
    return x.groupBy("grp").agg(one(True).alias("a"), one(False).alias("b")).select("grp", F.concat(F.format_string("%-15s", "grp"), "a", "b").alias("line"))


@q("s11", RET + CUM + " SELECT grp, ts, round(cum, 6) AS cum, round(dd, 6) AS dd FROM dd")
def s11(s, d):
    """The table behind the equity and drawdown panels."""
    from tessera.operators.metrics import with_equity

    return with_equity(ew(s, d)).select("grp", "ts", r6("cum"), r6("dd"))


def _simulated(s, make, reps, schema):
    """``make(rng, rep)`` returns a frame; every repetition has a generator seeded by its number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for rep in f["id"].tolist():
                yield make(np.random.default_rng([42, rep]), rep)

    return s.range(reps).repartition(min(reps, 8)).mapInPandas(run, schema)


def _frame(x, rep):
    t, n = x.shape
    return pd.DataFrame({"rep": rep, "t_idx": np.repeat(np.arange(t), n), "asset": np.tile(np.arange(n), t), "r": x.ravel()})


_SIM = "rep bigint, t_idx bigint, asset bigint, r double"


@q("g01")
def g01(s, d):
    def make(rng, rep, n=10, t=250, rho=0.5):
        c = np.clip(rho + rng.normal(0, 0.1, (n, n)), 0.2, 0.9)
        c = (c + c.T) / 2
        np.fill_diagonal(c, 1.0)
        return _frame(rng.normal(0, 0.01, (t, n)) @ np.linalg.cholesky(K.nearest_correlation(c)).T, rep)

    return _simulated(s, make, 4, _SIM)


@q("g02")
def g02(s, d):
    def make(rng, rep, n=8, t=1000):
        parts, at, stress = [], 0, 0
        while at < t:
            k = int(min(rng.integers(100, 300), t - at))
            rho, vol = ((0.35, 0.20), (0.75, 0.40))[stress]
            x = np.sqrt(rho) * rng.normal(size=(k, 1)) + np.sqrt(1 - rho) * rng.normal(size=(k, n))
            f = _frame(x * vol / np.sqrt(252), rep).assign(regime=stress)
            parts.append(f.assign(t_idx=f["t_idx"] + at))
            at, stress = at + k, 1 - stress
        return pd.concat(parts)

    return _simulated(s, make, 2, _SIM + ", regime bigint")


@q("g03")
def g03(s, d):
    def make(rng, rep, n=20):
        load = np.sqrt(0.2 + 0.15 * rep) + rng.normal(0, 0.05, n)
        c = np.outer(load, load)
        np.fill_diagonal(c, 1.0)
        c = K.nearest_correlation(c)
        i, j = np.triu_indices(n, 1)
        return pd.DataFrame({"rep": rep, "a": i, "b": j, "rho": c[i, j]})

    return _simulated(s, make, 4, "rep bigint, a bigint, b bigint, rho double")


def normal(row, seed):
    """A standard normal number that depends on ``row`` and ``seed`` alone, so on no partitioning."""
    unit = lambda k: (F.pmod(F.xxhash64(row, F.lit(seed), F.lit(k)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.ln(unit(0))) * F.cos(2 * np.pi * unit(1))


@q("g04")
def g04(s, d):
    """Market factor plus noise of its own for every asset, without Python."""
    days = s.range(500).select(F.col("id").alias("t_idx"), (0.01 * normal(F.col("id"), 42)).alias("m"))
    return days.withColumn("asset", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("t_idx", "asset", (F.col("m") + 0.01 * normal(F.col("t_idx") * 10 + F.col("asset"), 43)).alias("r"))


@q("g05", RET + EW + ", b AS (SELECT grp, ts, r + CASE WHEN ts BETWEEN TIMESTAMP '1996-02-01'"
    " AND TIMESTAMP '1996-04-01' THEN 0.5 WHEN ts BETWEEN TIMESTAMP '1999-03-01' AND TIMESTAMP '1999-03-31' THEN 0.35 ELSE 0 END AS x"
    " FROM ew) SELECT grp, ts, round(greatest(0, (x - avg(x) OVER (PARTITION BY grp)) / stddev_samp(x)"
    " OVER (PARTITION BY grp) * 0.15 + 0.45), 6) AS v FROM b")
def g05(s, d):
    """A series with bumps in two crisis windows, scaled to mean 0.45 and deviation 0.15, then cut at 0."""
    w = Window.partitionBy("grp")
    within = lambda a, b: F.col("ts").between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))
    bump = F.when(within("1996-02-01", "1996-04-01"), 0.5).when(within("1999-03-01", "1999-03-31"), 0.35).otherwise(0.0)
    x = ew(s, d).withColumn("x", F.col("r") + bump)
    v = F.try_divide(F.col("x") - F.avg("x").over(w), F.stddev_samp("x").over(w)) * 0.15 + 0.45
    return x.select("grp", "ts", r6("v", F.greatest(F.lit(0.0), v)))


@q("g06")
def g06(s, d):
    r = F.lit(0.79) * 0.01 / F.sqrt(F.lit(252.0)) + 0.01 * normal(F.col("id"), 44)
    return s.range(500).select(F.lit("x").alias("grp"), F.col("id").alias("t_idx"), r.alias("r")).withColumn("cum", R.equity(F.col("r")))


def dataset(s, d):
    """Features of the window before the day, the day's return, and whether the next day's is positive. Rows are in order:
    what learners draw and add up would otherwise change with the shuffle. Features have nine digits: values that are equal
    but for rounding, as of a network in parts, would else be parted by the order in which a sum was made."""

    def build():
        f = network_features(corr(s, d)).join(S.spectra(vectors(s, d), TAU).drop("corr_lambda1", "corr_gap", "eff_rank"), ["grp", "ts"]).join(realized_vol(ret(s, d)).select("grp", "ts", "rv"), ["grp", "ts"])
        e = ew(s, d).withColumn("next_ret", F.lead("r").over(R.in_order())).select("grp", "ts", "next_ret").filter("next_ret is not null")
        return f.join(e, ["grp", "ts"]).withColumn("target", (F.col("next_ret") > 0).cast("int")).dropna(subset=INPUTS).withColumns({c: F.round(c, 9) for c in INPUTS}).orderBy("grp", "ts")

    return shared("dataset", s, d, build)


def split(s, d):
    """Training and test rows. Their scaled features are a written table: a learner runs hundreds of jobs, and the plan below
    its rows is sent along with every task."""

    def build():
        x = VectorAssembler(inputCols=INPUTS, outputCol="raw").transform(dataset(s, d))
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(x.filter(train()))
        return scaler.transform(x).select("grp", "ts", "target", "next_ret", "features")

    x = shared("scaled", s, d, build)
    return x.filter(train()), x.filter(~train())


#: Rows of the data set; the spectra exist wherever the correlations do.
_DATASET_SQL = (
    base(upto="corr") + FEATURES + EW + RV + ", nx AS (SELECT grp, ts, lead(r) OVER (PARTITION BY grp ORDER BY t_idx) AS next_ret FROM ew), ds AS (SELECT f.grp, f.ts"
    " FROM feat f JOIN rv ON f.grp = rv.grp AND f.ts = rv.ts JOIN nx ON f.grp = nx.grp AND f.ts = nx.ts WHERE next_ret IS NOT NULL"
    " AND mean_corr IS NOT NULL AND std_corr IS NOT NULL AND rv IS NOT NULL)"
)


@q("m01")
def m01(s, d):
    return dataset(s, d).select("grp", "ts", *[r6(c) for c in INPUTS], "target")


@q("m02", _DATASET_SQL + " SELECT ts <= TIMESTAMP '1998-12-31' AS train, count(*) AS n, min(ts) AS first, max(ts) AS last FROM ds GROUP BY 1")
def m02(s, d):
    return dataset(s, d).groupBy(train().alias("train")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@q("m03")
def m03(s, d):
    fit, test = split(s, d)
    return test.select("grp", "ts", F.transform(vector_to_array("features"), lambda v: F.round(v, 6)).cast("string").alias("scaled"))


def learners():
    return {
        "forest": RandomForestClassifier(labelCol="target", numTrees=200, maxDepth=8, minInstancesPerNode=20, seed=42),
        "boosting": BoostedTrees(labelCol="target", maxIter=200, maxDepth=3, stepSize=0.05, seed=42),
        "network": MultilayerPerceptronClassifier(labelCol="target", layers=[len(INPUTS), 16, 8, 2], maxIter=50, seed=42),
    }


def predicted(s, d, name):
    fit, test = split(s, d)
    model = learners()[name].fit(fit)
    return model.transform(test).select("grp", "ts", "target", "next_ret", F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability")[1].alias("score"))


@q("m04")
def m04(s, d):
    return predicted(s, d, "forest")


@q("m05")
def m05(s, d):
    return predicted(s, d, "boosting")


@q("m06")
def m06(s, d):
    return predicted(s, d, "network")


def measures(x, keys=()):
    """Confusion counts and rank-sum AUC by aggregation; undefined ratios are 0. Sharpe of the positions +1 and -1."""
    # ranks from the counts of 4096 buckets in score order and the ranks inside each, so no task sees all rows
    x = x.withColumn("b", F.floor((F.atan("score") / np.pi + 0.5) * 4096).cast("int"))
    sizes = x.groupBy(*keys, "b").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    x = x.join(F.broadcast(sizes.select(*keys, "b", F.coalesce(before, F.lit(0)).alias("before"))), [*keys, "b"])  # at most 4096 rows a key
    rk = F.col("before") + F.rank().over(Window.partitionBy(*keys, "b").orderBy("score")) + (F.count("*").over(Window.partitionBy(*keys, "b", "score")) - 1) / 2
    x = x.withColumn("rk", rk).withColumn("pnl", F.when(F.col("predicted") == 1, F.col("next_ret")).otherwise(-F.col("next_ret")))
    both = lambda p, t: F.count(F.when((F.col("predicted") == p) & (F.col("target") == t), 1))
    g = x.groupBy(*keys).agg(both(1, 1).alias("tp"), both(1, 0).alias("fp"), both(0, 1).alias("fn"), both(0, 0).alias("tn"), F.sum(F.when(F.col("target") == 1, F.col("rk"))).alias("rs"), F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")).alias("sh"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    pos, neg = tp + fn, fp + tn
    return g.select(*keys, r6("precision", zero(tp, tp + fp)), r6("recall", zero(tp, pos)), r6("f1", zero(2 * tp, 2 * tp + fp + fn)), r6("accuracy", zero(tp + tn, pos + neg)), r6("auc", zero(F.col("rs") - pos * (pos + 1) / 2, pos * neg)), r6("sharpe", F.col("sh") * F.sqrt(F.lit(252.0))))


_M07 = RET + EW + """, l AS (SELECT grp, round(r, 9) AS score, (r > 0)::INT AS predicted, lead(r) OVER (PARTITION BY grp ORDER BY t_idx) AS nx FROM ew), x AS (SELECT *, (nx > 0)::INT AS target,
 rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS rk, CASE WHEN predicted = 1 THEN nx ELSE -nx END AS pnl FROM l WHERE nx IS NOT NULL),
c AS (SELECT grp, count_if(predicted = 1 AND target = 1)::DOUBLE AS tp, count_if(predicted = 1 AND target = 0)::DOUBLE AS fp, count_if(predicted = 0 AND target = 1)::DOUBLE AS fn, count_if(predicted = 0 AND target = 0)::DOUBLE AS tn,
 sum(rk) FILTER (WHERE target = 1) AS rs, avg(pnl) / stddev_samp(pnl) AS sh FROM x GROUP BY 1)
SELECT grp, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
 round((rs - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (fp + tn)), 6) AS auc, round(sh * sqrt(252), 6) AS sharpe FROM c"""


@q("m07", _M07)
def m07(s, d):
    x = ew(s, d).withColumn("next_ret", F.lead("r").over(R.in_order())).filter("next_ret is not null")
    return measures(x.select("grp", F.round("r", 9).alias("score"), (F.col("r") > 0).cast("int").alias("predicted"), "next_ret", (F.col("next_ret") > 0).cast("int").alias("target")), ("grp",))


@q("m08")
def m08(s, d):
    weights = learners()["forest"].fit(split(s, d)[0]).featureImportances.toArray().tolist()
    return s.createDataFrame(list(zip(INPUTS, weights, strict=True)), "feature string, importance double").orderBy(F.col("importance").desc())


@q("m09")
def m09(s, d):
    """The learners train side by side, as each is a long row of small jobs; what they predict is written once."""
    split(s, d)  # written before they start
    jobs = [inheritable_thread_target(s)(lambda name=name: shared(f"predicted {name}", s, d, lambda: predicted(s, d, name))) for name in learners()]
    with ThreadPoolExecutor(len(jobs)) as pool:
        made = list(pool.map(lambda job: job(), jobs))
    out = None
    for name, x in zip(learners(), made, strict=True):
        one = measures(x).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    rule = regime(fiedler(s, d), "fiedler", 0.25, above=False).withColumnRenamed("flag", "predicted").join(dataset(s, d).select("grp", "ts", "target", "next_ret"), ["grp", "ts"]).filter(~train()).withColumn("score", F.lit(0.5))
    return out.unionByName(measures(rule).withColumn("model", F.lit("threshold")))


@q("u01", RET + EW + " SELECT grp, ts, CASE WHEN count(r) OVER w >= 20 THEN round(max(r) OVER w - min(r) OVER w, 6) END AS spread"
    " FROM ew WINDOW w AS (PARTITION BY grp ORDER BY t_idx ROWS 19 PRECEDING)")
def u01(s, d):
    """A function of the caller's own over each rolling window, as an aggregate over the collected frame."""
    w = R.past(20)
    own = lambda a: F.array_max(a) - F.array_min(a)
    return ew(s, d).select("grp", "ts", r6("spread", R.full(own(F.collect_list("r").over(w)), F.col("r"), w, 20)))
