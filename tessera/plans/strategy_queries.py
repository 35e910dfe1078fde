"""Aggregates, joins, inference and strategies (A, J, H, X)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import kernels as K
from tessera.operators import bootstrap as Boot
from tessera.operators import metrics as M
from tessera.operators import regression as G
from tessera.operators import roc as C
from tessera.operators import rolling as R
from tessera.operators import spectral as S
from tessera.operators.network import pair_corr
from tessera.plans.network_queries import LAP, TAU, _diffuse, cv_and_rho, diagrams, h1, residuals, vectors
from tessera.plans.oracle import EW, FEATURES, H1, base
from tessera.plans.panel_queries import CUM, RV, best_groups, corr, ew, factors, r6, ranked, realized_vol, ret, shared
from tessera.plans.registry import query as q
from tessera.sources import panel as P

RET, COR = base(), base(upto="corr")
TRAIN = "TIMESTAMP '1998-12-31'"
SQ = "sqrt(252)"


def train():
    return F.col("ts") <= F.lit(P.TRAIN_END).cast("timestamp_ntz")


def sharpe(c="r"):
    return F.try_divide(F.avg(c), F.stddev_samp(c)) * F.sqrt(F.lit(252.0))


@q("a01", RET + " SELECT grp, asset, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(min(r), 6) AS low,"
    " round(max(r), 6) AS high, round(quantile_cont(r, 0.5), 6) AS median FROM ret GROUP BY 1, 2")
def a01(s, d):
    return ret(s, d).groupBy("grp", "asset").agg(F.count("r").alias("n"), r6("mean", F.avg("r")), r6("std", F.stddev_samp("r")), r6("low", F.min("r")), r6("high", F.max("r")), r6("median", F.percentile("r", F.lit(0.5))))


@q("a02", RET + EW + f" SELECT grp, round(quantile_cont(r, 0.75), 6) AS p75, round(quantile_cont(r, 0.25), 6) AS p25 FROM ew WHERE ts <= {TRAIN} GROUP BY 1")
def a02(s, d):
    return ew(s, d).filter(train()).groupBy("grp").agg(r6("p75", F.percentile("r", F.lit(0.75))), r6("p25", F.percentile("r", F.lit(0.25))))


@q("a03", RET + " SELECT grp, round(avg(r), 6) AS mean FROM ret GROUP BY 1 ORDER BY mean")
def a03(s, d):
    return ret(s, d).groupBy("grp").agg(r6("mean", F.avg("r"))).orderBy("mean")


@q("a04", RET + " SELECT grp, year(ts)::INT AS year, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, count(*) AS n FROM ret GROUP BY 1, 2")
def a04(s, d):
    return ret(s, d).groupBy("grp", F.year("ts").alias("year")).agg(r6("mean", F.avg("r")), r6("std", F.stddev_samp("r")), F.count("*").alias("n"))


@q("a05", RET + " SELECT grp, count(DISTINCT asset) AS assets, count(DISTINCT ts) AS dates, round(min(r), 6) AS low, round(max(r), 6) AS high FROM ret GROUP BY 1")
def a05(s, d):
    return ret(s, d).groupBy("grp").agg(F.count_distinct("asset").alias("assets"), F.count_distinct("ts").alias("dates"), r6("low", F.min("r")), r6("high", F.max("r")))


@q("a06", RET + EW + " SELECT grp, CASE WHEN r > 0.02 THEN 'up' WHEN r < -0.02 THEN 'down' ELSE 'flat' END AS regime, count(*) AS n, round(count(*) /"
    " sum(count(*)) OVER (PARTITION BY grp), 6) AS share, round(avg(r), 6) AS mean FROM ew GROUP BY 1, 2")
def a06(s, d):
    x = F.when(F.col("r") > 0.02, "up").when(F.col("r") < -0.02, "down").otherwise("flat")
    g = ew(s, d).groupBy("grp", x.alias("regime")).agg(F.count("*").alias("n"), F.avg("r").alias("m"))
    return g.select("grp", "regime", "n", r6("share", F.col("n") / F.sum("n").over(Window.partitionBy("grp"))), r6("mean", F.col("m")))


BETA = (
    ", mk AS (SELECT grp, ts, avg(r) AS m FROM ret GROUP BY 1, 2), beta AS (SELECT r.grp, r.asset, coalesce(covar_samp(r, m) /"
    " nullif(var_samp(m), 0), 1.0) AS beta FROM ret r JOIN mk ON r.grp = mk.grp AND r.ts = mk.ts{where} GROUP BY 1, 2)"
)


def betas(rets):
    mk = rets.groupBy("grp", "ts").agg(F.avg("r").alias("m"))
    return rets.join(mk, ["grp", "ts"]).groupBy("grp", "asset").agg(F.coalesce(F.try_divide(F.covar_samp("r", "m"), F.var_samp("m")), F.lit(1.0)).alias("beta"))


@q("a07", RET + BETA.format(where="") + " SELECT grp, asset, round(beta, 6) AS beta FROM beta")
def a07(s, d):
    return betas(ret(s, d)).select("grp", "asset", r6("beta"))


@q("a08", RET + EW + f" SELECT grp, round(avg(r) / stddev_samp(r) * {SQ}, 6) AS sharpe, round(avg(r) / stddev_pop(r) * {SQ}, 6) AS sharpe_pop FROM ew GROUP BY 1")
def a08(s, d):
    return ew(s, d).groupBy("grp").agg(r6("sharpe", sharpe()), r6("sharpe_pop", F.try_divide(F.avg("r"), F.stddev_pop("r")) * F.sqrt(F.lit(252.0))))


PERF = (
    ", perf AS (SELECT grp, count(r) AS n, avg(r) * 252 AS ann_ret, stddev_samp(r) * sqrt(252) AS ann_vol, avg(r) / stddev_samp(r) *"
    " sqrt(252) AS sharpe, arg_max(cum, t_idx) - 1 AS total_ret, pow(arg_max(cum, t_idx), 252.0 / count(r)) - 1 AS cagr,"
    " min(dd) AS max_dd, avg((r > 0)::INT) AS hit_daily FROM dd GROUP BY grp)"
)


@q("a09", RET + CUM + PERF + " SELECT grp, round(total_ret, 6) AS total_ret, round(ann_ret, 6) AS ann_ret, round(cagr, 6) AS cagr FROM perf")
def a09(s, d):
    return M.performance(ew(s, d)).select("grp", r6("total_ret"), r6("ann_ret"), r6("cagr"))


@q("a10", RET + CUM + PERF + " SELECT grp, round(max_dd, 6) AS max_dd FROM perf")
def a10(s, d):
    return M.performance(ew(s, d)).select("grp", r6("max_dd"))


@q("a11", RET + EW + ", m AS (SELECT grp, date_trunc('month', ts) AS m, sum(r) AS r FROM ew GROUP BY 1, 2) SELECT grp, round(avg((r > 0)::INT), 6) AS hit FROM m GROUP BY 1")
def a11(s, d):
    return ew(s, d).groupBy("grp", F.date_trunc("month", "ts")).agg(F.sum("r").alias("r")).groupBy("grp").agg(r6("hit", F.avg((F.col("r") > 0).cast("double"))))


@q("a12", RET + CUM + PERF + " SELECT grp, round(hit_daily, 6) AS hit FROM perf")
def a12(s, d):
    return M.performance(ew(s, d)).select("grp", r6("hit", F.col("hit_daily")))


@q("a13", RET + CUM + PERF + " SELECT grp, round(cagr / abs(max_dd), 6) AS calmar FROM perf")
def a13(s, d):
    return M.performance(ew(s, d)).select("grp", r6("calmar"))


POS = (
    EW + ", pos AS (SELECT *, last_value(CASE WHEN t_idx % 5 = 0 THEN (r > 0)::INT END IGNORE NULLS)"
    " OVER (PARTITION BY grp ORDER BY t_idx ROWS UNBOUNDED PRECEDING) AS pos FROM ew), st AS (SELECT *, abs(pos - lag(pos)"
    " OVER (PARTITION BY grp ORDER BY t_idx)) AS step, lag(pos) OVER (PARTITION BY grp ORDER BY t_idx) * r AS pnl FROM pos)"
)


def held(s, d):
    p = ew(s, d).withColumn("pos", R.hold((F.col("r") > 0).cast("int"), F.col("t_idx"), 5))
    w = R.in_order()
    return p.withColumn("step", F.abs(F.col("pos") - F.lag("pos").over(w))).withColumn("pnl", F.lag("pos").over(w) * F.col("r"))


@q("a14", RET + POS + " SELECT grp, sum(step)::BIGINT AS total_turnover, count_if(step > 0)::BIGINT AS switches, round(sum(step) / (count(*) / 252.0)"
    ", 6) AS turnover_year, round(avg(pos), 6) AS in_market FROM st GROUP BY 1")
def a14(s, d):
    return M.turnover(held(s, d)).select("grp", F.col("total_turnover").cast("bigint"), "switches", r6("turnover_year"), r6("in_market"))


@q("a15", RET + POS + ", sc AS (SELECT unnest([0, 5, 15, 25]) AS bps) SELECT grp, bps, round((avg(pnl) * 252 -"
    " sum(step) * bps / 1e4 / (count(pnl) / 252.0)) / (stddev_samp(pnl) * sqrt(252)), 6) AS net_sharpe FROM st, sc GROUP BY 1, 2")
def a15(s, d):
    x = held(s, d).withColumn("bps", F.explode(F.array(*map(F.lit, (0, 5, 15, 25)))))
    net = F.avg("pnl") * 252 - F.sum("step") * F.first("bps") / 1e4 / (F.count("pnl") / 252)
    return x.groupBy("grp", "bps").agg(r6("net_sharpe", F.try_divide(net, F.stddev_samp("pnl") * F.sqrt(F.lit(252.0)))))


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of t with ``df`` degrees of freedom, null where either is."""
    return pd.Series([None if a != a or b != b or b <= 0 else float(K.t_two_sided(a, b)) for a, b in zip(t.astype(float), df.astype(float), strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def z_p(z: pd.Series) -> pd.Series:
    return pd.Series([None if a != a else float(K.normal_two_sided(a)) for a in z.astype(float)], dtype="float64")


@q("a16", RET + EW + " SELECT grp, count(r) AS n, round(avg(r) / (stddev_samp(r) / sqrt(count(r))), 6) AS t FROM ew GROUP BY 1 HAVING count(r) > 30")
def a16(s, d):
    return ew(s, d).groupBy("grp").agg(F.count("r").alias("n"), r6("t", F.try_divide(F.avg("r") * F.sqrt(F.count("r")), F.stddev_samp("r")))).filter("n > 30")


@q("a16_p")
def a16_p(s, d):
    return a16(s, d).select("grp", "t", F.round(t_p("t", F.col("n") - 1), 6).alias("p"))


@q("a17", RET + POS + f" SELECT grp, round(avg(pnl) / stddev_samp(pnl) * {SQ}, 6) AS strategy, round(avg(r) / stddev_samp(r) * {SQ}, 6) AS hold FROM st"
    f" WHERE pnl IS NOT NULL GROUP BY 1")
def a17(s, d):
    return held(s, d).filter("pnl is not null").groupBy("grp").agg(r6("strategy", sharpe("pnl")), r6("hold", sharpe()))


@q("a18", RET + EW + ", m AS (SELECT grp, avg(r) AS m, stddev_pop(r) AS s FROM ew GROUP BY 1) SELECT e.grp, round(avg(pow((r - m) / s, 3)), 6) AS skew,"
    " round(avg(pow((r - m) / s, 4)) - 3, 6) AS kurt FROM ew e JOIN m ON e.grp = m.grp GROUP BY 1")
def a18(s, d):
    return ew(s, d).groupBy("grp").agg(r6("skew", F.skewness("r")), r6("kurt", F.kurtosis("r")))


@q("a19", RET + EW + ", b AS (SELECT grp, CASE WHEN r < -0.3 THEN 0 WHEN r >= 0.3 THEN 31 ELSE floor((r + 0.3) / 0.02)::INT + 1 END AS bin FROM ew)"
    " SELECT grp, bin::BIGINT AS bin, count(*) AS n FROM b GROUP BY 1, 2")
def a19(s, d):
    r = F.col("r")
    b = F.when(r < -0.3, 0).when(r >= 0.3, 31).otherwise(F.floor((r + 0.3) / 0.02).cast("int") + 1)
    return ew(s, d).groupBy("grp", b.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@q("a20", RET + EW + ", n AS (SELECT count(DISTINCT grp) AS n FROM ew) SELECT ts, round(avg(r), 6) AS r FROM ew, n GROUP BY ts, n HAVING count(*) = n")
def a20(s, d):
    return portfolio(s, d).select("ts", r6("r"))


def portfolio(s, d):
    e = ew(s, d)
    n = e.agg(F.count_distinct("grp").alias("n"))
    return e.groupBy("ts").agg(F.avg("r").alias("r"), F.count("*").alias("c")).join(F.broadcast(n), F.col("c") == F.col("n")).select("ts", "r")


PORT = ", n AS (SELECT count(DISTINCT grp) AS n FROM ew), port AS (SELECT ts, avg(r) AS r FROM ew, n GROUP BY ts, n HAVING count(*) = n)"


@q("a21", RET + EW + PORT + f", one AS (SELECT avg(r) / stddev_samp(r) * {SQ} AS s FROM ew GROUP BY grp) SELECT round((SELECT avg(r) / stddev_samp(r) * {SQ}"
    f" FROM port), 6) AS portfolio, round(avg(s), 6) AS single, round((SELECT avg(r) / stddev_samp(r) * {SQ} FROM port) - avg(s)"
    f", 6) AS benefit FROM one")
def a21(s, d):
    one = ew(s, d).groupBy("grp").agg(sharpe().alias("s")).agg(F.avg("s").alias("single"))
    return portfolio(s, d).agg(sharpe().alias("p")).join(F.broadcast(one)).select(r6("portfolio", F.col("p")), r6("single"), r6("benefit", F.col("p") - F.col("single")))


@q("j01", COR + FEATURES + EW + " SELECT e.grp, e.ts, round(e.r, 6) AS r, round(mean_corr, 6) AS mean_corr FROM ew e JOIN feat f ON e.grp = f.grp AND e.ts = f.ts")
def j01(s, d):
    from tessera.operators.network import network_features

    return ew(s, d).join(network_features(corr(s, d)), ["grp", "ts"]).select("grp", "ts", r6("r"), r6("mean_corr"))


@q("j02", RET + EW + PORT + " SELECT ts FROM port")
def j02(s, d):
    return portfolio(s, d).select("ts")


@q("j03", RET + EW + ", l AS (SELECT *, lead(r) OVER (PARTITION BY grp ORDER BY t_idx) AS nxt FROM ew) SELECT grp, ts, round(r, 6) AS r"
    ", (nxt > 0)::INT AS target FROM l WHERE nxt IS NOT NULL")
def j03(s, d):
    nxt = ew(s, d).select("grp", (F.col("t_idx") - 1).alias("t_idx"), F.col("r").alias("nxt"))
    return ew(s, d).join(nxt, ["grp", "t_idx"]).select("grp", "ts", r6("r"), (F.col("nxt") > 0).cast("int").alias("target"))


FAC = (
    ", f AS (SELECT date_trunc('week', l_shipdate)::TIMESTAMP AS ts, avg(l_discount) AS mkt FROM lineitem GROUP BY 1)"
    ", g AS (SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS ts, avg(o_totalprice) / 1e6 AS umd FROM orders GROUP BY 1)"
)


@q("j04", RET + FAC + " SELECT f.ts, round(mkt, 6) AS mkt, round(umd, 6) AS umd FROM f JOIN g ON f.ts = g.ts")
def j04(s, d):
    a, b = factors(s, d)
    return a.join(b, "ts").select("ts", r6("mkt"), r6("umd"))


@q("j05", RET + FAC + " SELECT coalesce(f.ts, g.ts) AS ts, round(mkt, 6) AS mkt, round(umd, 6) AS umd FROM f FULL JOIN g ON f.ts = g.ts")
def j05(s, d):
    a, b = factors(s, d)
    return a.join(b, "ts", "full").select("ts", r6("mkt"), r6("umd"))


@q("j06", RET + " SELECT 'a' AS part, grp, count(*) AS n FROM ret GROUP BY 2 UNION ALL SELECT 'b', asset, count(*) FROM ret GROUP BY 2")
def j06(s, d):
    x = ret(s, d)
    return x.groupBy("grp").count().select(F.lit("a").alias("part"), "grp", F.col("count").alias("n")).unionByName(x.groupBy("asset").count().select(F.lit("b").alias("part"), F.col("asset").alias("grp"), F.col("count").alias("n")))


@q("j07", RET + EW + FAC + " SELECT grp, e.ts, round(r - mkt, 6) AS excess FROM ew e LEFT JOIN f ON e.ts = f.ts WHERE mkt IS NOT NULL")
def j07(s, d):
    return ew(s, d).join(factors(s, d)[0], "ts", "left").filter("mkt is not null").select("grp", "ts", r6("excess", F.col("r") - F.col("mkt")))


@q("j08", COR + FEATURES + EW + " SELECT e.grp, e.ts, coalesce((mean_corr > 0.05)::INT, 0) AS flag FROM ew e LEFT JOIN feat f ON e.grp = f.grp AND e.ts = f.ts")
def j08(s, d):
    from tessera.operators.network import network_features

    return ew(s, d).join(network_features(corr(s, d)), ["grp", "ts"], "left").select("grp", "ts", F.coalesce((F.col("mean_corr") > 0.05).cast("int"), F.lit(0)).alias("flag"))


@q("j09", RET + " SELECT x.grp, x.ts, x.asset AS a, y.asset AS b, round(x.r * y.r, 8) AS product FROM ret x JOIN ret y ON x.grp = y.grp AND x.ts = y.ts AND x.asset < y.asset")
def j09(s, d):
    from tessera.operators.network import pairs

    return pairs(ret(s, d)).select("grp", "ts", "a", "b", r6("product", F.col("ra") * F.col("rb"), 8))


@q("j10", "WITH a AS (SELECT DISTINCT n_regionkey AS k FROM nation WHERE n_nationkey < 12), b AS (SELECT DISTINCT n_regionkey AS k"
    " FROM nation WHERE n_nationkey > 20) SELECT coalesce(a.k, b.k)::BIGINT AS k, coalesce(a.k::VARCHAR, '---') AS x,"
    " coalesce(b.k::VARCHAR, '---') AS y FROM a FULL JOIN b ON a.k = b.k")
def j10(s, d):
    n = P.table(s, d, "nation")
    a, b = n.filter("n_nationkey < 12").select(F.col("n_regionkey").alias("a")).distinct(), n.filter("n_nationkey > 20").select(F.col("n_regionkey").alias("b")).distinct()
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").cast("bigint").alias("k"), F.coalesce(F.col("a").cast("string"), F.lit("---")).alias("x"), F.coalesce(F.col("b").cast("string"), F.lit("---")).alias("y"))


@q("j11", RET + EW + " SELECT grp, ts, round(lag(r) OVER (PARTITION BY grp ORDER BY t_idx), 6) AS signal, round(r, 6) AS r FROM ew QUALIFY lag(r)"
    " OVER (PARTITION BY grp ORDER BY t_idx) IS NOT NULL")
def j11(s, d):
    before = ew(s, d).select("grp", (F.col("t_idx") + 1).alias("t_idx"), F.col("r").alias("signal"))
    return ew(s, d).join(before, ["grp", "t_idx"]).select("grp", "ts", r6("signal"), r6("r"))


@q("j12", RET + EW + ", c AS (SELECT unnest([0, 5, 15, 25]) AS bps) SELECT grp, bps, round(sum(r) - count(*) * bps / 1e4, 6) AS net FROM ew, c GROUP BY 1, 2")
def j12(s, d):
    x = ew(s, d).withColumn("bps", F.explode(F.array(*map(F.lit, (0, 5, 15, 25)))))
    return x.groupBy("grp", "bps").agg(r6("net", F.sum("r") - F.count("*") * F.first("bps") / 1e4))


def rho_ret(s, d):
    from tessera.operators.network import network_features

    return network_features(corr(s, d)).join(ew(s, d).select("grp", "ts", "r"), ["grp", "ts"])


RR = FEATURES + EW + ", rr AS (SELECT f.grp, f.ts, mean_corr, std_corr, r FROM feat f JOIN ew e ON f.grp = e.grp AND f.ts = e.ts)"


@q("h00")
def h00(s, d):
    rows = [("t", 2.0, 10.0, K.t_two_sided(2.0, 10)), ("t", 1.0, 1.0, K.t_two_sided(1.0, 1)), ("f", 4.0, 12.0, K.f_upper(4.0, 2, 12)), ("z", 1.96, 0.0, K.normal_two_sided(1.96))]
    return s.createDataFrame(rows, "kind string, x double, df double, p double").withColumn("p", F.round("p", 8))


@q("h01", COR + RR + " SELECT grp, round(corr(mean_corr, r), 6) AS r, count(*) AS n FROM rr GROUP BY 1")
def h01(s, d):
    return rho_ret(s, d).groupBy("grp").agg(r6("r", F.corr("mean_corr", "r")), F.count("*").alias("n"))


@q("h01_p")
def h01_p(s, d):
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    return h01(s, d).select("grp", "r", F.round(t_p(t, F.col("n") - 2), 6).alias("p"))


SPLIT = (
    ", s AS (SELECT grp, count_if({c})::BIGINT AS n1, count_if(NOT ({c}))::BIGINT AS n2, avg(r) FILTER (WHERE {c}) AS m1,"
    " avg(r) FILTER (WHERE NOT ({c})) AS m2, var_samp(r) FILTER (WHERE {c}) AS v1, var_samp(r) FILTER (WHERE NOT ({c})) AS v2 FROM rr"
    " GROUP BY 1)"
)


def split(x, cond):
    a, b = F.when(cond, F.col("r")), F.when(~cond, F.col("r"))
    return x.groupBy("grp").agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))


@q("h02", COR + RR + SPLIT.format(c="mean_corr > 0.0") + " SELECT grp, n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t FROM s")
def h02(s, d):
    return split(rho_ret(s, d), F.col("mean_corr") > 0).select("grp", "n1", "n2", r6("t", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")))))


@q("h03", COR + RR + SPLIT.format(c="mean_corr < 0.0") + " SELECT grp, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS t FROM s")
def h03(s, d):
    v = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    return split(rho_ret(s, d), F.col("mean_corr") < 0).select("grp", r6("t", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(v * (1 / F.col("n1") + 1 / F.col("n2"))))))


SCAN = (
    ", th AS (SELECT k, -0.10 + 0.02 * k AS c FROM range(11) v(k)), sc AS (SELECT grp, k,"
    " avg(r) FILTER (WHERE mean_corr < c) / stddev_samp(r) FILTER (WHERE mean_corr < c) -"
    " avg(r) FILTER (WHERE mean_corr >= c) / stddev_samp(r) FILTER (WHERE mean_corr >= c) AS diff"
    ", count_if(mean_corr < c)::BIGINT AS n1, count_if(mean_corr >= c)::BIGINT AS n2 FROM rr, th GROUP BY 1, 2)"
)


@q("h04", COR + RR + SCAN + " SELECT grp, k::INT AS k, n1, n2, round(diff, 6) AS diff, coalesce(row_number() OVER (PARTITION BY grp ORDER BY round(diff"
    ", 9) DESC NULLS LAST, k) = 1, FALSE) AS best FROM sc WHERE n1 >= 2 AND n2 >= 2")
def h04(s, d):
    x = rho_ret(s, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10))))
    low = F.col("mean_corr") < F.lit(-0.10) + 0.02 * F.col("k")
    a, b = F.when(low, F.col("r")), F.when(~low, F.col("r"))
    g = x.groupBy("grp", "k").agg(F.count(a).alias("n1"), F.count(b).alias("n2"), (F.try_divide(F.avg(a), F.stddev_samp(a)) - F.try_divide(F.avg(b), F.stddev_samp(b))).alias("diff"))
    first = F.row_number().over(Window.partitionBy("grp").orderBy(F.round("diff", 9).desc_nulls_last(), "k"))
    return g.filter("n1 >= 2 and n2 >= 2").select("grp", "k", "n1", "n2", r6("diff"), (first == 1).alias("best"))


CHOW = (
    ", s AS (SELECT *, (mean_corr > 0)::INT AS side FROM rr), a AS (SELECT grp, count(*) AS n, regr_syy(r, mean_corr) * (1 - regr_r2(r"
    ", mean_corr)) AS rss FROM s GROUP BY 1), b AS (SELECT grp, sum(rss) AS rss FROM (SELECT grp, side, regr_syy(r"
    ", mean_corr) * (1 - regr_r2(r, mean_corr)) AS rss FROM s GROUP BY 1, 2) GROUP BY 1)"
)


@q("h07", COR + RR + CHOW + " SELECT a.grp, round(((a.rss - b.rss) / 2) / (b.rss / (n - 4)), 6) AS f FROM a JOIN b ON a.grp = b.grp")
def h07(s, d):
    x = rho_ret(s, d)
    rss = F.regr_syy("r", "mean_corr") * (1 - F.regr_r2("r", "mean_corr"))
    a = x.groupBy("grp").agg(F.count("*").alias("n"), rss.alias("whole"))
    b = x.groupBy("grp", (F.col("mean_corr") > 0).alias("side")).agg(rss.alias("p")).groupBy("grp").agg(F.sum("p").alias("parts"))
    return a.join(b, "grp").select("grp", r6("f", F.try_divide((F.col("whole") - F.col("parts")) / 2, F.col("parts") / (F.col("n") - 4))))


#: y on a constant, x and z by group, from centred sums; z is left out where it is collinear with x.
TWO = """ SELECT {keys}, count(*) AS n, CASE WHEN sxx * szz - sxz * sxz > 1e-10 * sxx * szz THEN (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) ELSE sxy / sxx END AS bx,
 CASE WHEN sxx * szz - sxz * sxz > 1e-10 * sxx * szz THEN (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) ELSE 0 END AS bz, sxy, szy, syy, mx, mz, my
 FROM (SELECT {keys}, var_pop(x) * count(*) AS sxx, var_pop(z) * count(*) AS szz, covar_pop(x, z) * count(*) AS sxz, covar_pop(x, y) * count(*) AS sxy,
 covar_pop(z, y) * count(*) AS szy, var_pop(y) * count(*) AS syy, avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM {src} GROUP BY {keys}) GROUP BY ALL"""
QUAD = ", qd AS (SELECT grp, mean_corr AS x, mean_corr * mean_corr AS z, r AS y FROM rr), fit AS (" + TWO.format(keys="grp", src="qd") + ")"


@q("h08", COR + RR + QUAD + ", simple AS (SELECT grp, round(regr_slope(r, mean_corr), 6) AS slope, round(regr_intercept(r, mean_corr), 6) AS intercept, round(regr_r2(r, mean_corr), 6) AS r2 FROM rr GROUP BY 1)"
   " SELECT simple.*, round(my - bx * mx - bz * mz, 6) AS q0, round(bx, 6) AS q1, round(bz, 6) AS q2, round((bx * sxy + bz * szy) / syy, 6) AS q_r2 FROM simple JOIN fit USING (grp)")
def h08(s, d):
    """The line and the parabola of the returns on the mean correlation."""
    fit = G.two_regressors("mean_corr", "z", "r")
    x = rho_ret(s, d).withColumn("z", F.col("mean_corr") * F.col("mean_corr"))
    line = [r6("slope", F.regr_slope("r", "mean_corr")), r6("intercept", F.regr_intercept("r", "mean_corr")), r6("r2", F.regr_r2("r", "mean_corr"))]
    return x.groupBy("grp").agg(*line, r6("q0", fit["b0"]), r6("q1", fit["bx"]), r6("q2", fit["bz"]), r6("q_r2", fit["r2"]))


BREAKS = [round(-0.15 + 0.02 * k, 2) for k in range(16)]
BROKEN = (
    ", br AS (SELECT grp, k, mean_corr AS x, greatest(0, mean_corr - round(-0.15 + 0.02 * k, 2)) AS z, r AS y FROM rr, range(16) v(k))"
    ", fit AS (" + TWO.format(keys="grp, k", src="br") + "), sc AS (SELECT grp, k, syy - bx * sxy - bz * szy AS rss, syy FROM fit)"
)


@q("h05", COR + RR + BROKEN + " SELECT grp, round(-0.15 + 0.02 * k, 2)::DOUBLE AS breakpoint, round(rss, 6) AS rss, round(1 - rss / syy, 6) AS r2 FROM sc"
    " QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(rss, 9), k) = 1")
def h05(s, d):
    x = rho_ret(s, d).withColumn("c", F.explode(F.array(*map(F.lit, BREAKS)))).withColumn("z", F.greatest(F.lit(0.0), F.col("mean_corr") - F.col("c")))
    fit = G.two_regressors("mean_corr", "z", "r")
    scan = x.groupBy("grp", "c").agg(fit["rss"].alias("rss"), fit["r2"].alias("r2"))
    best = Window.partitionBy("grp").orderBy(F.round("rss", 9), "c")
    return scan.withColumn("place", F.row_number().over(best)).filter("place = 1").select("grp", F.col("c").alias("breakpoint"), r6("rss"), r6("r2"))


@q("h06")
def h06(s, d):
    b = F.col("breakpoint")
    made = G.bootstrap_breakpoints(rho_ret(s, d), "mean_corr", "r", BREAKS, reps=1000)
    return made.groupBy("grp").agg(r6("mean", F.avg(b)), r6("std", F.stddev_pop(b)), r6("low", F.percentile(b, F.lit(0.025))), r6("high", F.percentile(b, F.lit(0.975))))


FACTORS = ["mkt", "smb", "hml", "rmw", "cma", "umd"]


@q("h09")
def h09(s, d):
    """Excess return on the five factors and momentum."""
    a, b = factors(s, d)
    x = ew(s, d).join(a.join(b, "ts"), "ts").withColumn("excess", F.col("r") - F.col("rf"))
    m = G.newey_west(x, "excess", FACTORS)
    beta = [r6(f"beta_{f}", F.col("beta")[i]) for i, f in enumerate(FACTORS, 1)]
    return m.select("grp", "n", r6("alpha", F.col("beta")[0] * 252), r6("t_alpha", F.col("t")[0]), *beta, r6("r2"))


@q("h10")
def h10(s, d):
    """The real topology against its permutations: z, p and effect size of the lifetimes' spread and z of the loops."""
    from tessera.plans.network_queries import t13

    n = t13(s, d).withColumn("h1_cv", F.coalesce("h1_cv", F.lit(0.0)))  # without loops it counts as 0
    null = n.filter("rep > 0").groupBy("grp").agg(F.avg("h1_cv").alias("cv_mean"), F.stddev_pop("h1_cv").alias("cv_std"), F.avg("h1_count").alias("loops_mean"), F.greatest(F.stddev_pop("h1_count"), F.lit(0.1)).alias("loops_std"))
    x = n.filter("rep = 0").join(null, "grp").withColumn("z", F.try_divide(F.col("h1_cv") - F.col("cv_mean"), F.col("cv_std"))).withColumn("p", z_p("z"))
    sure = F.col("p") < 0.05
    label = F.when(sure & (F.col("h1_cv") < F.col("cv_mean")), "Signal confirmed").when(sure & (F.col("h1_cv") > F.col("cv_mean")), "Heterogeneity issue").otherwise("No signal")
    return x.select(
        "grp", r6("mean_corr"), r6("cv", F.col("h1_cv")), r6("cv_mean"), r6("cv_std"), r6("z"), r6("p"), r6("cohens_d", F.col("z")), "h1_count",
        r6("loops_mean"), r6("z_loops", F.try_divide(F.col("h1_count") - F.col("loops_mean"), F.col("loops_std"))), label.alias("label"),
    )


#: Mean correlation that splits the regimes; the reference's 0.5 lies beyond these nearly independent panels.
RHO_SPLIT = 0.0


def pooled_t(m1, m2, v1, v2, n1, n2):
    """t of two means under one variance, with n1 + n2 - 2 degrees of freedom."""
    v = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    return F.try_divide(m1 - m2, F.sqrt(v * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))))


def regimes(x, v, keys):
    """Means of ``v`` under and from RHO_SPLIT on, what parts them, and p of the pooled t test."""
    low = F.col("mean_corr") < RHO_SPLIT
    a, b = F.when(low, F.col(v)), F.when(~low, F.col(v))
    g = x.groupBy(*keys).agg(F.avg(a).alias("below"), F.avg(b).alias("above"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"), F.count(a).alias("n1"), F.count(b).alias("n2"))
    t = pooled_t(F.col("below"), F.col("above"), F.col("v1"), F.col("v2"), F.col("n1"), F.col("n2"))
    return g.select(*keys, "below", "above", F.abs(F.col("below") - F.col("above")).alias("separation"), t_p(t, F.col("n1") + F.col("n2") - 2).alias("p_regimes"))


def pearson(x, y):
    return pair_corr(x, y)


def r_p():
    """p of the correlation ``r`` over ``n`` rows."""
    return t_p(F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))), F.col("n") - 2)


@q("h11")
def h11(s, d):
    x = S.topology(diagrams(s, d)).join(S.diagram_distances(diagrams(s, d)), ["grp", "ts"]).join(rho_ret(s, d).select("grp", "ts", "mean_corr"), ["grp", "ts"])
    names = ("h1_cv", "wasserstein", "bottleneck", "h1_entropy")
    long = x.select("grp", "mean_corr", F.explode(F.create_map(*[y for c in names for y in (F.lit(c), F.col(c))])).alias("metric", "v")).filter("v is not null and not isnan(v)")
    r = long.filter("v <> 0").groupBy("grp", "metric").agg(pearson("v", "mean_corr").alias("r"), F.count("*").alias("n")).filter("n > 10")
    out = r.join(regimes(long, "v", ("grp", "metric")), ["grp", "metric"])
    return out.select("grp", "metric", r6("r"), r6("p", r_p()), "n", r6("below"), r6("above"), r6("separation"), r6("p_regimes"))


@q("h12")
def h12(s, d):
    x = cv_and_rho(s, d)
    r = x.groupBy("grp").agg(F.avg("mean_corr").alias("rho"), F.avg("h1_cv").alias("cv"), pearson("h1_cv", "mean_corr").alias("r"), F.count("*").alias("n")).filter("n > 5")
    low = F.col("mean_corr") < 0.1  # cv_and_rho holds positive correlations only
    halves = x.groupBy("grp").agg(F.avg(F.when(low, F.col("h1_cv"))).alias("cv_below"), F.avg(F.when(~low, F.col("h1_cv"))).alias("cv_above"))
    out = r.join(halves, "grp").withColumn("p", r_p())
    held = F.when(F.col("cv_below").isNotNull() & F.col("cv_above").isNotNull(), F.col("cv_below") > F.col("cv_above"))
    return out.select("grp", r6("rho"), r6("cv"), r6("r"), r6("p"), "n", r6("cv_below"), r6("cv_above"), held.alias("threshold_holds"), F.coalesce((F.col("r") < -0.5) & (F.col("p") < 0.05), F.lit(False)).alias("pattern"))


@q("h13")
def h13(s, d):
    m = cv_and_rho(s, d).groupBy("grp").agg(F.avg("mean_corr").alias("rho"), F.avg("h1_cv").alias("cv"))
    home = m.filter("grp = 'B0'").select(F.col("rho").alias("r0"), F.col("cv").alias("c0"))
    p = m.join(F.broadcast(home)).withColumn("predicted", F.col("c0") + (F.col("r0") - F.col("rho")) * 0.5)
    return p.select("grp", r6("cv"), r6("predicted"), (F.abs(F.col("predicted") - F.col("cv")) < 0.2).alias("close"))


AUCQ = (
    ", u AS (SELECT grp, (r > 0)::INT AS y, rank() OVER (PARTITION BY grp ORDER BY round(mean_corr, 9)) + (count(*)"
    " OVER (PARTITION BY grp, round(mean_corr, 9)) - 1) / 2.0 AS rk FROM rr)"
)


@q("h14", COR + RR + AUCQ + " SELECT grp, round((sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM u GROUP BY 1")
def h14(s, d):
    v = F.round("mean_corr", 9)
    rk = F.rank().over(Window.partitionBy("grp").orderBy(v)) + (F.count("*").over(Window.partitionBy("grp", v)) - 1) / 2
    u = rho_ret(s, d).select("grp", (F.col("r") > 0).cast("int").alias("y"), rk.alias("rk"))
    pos = F.sum("y")
    return u.groupBy("grp").agg(r6("auc", F.try_divide(F.sum(F.when(F.col("y") == 1, F.col("rk"))) - pos * (pos + 1) / 2, pos * (F.count("*") - pos))))


def scored(s, d):
    """Mean correlation and (less) its spread as scores of a day that ends up."""
    return rho_ret(s, d).select("grp", "ts", F.round("mean_corr", 9).alias("rho"), F.round(-F.col("std_corr"), 9).alias("spread"), (F.col("r") > 0).cast("int").alias("y"))


def roc_sql(score, name):
    return (
        f", d{name} AS (SELECT grp, {score} AS s, sum((r > 0)::INT) AS pos, sum((r <= 0)::INT) AS neg FROM rr GROUP BY 1, 2), c{name} AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,"
        f" sum(pos) OVER (PARTITION BY grp) AS m, sum(neg) OVER (PARTITION BY grp) AS n FROM d{name} WINDOW w AS (PARTITION BY grp ORDER BY s DESC))"
    )


ROC_A, ROC_B = roc_sql("round(mean_corr, 9)", "a"), roc_sql("round(-std_corr, 9)", "b")


@q("h14_roc", COR + RR + ROC_A + " SELECT grp, s AS threshold, round(tp / m, 6) AS tpr, round(fp / n, 6) AS fpr FROM ca")
def h14_roc(s, d):
    return C.curve(C.counted(scored(s, d), "rho", "y")).select("grp", "threshold", r6("tpr"), r6("fpr"))


@q("h14_threshold", COR + RR + ROC_A + ", o AS (SELECT grp, arg_max(s, (tp * n - fp * m, s)) AS s, sum(pos * (n - fp + neg / 2)) / any_value(m * n) AS auc FROM ca GROUP BY grp)"
    " SELECT grp, s AS threshold, round(tp / m, 6) AS tpr, round(fp / n, 6) AS fpr, round(auc, 6) AS auc FROM o JOIN ca USING (grp, s)")
def h14_threshold(s, d):
    return C.best(C.counted(scored(s, d), "rho", "y")).select("grp", "threshold", r6("tpr"), r6("fpr"), r6("auc"))


PLACES = (
    ", v AS (SELECT rr.grp, r > 0 AS up, CASE WHEN r > 0 THEN (x.n - x.fp + x.neg / 2) / x.n ELSE (x.tp - x.pos / 2) / x.m END AS va, CASE WHEN r > 0 THEN (z.n - z.fp + z.neg / 2) / z.n"
    " ELSE (z.tp - z.pos / 2) / z.m END AS vb FROM rr JOIN ca x ON rr.grp = x.grp AND round(mean_corr, 9) = x.s JOIN cb z ON rr.grp = z.grp AND round(-std_corr, 9) = z.s)"
    ", g AS (SELECT grp, avg(va) FILTER (WHERE up) AS a, avg(vb) FILTER (WHERE up) AS b, sqrt(var_samp(va - vb) FILTER (WHERE up) / count(*) FILTER (WHERE up) + var_samp(va - vb) FILTER (WHERE NOT up)"
    " / count(*) FILTER (WHERE NOT up)) AS se FROM v GROUP BY grp)"
)


@q("h14_delong", COR + RR + ROC_A + ROC_B + PLACES + " SELECT grp, round(a, 6) AS auc_a, round(b, 6) AS auc_b, round(a - b, 6) AS difference, round(se, 6) AS se, round((a - b) / se, 6) AS z FROM g")
def h14_delong(s, d):
    return C.delong(scored(s, d), "rho", "spread", "y").select("grp", r6("auc_a"), r6("auc_b"), r6("difference"), r6("se"), r6("z"))


@q("h14_delong_p")
def h14_delong_p(s, d):
    return C.delong(scored(s, d), "rho", "spread", "y").select("grp", r6("p", z_p("z")))


LO = (
    ", g AS (SELECT grp, count(*) AS n, avg(r) AS m, stddev_samp(r) AS s FROM ew GROUP BY grp), z AS (SELECT ew.grp, t_idx, n, m / s AS sr, (r - m) / s AS z FROM ew JOIN g ON ew.grp = g.grp)"
    ", u AS (SELECT *, z - sr / 2 * (z * z - 1) AS u FROM z), l AS (SELECT *, "
    + " + ".join(f"coalesce(lag(u, {k}) OVER (PARTITION BY grp ORDER BY t_idx), 0) * {6 - k} / 6.0" for k in range(1, 6))
    + " AS near FROM u), v AS (SELECT grp, any_value(n) AS n, any_value(sr) * sqrt(252) AS s, sqrt((1 + any_value(sr) ** 2 / 2) / any_value(n)) * sqrt(252) AS iid"
    ", sqrt(greatest(sum(u * u) + 2 * sum(u * near), 0)) / any_value(n) * sqrt(252) AS se FROM l GROUP BY grp)"
)


@q("h14_sharpe", RET + EW + LO + " SELECT grp, n, round(s, 6) AS sharpe, round(iid, 6) AS se_iid, round(se, 6) AS se, round(s - 1.959963984540054 * se, 6) AS low, round(s + 1.959963984540054 * se, 6) AS high FROM v")
def h14_sharpe(s, d):
    """Interval of the yearly ratio of holding a group, autocorrelation of five rows counted."""
    return Boot.sharpe_interval(ew(s, d)).select("grp", "n", r6("sharpe"), r6("se_iid"), r6("se"), r6("low"), r6("high"))


@q("h14_sharpe_bootstrap")
def h14_sharpe_bootstrap(s, d):
    """The same interval by 1000 resamples of blocks of 20 rows on average, and the share of resamples under zero."""
    x, v = Boot.sharpe_bootstrap(ew(s, d)), F.col("sharpe")
    return x.groupBy("grp").agg(r6("mean", F.avg(v)), r6("std", F.stddev_samp(v)), r6("low", F.percentile(v, F.lit(0.025))), r6("high", F.percentile(v, F.lit(0.975))), r6("under", F.avg((v < 0).cast("double"))))


def weights(e, legs=2):
    """grp, asset, ts, w from residuals e: least 1/legs long, greatest short."""
    x = ranked(e, "e")
    return x.select("grp", "asset", "ts", F.when(F.col("lo") <= legs, 1.0 / legs).when(F.col("hi") <= legs, -1.0 / legs).otherwise(0.0).alias("w"))


def long_short(s, d, w, flag=None, bps=5.0, lag=1):
    """Daily return of weights set ``lag`` rows before, flat where ``flag`` is 1, less turnover cost."""
    cal = ret(s, d).select("grp", "asset", "ts", "t_idx", "r")
    at = w.join(cal.select("grp", "asset", "ts", "t_idx"), ["grp", "asset", "ts"]).select("grp", "asset", (F.col("t_idx") + lag).alias("t_idx"), "w")
    x = cal.join(at, ["grp", "asset", "t_idx"])
    if flag is not None:
        x = x.join(flag, ["grp", "ts"], "left").withColumn("w", F.when(F.coalesce("flag", F.lit(0)) == 1, 0.0).otherwise(F.col("w")))
    x = x.withColumn("dw", F.abs(F.col("w") - F.coalesce(F.lag("w").over(R.in_order(("grp", "asset"))), F.lit(0.0))))
    return x.groupBy("grp", "ts", "t_idx").agg((F.sum(F.col("w") * F.col("r")) - F.sum("dw") * bps / 1e4).alias("r"))


LSQ = (
    ", w0 AS (SELECT grp, asset, ts, CASE WHEN lo <= 2 THEN 0.5 WHEN hi <= 2 THEN -0.5 ELSE 0.0 END AS w FROM (SELECT *, row_number()"
    " OVER (PARTITION BY grp, ts ORDER BY round(e, 9), asset) AS lo, row_number() OVER (PARTITION BY grp, ts ORDER BY round(e, 9) DESC"
    ", asset DESC) AS hi FROM res)), lagged AS (SELECT w0.grp, w0.asset, t_idx + 1 AS t_idx, w FROM w0 JOIN ret r ON w0.grp = r.grp"
    " AND w0.asset = r.asset AND w0.ts = r.ts), pw AS (SELECT r.grp, r.asset, r.ts, r.t_idx, r.r, {w} AS w FROM ret r"
    " JOIN lagged l ON r.grp = l.grp AND r.asset = l.asset AND r.t_idx = l.t_idx{join}), pc AS (SELECT *, abs(w - coalesce(lag(w)"
    " OVER (PARTITION BY grp, asset ORDER BY t_idx), 0)) AS dw FROM pw), pnl AS (SELECT grp, ts, t_idx, sum(w * r) -"
    " sum(dw) * 5 / 1e4 AS r FROM pc GROUP BY 1, 2, 3)"
)
RES = LAP + _diffuse()


@q("x04", COR + RES + LSQ.format(w="w", join="") + " SELECT grp, ts, round(r, 6) AS r FROM pnl")
def x04(s, d):
    return laplacian_plain(s, d).select("grp", "ts", r6("r"))


def laplacian_plain(s, d):
    return shared("x04", s, d, lambda: long_short(s, d, weights(residuals(s, d))))


def regime(x, col, p, above=True):
    """1 where ``col`` is above (below) the percentile p of the training dates."""
    cut = x.filter(train()).groupBy("grp").agg(F.percentile(col, F.lit(p)).alias("cut"))
    return x.join(cut, "grp").select("grp", "ts", F.coalesce((F.col(col) > F.col("cut")) if above else (F.col(col) < F.col("cut")), F.lit(False)).cast("int").alias("flag"))


def vol_flag(s, d):
    v = realized_vol(ret(s, d)).withColumn("v20", R.rolling_mean(F.col("rv"), 20))
    return regime(v, "v20", 0.75)


VF = (
    RV + ", v20 AS (SELECT grp, ts, CASE WHEN count(rv) OVER w >= 20 THEN avg(rv) OVER w END AS v"
    " FROM rv WINDOW w AS (PARTITION BY grp ORDER BY t_idx ROWS 19 PRECEDING)), vc AS (SELECT grp, quantile_cont(v, 0.75) AS c FROM v20"
    " WHERE ts <= TIMESTAMP '1998-12-31' GROUP BY 1), fl AS (SELECT v20.grp, v20.ts, coalesce(v > c, FALSE) AS flag FROM v20"
    " JOIN vc ON v20.grp = vc.grp)"
)


@q("x03", COR + RES + VF + LSQ.format(w="CASE WHEN flag THEN 0.0 ELSE w END", join=" LEFT JOIN fl ON r.grp = fl.grp AND r.ts = fl.ts") + " SELECT grp, ts, round(r, 6) AS r FROM pnl")
def x03(s, d):
    return long_short(s, d, weights(residuals(s, d)), vol_flag(s, d)).select("grp", "ts", r6("r"))


def fiedler(s, d):
    """To nine digits: values that are zero but for rounding, as of a network in parts, would else fall on either side of a
    percentile by the order in which a sum was made."""
    cal = ew(s, d).select("grp", "ts", "t_idx")
    return shared("fiedler", s, d, lambda: S.spectra(vectors(s, d), TAU).select("grp", "ts", F.round("fiedler", 9).alias("fiedler")).join(cal, ["grp", "ts"]))


@q("x02")
def x02(s, d):
    f = fiedler(s, d).withColumn("sd", R.rolling_std(F.col("fiedler"), 30))
    return long_short(s, d, weights(residuals(s, d)), regime(f, "sd", 0.75)).select("grp", "ts", r6("r"))


@q("x01")
def x01(s, d):
    """Invested while the spread of loop lifetimes is under its expanding 75 % quantile; held five rows, one row late."""
    f = S.topology(diagrams(s, d)).select("grp", "ts", "h1_cv").join(ew(s, d), ["grp", "ts"])
    f = R.expanding_quantile(f.withColumn("n", F.row_number().over(R.in_order()) - 1), "h1_cv", 0.75, "cut")
    f = f.withColumn("raw", F.coalesce((F.col("h1_cv") < F.col("cut")).cast("double"), F.lit(0.0))).withColumn("pos", R.hold(F.col("raw"), F.col("n"), 5))
    return f.select("grp", "ts", r6("r", F.coalesce(F.lag("pos").over(R.in_order()), F.lit(0.0)) * F.col("r")))


def beta_spread(s, d, signal, cost_on_change=True, lag=1, pairs=2, bps=5.0):
    """Highest against lowest training betas, on (+1) or against (-1) by a lagged signal held five rows."""
    b = betas(ret(s, d).filter(train())).select("grp", "asset", F.col("beta").alias("e"), F.lit(0).alias("ts"))
    w = ranked(b, "e").select("grp", "asset", F.when(F.col("hi") <= pairs, 1.0 / pairs).when(F.col("lo") <= pairs, -1.0 / pairs).otherwise(0.0).alias("w"))
    spread = ret(s, d).join(w, ["grp", "asset"]).groupBy("grp", "ts", "t_idx").agg(F.sum(F.col("w") * F.col("r")).alias("spread"))
    x = spread.join(signal, ["grp", "ts"]).withColumn("sig", F.lag("sig", lag).over(R.in_order()) if lag else F.col("sig")).filter("sig is not null")
    x = x.withColumn("n", F.row_number().over(R.in_order()) - 1).withColumn("pos", R.hold(F.col("sig"), F.col("n"), 5))
    changed = (F.col("pos") != F.coalesce(F.lag("pos").over(R.in_order()), F.lit(0))) if cost_on_change else (F.col("n") % 5 == 0)
    return x.select("grp", "ts", "t_idx", (F.col("pos") * F.col("spread") - F.when(changed, 2 * pairs * bps / 1e4).otherwise(0.0)).alias("r"))


@q("x05")
def x05(s, d):
    sig = regime(fiedler(s, d), "fiedler", 0.25, above=False).select("grp", "ts", F.when(F.col("flag") == 1, 1).otherwise(-1).alias("sig"))
    return beta_spread(s, d, sig).select("grp", "ts", r6("r"))


def h1_signal(s, d):
    return regime(h1(s, d), "h1_count", 0.75).select("grp", "ts", F.when(F.col("flag") == 1, 1).otherwise(-1).alias("sig"))


#: The count of loops by its relational identity, and its signal: +1 above the 75 % quantile of the training dates, else -1.
SIG = (
    H1 + f", hc AS (SELECT grp, quantile_cont(h1_count, 0.75) AS c FROM h1 WHERE ts <= {TRAIN} GROUP BY 1), sg AS (SELECT h1.grp, h1.ts,"
    f" CASE WHEN h1_count > c THEN 1 ELSE -1 END AS sig FROM h1 JOIN hc ON h1.grp = hc.grp)"
)
BSP = (
    BETA.format(where=f" WHERE r.ts <= {TRAIN}") + ", bw AS (SELECT grp, asset, CASE WHEN hi <= 2 THEN 0.5 WHEN lo <= 2 THEN -0.5 ELSE 0.0 END AS w FROM (SELECT *, row_number()"
    " OVER (PARTITION BY grp ORDER BY round(beta, 9), asset) AS lo, row_number() OVER (PARTITION BY grp ORDER BY round(beta, 9) DESC"
    ", asset DESC) AS hi FROM beta)), sp AS (SELECT r.grp, ts, t_idx, sum(w * r) AS spread FROM ret r JOIN bw ON r.grp = bw.grp"
    " AND r.asset = bw.asset GROUP BY 1, 2, 3)"
)
X06 = (
    SIG + BSP + ", z AS (SELECT sp.*, sig, row_number() OVER (PARTITION BY sp.grp ORDER BY t_idx) - 1 AS n FROM sp JOIN sg ON sp.grp = sg.grp"
    " AND sp.ts = sg.ts), hz AS (SELECT *, last_value(CASE WHEN n % 5 = 0 THEN sig END IGNORE NULLS)"
    " OVER (PARTITION BY grp ORDER BY t_idx ROWS UNBOUNDED PRECEDING) AS pos FROM z)"
)


@q("x06", COR + X06 + " SELECT grp, ts, round(pos * spread - CASE WHEN n % 5 = 0 THEN 4 * 5.0 / 1e4 ELSE 0 END, 6) AS r FROM hz")
def x06(s, d):
    return beta_spread(s, d, h1_signal(s, d), cost_on_change=False, lag=0).select("grp", "ts", r6("r"))


def variant(s, d, mode):
    """Weights from the returns and the network of a row; they trade two rows later, as the verified behaviour is."""
    x = ret(s, d).withColumn("mom", F.sum("r").over(R.past(20, keys=("grp", "asset"))))
    rev = weights(x.select("grp", "asset", "ts", F.col("r").alias("e")))
    if mode == "rev":
        return rev
    mom = weights(x.filter("t_idx >= 19").select("grp", "asset", "ts", (-F.col("mom")).alias("e")))
    f = fiedler(s, d)
    if mode == "hybrid":
        pick = regime(f, "fiedler", 0.25, above=False).select("grp", "ts", F.when(F.col("flag") == 1, "rev").otherwise("mom").alias("use"))
    else:
        z = R.z_score(F.col("fiedler"), 60, pop=True)
        pick = f.withColumn("z", z).select("grp", "ts", F.when(F.col("z") > 1, "rev").when(F.col("z") < -1, "mom").otherwise("flat").alias("use"))
    both = rev.join(mom.withColumnRenamed("w", "wm"), ["grp", "asset", "ts"]).join(pick, ["grp", "ts"])
    return both.select("grp", "asset", "ts", F.when(F.col("use") == "rev", F.col("w")).when(F.col("use") == "mom", F.col("wm")).otherwise(0.0).alias("w"))


V1 = ", res AS (SELECT grp, asset, ts, r AS e FROM ret)" + LSQ.format(w="w", join="").replace("t_idx + 1 AS t_idx", "t_idx + 2 AS t_idx")


@q("x07", RET + V1 + " SELECT grp, ts, round(r, 6) AS r FROM pnl")
def x07(s, d):
    return long_short(s, d, variant(s, d, "rev"), lag=2).select("grp", "ts", r6("r"))


@q("x08")
def x08(s, d):
    return long_short(s, d, variant(s, d, "hybrid"), lag=2).select("grp", "ts", r6("r"))


@q("x09")
def x09(s, d):
    return long_short(s, d, variant(s, d, "adaptive"), lag=2).select("grp", "ts", r6("r"))


@q("x10")
def x10(s, d):
    parts = [long_short(s, d, variant(s, d, m), lag=2) for m in ("rev", "hybrid", "adaptive")]
    x = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return x.groupBy("grp", "ts").agg(F.avg("r").alias("r"), F.count("*").alias("n")).filter("n = 3").select("grp", "ts", r6("r"))


MOM = (
    ", mm AS (SELECT * FROM (SELECT grp, asset, ts, t_idx, r, sum(r) OVER (PARTITION BY grp"
    ", asset ORDER BY t_idx ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS mom FROM ret) WHERE t_idx >= {n}), mk2 AS (SELECT *"
    ", row_number() OVER (PARTITION BY grp, ts ORDER BY round(mom, 9), asset) AS lo, row_number() OVER (PARTITION BY grp, ts ORDER BY"
    " round(mom, 9) DESC, asset DESC) AS hi FROM mm)"
)
X11 = (
    SIG + MOM.format(n=20) + ", mp AS (SELECT grp, ts, t_idx, sum(CASE WHEN hi <= 2 THEN 0.25 WHEN lo <= 2 THEN -0.25 ELSE 0 END * r) AS mom FROM mk2 GROUP BY 1"
    ", 2, 3), z AS (SELECT mp.*, sig, row_number() OVER (PARTITION BY mp.grp ORDER BY t_idx) - 1 AS n FROM mp"
    " JOIN sg ON mp.grp = sg.grp AND mp.ts = sg.ts)"
)


@q("x11", COR + X11 + " SELECT grp, ts, round(-sig * mom - CASE WHEN n % 5 = 0 THEN 0.005 ELSE 0 END, 6) AS hybrid, round(mom, 6) AS momentum FROM z")
def x11(s, d):
    """Momentum turned round by the topology's signal, ten trades of 5 bp every fifth row; and momentum alone, without costs."""
    mom = ret(s, d).withColumn("mom", F.sum("r").over(R.past(20, keys=("grp", "asset"), skip=1))).filter("t_idx >= 20")
    w = ranked(mom, "mom").select("grp", "asset", "ts", "t_idx", "r", F.when(F.col("hi") <= 2, 0.25).when(F.col("lo") <= 2, -0.25).otherwise(0.0).alias("w"))
    x = w.groupBy("grp", "ts", "t_idx").agg(F.sum(F.col("w") * F.col("r")).alias("mom")).join(h1_signal(s, d), ["grp", "ts"])
    n = F.row_number().over(R.in_order()) - 1
    return x.select("grp", "ts", r6("hybrid", -F.col("sig") * F.col("mom") - F.when(n % 5 == 0, 0.005).otherwise(0.0)), r6("momentum", F.col("mom")))


def closer(name, out):
    """SQL: the least greatest step of paths of up to twice as many edges as those of ``name``."""
    return (
        f", {out} AS (SELECT grp, ts, a, b, min(d) AS d FROM (SELECT grp, ts, a, b, d FROM {name} UNION ALL SELECT x.grp, x.ts, x.a, y.b, greatest(x.d, y.d) FROM {name} x JOIN {name} y"
        " ON x.grp = y.grp AND x.ts = y.ts AND x.b = y.a WHERE x.a <> y.b) GROUP BY 1, 2, 3, 4)"
    )


#: The loops born up to a distance are the neighbour edges so short that do not join two parts; paths of up to 8 edges.
X12 = (
    base(upto="corr", window=5) + H1 + closer("sym", "m2") + closer("m2", "m4") + closer("m4", "m8") + ", lp AS (SELECT r.grp, r.ts, count(*) FILTER (WHERE r.d <= {limit} AND r.d > m.d) AS h1_count FROM rng r"
    " JOIN m8 m ON r.grp = m.grp AND r.ts = m.ts AND r.a = m.a AND r.b = m.b GROUP BY 1, 2), "
    f"hc AS (SELECT grp, quantile_cont(h1_count, 0.75) AS c FROM lp WHERE ts <= {TRAIN} GROUP BY 1)" + MOM.format(n=5)
    + ", leg AS (SELECT grp, ts, avg(r) FILTER (WHERE lo <= 2) AS losers, avg(r) FILTER (WHERE hi <= 2) AS winners FROM mk2 GROUP BY 1, 2)"
    ", day AS (SELECT lp.grp, lp.ts, h1_count, h1_count > c AS stressed, losers, winners, (row_number() OVER (PARTITION BY lp.grp ORDER BY lp.ts) - 1) % 5 AS turn FROM lp JOIN hc ON lp.grp = hc.grp"
    f" JOIN leg ON lp.grp = leg.grp AND lp.ts = leg.ts WHERE lp.ts > {TRAIN}) SELECT grp, ts, h1_count::INT AS h1_count, stressed::INT AS position,"
    " round(CASE WHEN stressed THEN (losers - winners) / 2 - CASE WHEN turn = 0 THEN 10 * 0.0005 ELSE 0 END ELSE 0 END, 6) AS r FROM day"
)


def scale_consistent(s, d, limit, window=5, legs=2, every=5, trades=10, bps=5.0):
    """Topology and signal on one short scale: on test dates whose count of loops born up to ``limit`` in the ``window`` rows
    before is over its training 75 % quantile, the losers of these rows against the winners, half each, with the cost of
    ``trades`` on every ``every``-th row if in the market; else flat. Dates with an undefined correlation are left out."""
    from tessera.operators.network import corr_vectors, rolling_corr

    def build():
        v = corr_vectors(rolling_corr(ret(s, d), window)).filter(~F.exists("rho", lambda x: x.isNull()))
        return S.diagrams(v, limit).select("grp", "ts", F.size(F.filter("diagram", lambda b: b["dim"] == 1)).alias("h1_count"))

    loops = shared(f"loops {window} {limit}", s, d, build)
    loops = loops.join(regime(loops, "h1_count", 0.75), ["grp", "ts"])
    past = ret(s, d).withColumn("mom", F.sum("r").over(R.past(window, keys=("grp", "asset"), skip=1))).filter(F.col("t_idx") >= window)
    leg = lambda side: F.avg(F.when(F.col(side) <= legs, F.col("r")))
    x = ranked(past, "mom").groupBy("grp", "ts").agg(((leg("lo") - leg("hi")) / 2).alias("spread")).join(loops, ["grp", "ts"]).filter(~train())
    turn = (F.row_number().over(R.in_order(order="ts")) - 1) % every == 0
    r = F.when(F.col("flag") == 1, F.col("spread") - F.when(turn, trades * bps / 1e4).otherwise(0.0)).otherwise(0.0)
    return x.select("grp", "ts", "h1_count", F.col("flag").alias("position"), r6("r", r))


@q("x12", X12.format(limit=0.5))
def x12(s, d):
    """Loops up to distance 0.5, which is a correlation of 0.875."""
    return scale_consistent(s, d, 0.5)


@q("x12_wide", X12.format(limit=1.3))
def x12_wide(s, d):
    """Loops up to distance 1.3: on panels as independent as these five rows hardly ever make one up to 0.5."""
    return scale_consistent(s, d, 1.3)


F60H = "OVER (PARTITION BY grp ORDER BY ts ROWS 59 PRECEDING)"
X13 = (
    H1
    + f", hz AS (SELECT grp, ts, h1_count, CASE WHEN count(h1_count) {F60H} >= 60 THEN (h1_count - avg(h1_count) {F60H}) /"
    f" nullif(stddev_samp(h1_count) {F60H}, 0) END AS z FROM h1)"
    + MOM.format(n=20)
    + ", leg AS (SELECT grp, ts, avg(r) FILTER (WHERE lo <= 2) AS losers, avg(r) FILTER (WHERE hi <= 2) AS winners FROM mk2 GROUP BY 1, 2)"
    ", day AS (SELECT h.grp, h.ts, z, (losers - winners) / 2 AS spread, (row_number() OVER (PARTITION BY h.grp ORDER BY h.ts) - 1) % 5 AS turn"
    " FROM hz h JOIN leg ON h.grp = leg.grp AND h.ts = leg.ts WHERE z IS NOT NULL)"
)


@q("x13", COR + X13 + " SELECT grp, ts, CASE WHEN z > 1 THEN 'high_stress' WHEN z < -1 THEN 'low_stress' ELSE 'normal' END AS regime,"
    " round(CASE WHEN abs(z) > 1 THEN least(abs(z) / 2, 1) * spread - CASE WHEN turn = 0 THEN 10 * 0.0005 ELSE 0 END ELSE 0 END, 6) AS r FROM day")
def x13(s, d):
    """Losers of 20 rows against winners on days whose loop count stands out from its last 60, by how much it does; ten
    trades of 5 bp on every fifth row, if in the market."""
    z = h1(s, d).withColumn("z", R.z_score(F.col("h1_count"), 60, order="ts")).filter("z is not null").select("grp", "ts", "z")
    mom = ret(s, d).withColumn("mom", F.sum("r").over(R.past(20, keys=("grp", "asset"), skip=1))).filter("t_idx >= 20")
    w = ranked(mom, "mom").select("grp", "ts", "r", F.when(F.col("lo") <= 2, 0.25).when(F.col("hi") <= 2, -0.25).otherwise(0.0).alias("w"))
    x = w.groupBy("grp", "ts").agg(F.sum(F.col("w") * F.col("r")).alias("r")).join(z, ["grp", "ts"])
    turn = (F.row_number().over(R.in_order(order="ts")) - 1) % 5 == 0
    made = F.least(F.abs("z") / 2, F.lit(1.0)) * F.col("r") - F.when(turn, 0.005).otherwise(0.0)
    name = F.when(F.col("z") > 1, "high_stress").when(F.col("z") < -1, "low_stress").otherwise("normal")
    return x.select("grp", "ts", name.alias("regime"), r6("r", F.when(F.abs("z") > 1, made).otherwise(0.0)))


PICK = (
    ", m AS (SELECT grp, round(avg(r) / stddev_samp(r), 9) AS s FROM ew GROUP BY grp), n AS (SELECT *, max((s > 0)::INT)"
    " OVER () AS any_up, row_number() OVER (ORDER BY (s > 0)::INT DESC, s DESC, grp) AS by_s, row_number() OVER (ORDER BY grp) AS by_g"
    " FROM m), pick AS (SELECT grp FROM n WHERE CASE WHEN any_up = 1 THEN s > 0 AND by_s <= 3 ELSE by_g <= 3 END)"
)
CHOSEN = (
    ", c AS (SELECT ts, avg(r) AS r FROM st JOIN pick USING (grp) GROUP BY ts HAVING count(*) = (SELECT count(*) FROM pick))"
    ", x AS (SELECT ts, r, row_number() OVER (ORDER BY ts) AS t_idx, product(1 + r) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cum"
    " FROM c), y AS (SELECT *, cum / max(cum) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM x)"
)
GROUP_STRATEGY = (
    SIG + BSP + ", st AS (SELECT grp, ts, sig * spread - CASE WHEN n % 5 = 0 THEN 4 * 0.0005 ELSE 0 END AS r FROM (SELECT sp.*, sig, row_number() OVER (PARTITION BY sp.grp ORDER BY sp.ts) - 1 AS n"
    f" FROM sp JOIN sg ON sp.grp = sg.grp AND sp.ts = sg.ts WHERE sp.ts > {TRAIN}))"
)


def group_strategy(s, d, pairs=2, every=5, bps=5.0):
    """A group's own strategy on test dates: highest against lowest training betas by the day's loop signal, the cost of all
    pairs on every ``every``-th row."""
    b = betas(ret(s, d).filter(train())).select("grp", "asset", F.col("beta").alias("e"), F.lit(0).alias("ts"))
    w = ranked(b, "e").select("grp", "asset", F.when(F.col("hi") <= pairs, 1.0 / pairs).when(F.col("lo") <= pairs, -1.0 / pairs).otherwise(0.0).alias("w"))
    spread = ret(s, d).filter(~train()).join(w, ["grp", "asset"]).groupBy("grp", "ts").agg(F.sum(F.col("w") * F.col("r")).alias("spread")).join(h1_signal(s, d), ["grp", "ts"])
    turn = (F.row_number().over(R.in_order(order="ts")) - 1) % every == 0
    return spread.select("grp", "ts", (F.col("sig") * F.col("spread") - F.when(turn, 2 * pairs * bps / 1e4).otherwise(0.0)).alias("r"))


def together(st):
    """Equal weights of the best groups' returns (grp, ts, r) on the dates that all of them have."""
    best = best_groups(st).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))  # up to three rows
    port = st.join(F.broadcast(best), "grp").groupBy("ts").agg(F.avg("r").alias("r"), F.count("*").alias("c"), F.max("n").alias("n")).filter("c = n")
    return port.select(F.lit("portfolio").alias("grp"), "ts", F.col("ts").alias("t_idx"), "r")


@q("x14", COR + GROUP_STRATEGY + PICK.replace("FROM ew", "FROM st") + CHOSEN + " SELECT count(r) AS n, round(arg_max(cum, t_idx) - 1, 6) AS total_ret, round(pow(arg_max(cum, t_idx), 252.0 / count(r)) - 1, 6) AS ann_ret,"
    " round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe, round(stddev_samp(r) * sqrt(252), 6) AS vol, round(min(dd), 6) AS max_dd, round(avg((r > 0)::INT), 6) AS hit FROM y")
def x14(s, d):
    """The strategies of up to three groups where theirs has a positive ratio (else the first three), equal weights."""
    x = together(shared("group_strategy", s, d, lambda: group_strategy(s, d)))
    return M.performance(x).select("n", r6("total_ret"), r6("ann_ret", F.col("cagr")), r6("sharpe"), r6("vol", F.col("ann_vol")), r6("max_dd"), r6("hit", F.col("hit_daily")))


STRATEGIES = ["laplacian", "fiedler", "volatility", "beta_spread", "reversion"]


def strategies(s, d):
    """grp, ts, t_idx, hold, a column for each strategy and their mean (ensemble), on the dates common to all. Each strategy is
    a written table, so that the driver never holds the plans of all five at once."""

    def build():
        wide = ew(s, d).select("grp", "ts", "t_idx", F.col("r").alias("hold"))
        for name, make in zip(STRATEGIES, (laplacian_plain, x02, x03, x05, x07), strict=True):
            x = shared(f"strategy {name}", s, d, lambda make=make: make(s, d).select("grp", "ts", "r"))
            wide = wide.join(x.select("grp", "ts", F.col("r").alias(name)), ["grp", "ts"])
        return wide.withColumn("ensemble", sum((F.col(n) for n in STRATEGIES), F.lit(0.0)) / len(STRATEGIES))

    return shared("strategies", s, d, build)


def compared(s, d):
    """g, strategy and performance of holding, every strategy and the ensemble, and the correlation with holding."""
    names = ["hold", *STRATEGIES, "ensemble"]
    long = strategies(s, d).select(F.col("grp").alias("g"), "t_idx", F.col("hold").alias("base"), F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(n).alias("r")) for n in names])).alias("x")).select("g", "t_idx", "base", "x.*")
    long = long.withColumn("grp", F.concat_ws("|", "g", "strategy"))
    rho = long.groupBy("grp").agg(F.first("g").alias("g"), F.first("strategy").alias("strategy"), pearson("r", "base").alias("rho_hold"))
    return M.performance(long.select("grp", "t_idx", "r")).join(rho, "grp")


@q("x15")
def x15(s, d):
    """Every strategy of a group on the dates common to all: performance, improvement over holding, correlation with it."""
    m = compared(s, d).withColumn("base", F.max(F.when(F.col("strategy") == "hold", F.col("sharpe"))).over(Window.partitionBy("g")))
    better = F.try_divide(F.col("sharpe") - F.col("base"), F.abs("base")) * 100
    return m.select(F.col("g").alias("grp"), "strategy", "n", r6("total_ret"), r6("ann_ret"), r6("sharpe"), r6("max_dd"), r6("hit", F.col("hit_daily")), r6("calmar"), r6("improvement_pct", better, 4), r6("rho_hold"))


@q("x15_matrix")
def x15_matrix(s, d):
    """Correlation of every two strategies of a group, their mean, and what an ensemble can gain by it."""
    two = [(a, b) for i, a in enumerate(STRATEGIES) for b in STRATEGIES[i + 1 :]]
    wide = strategies(s, d).groupBy("grp").agg(*[pearson(a, b).alias(f"{a}_{b}") for a, b in two])
    long = wide.select("grp", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("rho")) for a, b in two])).alias("x")).select("grp", "x.*")
    mean = F.avg("rho").over(Window.partitionBy("grp"))
    label = F.when(mean < 0.5, "good").when(mean < 0.7, "some").when(mean.isNotNull(), "limited")
    return long.select("grp", "a", "b", r6("rho"), r6("mean_rho", mean), label.alias("diversification"))


@q("x15_winner")
def x15_winner(s, d):
    """The strategy with the greatest ratio, what it gains over plain reversion, and whether the ensemble beats it."""
    m = compared(s, d).filter("strategy <> 'hold'")
    of = lambda name: F.max(F.when(F.col("strategy") == name, F.col("sharpe")))
    single = F.col("strategy") != "ensemble"
    g = m.groupBy(F.col("g").alias("grp")).agg(F.max_by("strategy", F.when(single, F.struct(F.round("sharpe", 9), "strategy"))).alias("best"), F.max(F.when(single, F.col("sharpe"))).alias("sharpe"), of("reversion").alias("baseline"), of("ensemble").alias("ensemble"))
    gain = lambda x, y: F.try_divide(x - y, F.abs(y)) * 100
    return g.select("grp", "best", r6("sharpe"), r6("baseline"), r6("improvement_pct", gain(F.col("sharpe"), F.col("baseline")), 4), r6("ensemble"), (F.col("ensemble") > F.col("sharpe")).alias("ensemble_wins"), r6("ensemble_gain_pct", gain(F.col("ensemble"), F.col("sharpe")), 4))


MKT = ", mk AS (SELECT h.grp, avg(mean_corr) AS rho, stddev_samp(h1_count) / avg(h1_count) AS cv FROM h1 h JOIN feat f ON h.grp = f.grp AND h.ts = f.ts GROUP BY 1)"


#: Class and region of the groups of the brand panel; "home" is the class that the others are held against.
MARKETS = {"B0": ("home", "north"), "B1": ("home", "north"), "B2": ("home", "south"), "B3": ("abroad", "south"), "B4": ("abroad", "east")}
KINDS = ", mt AS (SELECT mk.*, class, region FROM mk JOIN (VALUES " + ", ".join(f"('{g}', '{c}', '{r}')" for g, (c, r) in MARKETS.items()) + ") v(g, class, region) ON mk.grp = v.g)"
STABLE = " CASE WHEN {cv} < 0.5 THEN 'stable' WHEN {cv} < 0.7 THEN 'moderate' ELSE 'unstable' END AS stability"


def markets(s, d):
    """grp, rho, cv (mean correlation and spread of the loop count), class and region of every market."""
    from tessera.operators.network import network_features

    m = h1(s, d).join(network_features(corr(s, d)), ["grp", "ts"]).groupBy("grp").agg(F.avg("mean_corr").alias("rho"), F.try_divide(F.stddev_samp("h1_count"), F.avg("h1_count")).alias("cv"))
    kind = s.createDataFrame([(g, *v) for g, v in MARKETS.items()], "grp string, class string, region string")
    return m.join(F.broadcast(kind), "grp", "left")  # a row for each market named


def stability():
    return F.when(F.col("cv") < 0.5, "stable").when(F.col("cv") < 0.7, "moderate").otherwise("unstable").alias("stability")


@q("x16", COR + FEATURES + H1 + MKT + KINDS + ", g AS (SELECT corr(rho, cv) AS all_rho, CASE WHEN count(*) FILTER (WHERE class = 'home') >= 3 THEN corr(rho, cv) FILTER (WHERE class = 'home') END AS home_rho FROM mt)"
    " SELECT grp, round(rho, 6) AS rho, round(cv, 6) AS cv, CASE WHEN rho > 0.5 AND cv < 0.6 THEN 'good' WHEN rho > 0.4 OR cv < 0.7 THEN 'marginal' ELSE 'poor' END AS label," + STABLE.format(cv="cv")
    + ", round(all_rho, 6) AS global_rho, round(home_rho, 6) AS home_rho, round(abs(all_rho - home_rho), 6) AS difference, CASE WHEN home_rho IS NULL THEN NULL WHEN abs(all_rho - home_rho) < 0.2 THEN 'yes'"
    " WHEN all_rho < -0.5 THEN 'partly' ELSE 'no' END AS generalizes FROM mt, g")
def x16(s, d):
    """Markets side by side: viability, stability of the topology, whether correlation and spread go together globally, and
    whether they do so as at home (three home markets at least)."""
    m, home = markets(s, d), F.col("class") == "home"
    at_home = pearson(F.when(home, F.col("rho")), F.when(home, F.col("cv")))
    g = m.agg(pearson("rho", "cv").alias("global_rho"), F.when(F.count_if(home) >= 3, at_home).alias("home_rho"))
    label = F.when((F.col("rho") > 0.5) & (F.col("cv") < 0.6), "good").when((F.col("rho") > 0.4) | (F.col("cv") < 0.7), "marginal").otherwise("poor")
    apart = F.abs(F.col("global_rho") - F.col("home_rho"))
    verdict = F.when(apart.isNotNull(), F.when(apart < 0.2, "yes").when(F.col("global_rho") < -0.5, "partly").otherwise("no"))
    return m.join(F.broadcast(g)).select("grp", r6("rho"), r6("cv"), label.alias("label"), stability(), r6("global_rho"), r6("home_rho"), r6("difference", apart), verdict.alias("generalizes"))  # one row


@q("x16_breakdown", COR + FEATURES + H1 + MKT + KINDS + ", k AS (SELECT 'class' AS kind, class AS name, rho, cv FROM mt UNION ALL SELECT 'region', region, rho, cv FROM mt) SELECT kind, name, count(*) AS markets, round(avg(rho), 6) AS rho,"
    " round(min(rho), 6) AS low_rho, round(max(rho), 6) AS high_rho, round(avg(cv), 6) AS mean_cv, round(min(cv), 6) AS low_cv, round(max(cv), 6) AS high_cv," + STABLE.format(cv="avg(cv)") + " FROM k GROUP BY 1, 2")
def x16_breakdown(s, d):
    """The same by class and by region: how many markets, means and ranges, stability of the mean."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("class", "region")])
    x = markets(s, d).select("rho", "cv", F.explode(kinds).alias("k")).filter("k.name is not null")
    g = x.groupBy("k.kind", "k.name").agg(F.count("*").alias("markets"), F.avg("rho").alias("rho"), F.min("rho").alias("low_rho"), F.max("rho").alias("high_rho"), F.avg("cv").alias("cv"), F.min("cv").alias("low_cv"), F.max("cv").alias("high_cv"))
    return g.select("kind", "name", "markets", r6("rho"), r6("low_rho"), r6("high_rho"), r6("mean_cv", F.col("cv")), r6("low_cv"), r6("high_cv"), stability())


@q("x17")
def x17(s, d):
    p = regime(fiedler(s, d), "fiedler", 0.25, above=False).withColumnRenamed("flag", "predicted")
    y = ew(s, d).select("grp", "ts", (F.lead("r").over(R.in_order()) > 0).cast("int").alias("y"))
    return p.join(y.filter("y is not null"), ["grp", "ts"]).filter(~train()).groupBy("grp").agg(r6("accuracy", F.avg((F.col("predicted") == F.col("y")).cast("double"))), F.count("*").alias("n"))


TYPES = base("type", upto="corr") + FEATURES + EW


@q("regime_features", TYPES + " SELECT f.grp, f.ts, round(mean_corr, 6) AS mean_corr, round(std_corr, 6) AS std_corr, round(r, 6) AS r, mean_corr > 0.05 AS tight"
    " FROM feat f JOIN ew e ON f.grp = e.grp AND f.ts = e.ts")
def regime_features(s, d):
    """The slice from rows to regime flag over the panel that is full at every scale."""
    from tessera.operators.network import network_features, rolling_corr

    x = shared("ret types", s, d, lambda: P.returns(P.clean(shared("types", s, d, lambda: P.ship_type(s, d)))))
    e = x.groupBy("grp", "ts").agg(F.avg("r").alias("r"))
    f = network_features(rolling_corr(x)).join(e, ["grp", "ts"])
    return f.select("grp", "ts", r6("mean_corr"), r6("std_corr"), r6("r"), (F.col("mean_corr") > 0.05).alias("tight"))
