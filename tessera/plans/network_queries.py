"""Correlation networks and topology (C, T)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import network as N
from tessera.operators import rolling as R
from tessera.operators import spectral as S
from tessera.plans.oracle import DIST, FEATURES, H1, base
from tessera.plans.panel_queries import corr, ew, r6, ret, shared
from tessera.plans.registry import query as q

COR, RET = base(upto="corr"), base()
TAU = 0.1  # these panels are nearly independent; the default of 0.3 leaves few edges


def vectors(s, d):
    return shared("vectors", s, d, lambda: N.corr_vectors(corr(s, d)))


@q("c01", COR + " SELECT grp, ts, a, b, round(rho, 6) AS rho FROM corr")
def c01(s, d):
    return corr(s, d).select("grp", "ts", "a", "b", r6("rho"))


@q("c02", base(upto="corr", inclusive=True) + " SELECT grp, ts, a, b, round(rho, 6) AS rho FROM corr")
def c02(s, d):
    return corr(s, d, inclusive=True).select("grp", "ts", "a", "b", r6("rho"))


@q("c03", COR + FEATURES + " SELECT grp, ts, round(mean_corr, 6) AS mean_corr FROM feat")
def c03(s, d):
    return N.network_features(corr(s, d)).select("grp", "ts", r6("mean_corr"))


@q("c04", COR + " SELECT grp, ts, round(stddev_pop(rho), 6) AS pop, round(stddev_samp(rho), 6) AS samp FROM corr GROUP BY 1, 2")
def c04(s, d):
    return corr(s, d).groupBy("grp", "ts").agg(r6("pop", F.stddev_pop("rho")), r6("samp", F.stddev_samp("rho")))


ALL = ", pr AS (SELECT x.grp, x.asset AS a, y.asset AS b, corr(x.r, y.r) AS rho FROM ret x JOIN ret y ON x.grp = y.grp AND x.ts = y.ts AND x.asset < y.asset GROUP BY 1, 2, 3)"


def whole_corr(rets):
    return N.pairs(rets).groupBy("grp", "a", "b").agg(N.pair_corr("ra", "rb").alias("rho"))


@q("c05", RET + ALL + " SELECT grp, round(avg(rho), 6) AS mean, round(min(rho), 6) AS low, round(max(rho), 6) AS high, count(*) AS n FROM pr GROUP BY 1")
def c05(s, d):
    return whole_corr(ret(s, d)).groupBy("grp").agg(r6("mean", F.avg("rho")), r6("low", F.min("rho")), r6("high", F.max("rho")), F.count("*").alias("n"))


@q("c06", RET + ALL + ", f AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY grp ORDER BY asset) AS o FROM ret) WHERE o <= 5), x AS (SELECT a.grp AS g1, b.grp AS g2, a.asset AS x, b.asset AS y, corr(a.r, b.r) AS rho FROM f a JOIN f b ON a.ts = b.ts AND a.grp < b.grp GROUP BY 1, 2, 3, 4)"
   ", w AS (SELECT avg(m) AS within_rho FROM (SELECT avg(rho) AS m FROM pr GROUP BY grp)), c AS (SELECT avg(rho) AS mean_cross FROM x)"
   " SELECT g1, g2, round(avg(rho), 6) AS cross_rho, round(within_rho, 6) AS within_rho, round(mean_cross, 6) AS mean_cross, round(within_rho / mean_cross, 4) AS ratio, CASE WHEN within_rho > 1.5 * mean_cross THEN 'good' ELSE 'limited' END AS label FROM x, w, c GROUP BY g1, g2, within_rho, mean_cross")
def c06(s, d):
    """Correlation across groups (their first five assets) and how much stronger it is within them."""
    first = ret(s, d).withColumn("o", F.dense_rank().over(Window.partitionBy("grp").orderBy("asset"))).filter("o <= 5")
    a = first.select("ts", F.col("grp").alias("g1"), F.col("asset").alias("x"), F.col("r").alias("ra"))
    b = first.select("ts", F.col("grp").alias("g2"), F.col("asset").alias("y"), F.col("r").alias("rb"))
    rho = a.join(b, "ts").filter("g1 < g2").groupBy("g1", "g2", "x", "y").agg(N.pair_corr("ra", "rb").alias("rho"))
    pair = rho.groupBy("g1", "g2").agg(F.avg("rho").alias("cross_rho"))
    cross = rho.agg(F.avg("rho").alias("mean_cross"))
    within = whole_corr(ret(s, d)).groupBy("grp").agg(F.avg("rho").alias("m")).agg(F.avg("m").alias("within_rho"))
    label = F.when(F.col("within_rho") > 1.5 * F.col("mean_cross"), "good").otherwise("limited")
    every = pair.join(F.broadcast(within)).join(F.broadcast(cross))  # one row each
    return every.select("g1", "g2", r6("cross_rho"), r6("within_rho"), r6("mean_cross"), r6("ratio", F.try_divide(F.col("within_rho"), F.col("mean_cross")), 4), label.alias("label"))


@q("c07", COR + DIST + " SELECT grp, ts, a, b, round(d, 6) AS d FROM dist")
def c07(s, d):
    return corr(s, d).select("grp", "ts", "a", "b", r6("d", N.distance(F.col("rho"))))


ADJ = f", e AS (SELECT grp, ts, a, b, rho FROM corr WHERE rho > {TAU} UNION ALL SELECT grp, ts, b, a, rho FROM corr WHERE rho > {TAU})"
DEG = ADJ + ", deg AS (SELECT grp, ts, a, sum(rho) AS deg FROM e GROUP BY 1, 2, 3)"
LAP = (
    DEG + ", lap AS (SELECT e.grp, e.ts, e.a, e.b, -rho / sqrt(x.deg * y.deg) AS l FROM e JOIN deg x ON e.grp = x.grp AND e.ts = x.ts"
    " AND e.a = x.a JOIN deg y ON e.grp = y.grp AND e.ts = y.ts AND e.b = y.a)"
)


@q("c08", COR + ADJ + " SELECT grp, ts, a, b, round(rho, 6) AS w FROM e")
def c08(s, d):
    return N.both_ways(corr(s, d), "rho").filter(F.col("rho") > TAU).select("grp", "ts", "a", "b", r6("w", F.col("rho")))


@q("c09", COR + DEG + ", node AS (SELECT grp, ts, a FROM corr UNION SELECT grp, ts, b FROM corr) SELECT n.grp, n.ts, n.a, round(coalesce(deg, 0)"
    ", 6) AS deg, CASE WHEN deg IS NULL THEN 1.0 ELSE round(deg, 6) END AS safe FROM node n LEFT JOIN deg d ON n.grp = d.grp"
    " AND n.ts = d.ts AND n.a = d.a")
def c09(s, d):
    return N.degrees(corr(s, d), TAU).select("grp", "ts", "a", r6("deg"), F.when(F.col("deg") == 0, 1.0).otherwise(F.round("deg", 6)).alias("safe"))


@q("c10", COR + LAP + " SELECT grp, ts, a, b, round(l, 6) AS l FROM lap")
def c10(s, d):
    return N.laplacian_edges(corr(s, d), TAU).select("grp", "ts", "a", "b", r6("l"))


@q("c11", COR + DEG + " SELECT grp, ts, a, b, round(-rho, 6) AS l FROM e UNION ALL SELECT grp, ts, a, a, round(deg, 6) FROM deg")
def c11(s, d):
    c = corr(s, d)
    off = N.laplacian_edges(c, TAU, normalized=False).select("grp", "ts", "a", "b", r6("l"))
    return off.unionByName(N.degrees(c, TAU).filter("deg > 0").select("grp", "ts", "a", F.col("a").alias("b"), r6("l", F.col("deg"))))


def _diffuse(steps=3, alpha=0.5):
    out = ", x0 AS (SELECT r.grp, r.ts, r.asset AS a, r AS x, r AS h FROM ret r JOIN (SELECT DISTINCT grp, ts FROM corr) c ON r.grp = c.grp AND r.ts = c.ts)"
    for k in range(steps):
        out += f", p{k} AS (SELECT l.grp, l.ts, l.a, sum(l * h) AS s FROM lap l JOIN x{k} x ON l.grp = x.grp AND l.ts = x.ts AND l.b = x.a GROUP BY 1, 2, 3), x{k + 1} AS (SELECT x.grp, x.ts, x.a, x.x, h - {alpha} * (h + coalesce(s, 0)) AS h FROM x{k} x LEFT JOIN p{k} p ON x.grp = p.grp AND x.ts = p.ts AND x.a = p.a)"
    return out + f", res AS (SELECT grp, ts, a AS asset, x - h AS e FROM x{steps})"


def residuals(s, d):
    return shared("residuals", s, d, lambda: S.diffusion_residuals(vectors(s, d), ret(s, d), TAU))


@q("c12", COR + LAP + _diffuse() + " SELECT grp, ts, asset, round(e, 6) AS e FROM res")
def c12(s, d):
    return residuals(s, d).select("grp", "ts", "asset", r6("e"))


@q("c13")
def c13(s, d):
    return S.spectra(vectors(s, d), TAU).select("grp", "ts", r6("fiedler"))


@q("c14")
def c14(s, d):
    return S.spectra(vectors(s, d), TAU).select("grp", "ts", r6("lap_lambda1"), r6("lap_lambda2"), r6("lap_gap"))


@q("c15", COR + " SELECT grp, ts, round(((1 + sqrt(1 + 8 * count(*))) / 2) ** 2 / ((1 + sqrt(1 + 8 * count(*))) / 2 + 2 * sum(rho * rho)), 6) AS eff_rank FROM corr GROUP BY 1, 2")
def c15(s, d):
    return S.spectra(vectors(s, d), TAU).select("grp", "ts", r6("eff_rank"))


@q("c15_spectrum")
def c15_spectrum(s, d):
    return S.spectra(vectors(s, d), TAU).select("grp", "ts", r6("corr_lambda1"), r6("corr_gap"))


@q("c16")
def c16(s, d):
    return S.mds_coordinates(vectors(s, d)).select("grp", "ts", "asset", *[r6(c) for c in "xyz"])


THR = (
    ", th AS (SELECT k, 0.1 + 0.8 * k / 19 AS t FROM range(20) v(k)), last AS (SELECT grp, max(ts) AS ts FROM corr GROUP BY grp)"
    ", c AS (SELECT corr.* FROM corr JOIN last ON corr.grp = last.grp AND corr.ts = last.ts)"
)


@q("c17", COR + THR + " SELECT grp, k::INT AS k, sum((rho > t)::INT)::BIGINT AS edges, greatest(0, sum((rho > t)::INT) - ((1 + sqrt(1 + 8 *"
    " count(*))) / 2)::INT + 1)::BIGINT AS loops FROM c, th GROUP BY 1, 2")
def c17(s, d):
    c = corr(s, d)
    last = c.join(c.groupBy("grp").agg(F.max("ts").alias("ts")), ["grp", "ts"], "left_semi")
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.struct(k.alias("k"), (0.1 + 0.8 * k / 19).alias("t"))))
    n = F.expr("cast((1 + sqrt(1 + 8 * count(*))) / 2 as int)")
    e = F.count(F.when(F.col("rho") > F.col("s.t"), 1))
    return last.withColumn("s", steps).groupBy("grp", F.col("s.k").alias("k")).agg(e.alias("edges"), F.greatest(F.lit(0), e - n + 1).alias("loops"))


@q("c18", COR + ", s AS (SELECT grp, ts, a, rho FROM corr UNION ALL SELECT grp, ts, b, rho FROM corr), m AS (SELECT grp, ts, a, (1 +"
    " sum(rho)) / (count(*) + 1) AS m FROM s GROUP BY 1, 2, 3) SELECT grp, ts, a, round(m, 6) AS m,"
    " CASE WHEN m > 0.3 THEN 'high' WHEN m > 0.2 THEN 'mid' ELSE 'low' END AS bucket FROM m")
def c18(s, d):
    m = N.both_ways(corr(s, d), "rho").groupBy("grp", "ts", "a").agg(((1 + F.sum("rho")) / (F.count("*") + 1)).alias("m"))
    return m.select("grp", "ts", "a", r6("m"), F.when(F.col("m") > 0.3, "high").when(F.col("m") > 0.2, "mid").otherwise("low").alias("bucket"))


@q("c19", RET + ", n AS (SELECT grp, count(DISTINCT asset) AS n FROM ret GROUP BY grp) SELECT grp, round((1 - sqrt(n / 60.0)) ** 2, 6) AS low,"
    " round((1 + sqrt(n / 60.0)) ** 2, 6) AS high FROM n")
def c19(s, d):
    root = F.sqrt(F.count_distinct("asset") / 60)
    return ret(s, d).groupBy("grp").agg(r6("low", F.pow(1 - root, F.lit(2))), r6("high", F.pow(1 + root, F.lit(2))))


@q("c20")
def c20(s, d):
    return S.repaired(vectors(s, d)).select("grp", "ts", F.transform("fixed", lambda x: F.round(x, 6)).cast("string").alias("fixed"))


@q("c21", RET + ", e AS (SELECT grp, ts, avg(r) AS r FROM ret GROUP BY 1, 2), p AS (SELECT x.grp AS a, y.grp AS b, corr(x.r, y.r) AS rho FROM e x"
    " JOIN e y ON x.ts = y.ts AND x.grp < y.grp GROUP BY 1, 2) SELECT a, b, round(rho, 6) AS rho, round(avg(rho) OVER ()"
    ", 6) AS mean_off, CASE WHEN rho < 0.5 THEN 'low' WHEN rho < 0.7 THEN 'moderate' ELSE 'high' END AS bucket FROM p")
def c21(s, d):
    e = ew(s, d).select(F.lit("all").alias("grp"), "ts", "t_idx", F.col("grp").alias("asset"), "r")
    p = whole_corr(e)
    return p.select("a", "b", r6("rho"), r6("mean_off", F.avg("rho").over(Window.partitionBy("grp"))), F.when(F.col("rho") < 0.5, "low").when(F.col("rho") < 0.7, "moderate").otherwise("high").alias("bucket"))


def diagrams(s, d, limit=None):
    return shared(f"diagrams{limit}", s, d, lambda: S.diagrams(vectors(s, d), limit))


def h1(s, d):
    return shared("h1", s, d, lambda: N.h1_counts(corr(s, d)))


@q("t01", COR + H1 + " SELECT grp, ts, (n_assets - 1)::INT AS h0_count, h1_count FROM h1")
def t01(s, d):
    return S.topology(diagrams(s, d)).select("grp", "ts", "h0_count", "h1_count")


@q("t02")
def t02(s, d):
    return S.topology(diagrams(s, d, 1.35)).select("grp", "ts", "h0_count", "h1_count", "h1_essential", r6("h1_total"))


def long_bars(s, d):
    return diagrams(s, d).select("grp", "ts", F.explode("diagram").alias("x")).select("grp", "ts", "x.*")


@q("t03", COR + H1 + " SELECT grp, ts, (n_assets - 1 + h1_count)::BIGINT AS bars FROM h1")
def t03(s, d):
    return long_bars(s, d).filter("death is not null").groupBy("grp", "ts").agg(F.count("*").alias("bars"))


MST = DIST + """, reach(grp, ts, a, b, d, node) AS (SELECT grp, ts, a, b, d, a FROM dist UNION SELECT r.grp, r.ts, r.a, r.b, r.d, s.b FROM reach r JOIN sym s ON r.grp = s.grp AND r.ts = s.ts AND r.node = s.a AND (s.d, least(s.a, s.b), greatest(s.a, s.b)) < (r.d, r.a, r.b)),
mst AS (SELECT e.* FROM dist e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.grp = e.grp AND r.ts = e.ts AND r.a = e.a AND r.b = e.b AND r.node = e.b))"""


@q("t04", COR + MST + " SELECT grp, ts, count(*)::INT AS h0_count, round(sum(d), 6) AS h0_total, round(max(d), 6) AS h0_max FROM mst GROUP BY 1, 2")
def t04(s, d):
    return S.topology(diagrams(s, d)).select("grp", "ts", "h0_count", r6("h0_total"), r6("h0_max"))


@q("t05", COR + H1 + " SELECT grp, ts, h1_count, greatest(h1_count, 1) AS h1_count_ref FROM h1")
def t05(s, d):
    """The count with the placeholder of one bar for an empty diagram beside the true one."""
    return h1(s, d).select("grp", "ts", "h1_count", F.greatest("h1_count", F.lit(1)).alias("h1_count_ref"))


@q("t05_births", COR + H1 + MST.replace(DIST, "") + ", b AS (SELECT r.grp, r.ts, r.d FROM rng r WHERE NOT EXISTS (SELECT 1 FROM mst m WHERE m.grp = r.grp AND m.ts = r.ts AND m.a = r.a"
    " AND m.b = r.b)) SELECT grp, ts, count(*)::INT AS h1_count, round(sum(d), 6) AS births FROM b GROUP BY 1, 2")
def t05_births(s, d):
    return long_bars(s, d).filter("dim = 1").groupBy("grp", "ts").agg(F.count("*").cast("int").alias("h1_count"), r6("births", F.sum("birth")))


@q("t05_lifetimes")
def t05_lifetimes(s, d):
    return S.topology(diagrams(s, d)).select("grp", "ts", "h1_count", r6("h1_total"), r6("h1_max"))


@q("t06")
def t06(s, d):
    return S.topology(diagrams(s, d)).select("grp", "ts", r6("h1_cv"))


@q("t07")
def t07(s, d):
    return S.topology(diagrams(s, d)).select("grp", "ts", r6("h1_entropy"))


@q("t08")
def t08(s, d):
    return S.diagram_distances(diagrams(s, d)).select("grp", "ts", r6("wasserstein"))


@q("t09")
def t09(s, d):
    return S.diagram_distances(diagrams(s, d)).select("grp", "ts", r6("bottleneck"))


@q("t10")
def t10(s, d):
    long = long_bars(s, d).withColumn("life", F.col("death") - F.col("birth"))
    real = F.when((F.col("dim") == 1) & (F.col("life") > 0.1), F.col("life"))
    h0 = F.count(F.when((F.col("dim") == 0) & (F.col("life").isNull() | (F.col("life") > 0.1)), 1))
    return long.groupBy("grp", "ts").agg(h0.alias("h0_count"), F.count(real).alias("h1_count"), r6("h1_mean", F.coalesce(F.avg(real), F.lit(0.0))), r6("h1_max", F.coalesce(F.max(real), F.lit(0.0))), r6("h1_std", F.coalesce(F.stddev_pop(real), F.lit(0.0))), r6("h1_cv", F.try_divide(F.stddev_pop(real), F.avg(real))))


@q("t11", COR + H1 + ", c AS (SELECT grp, stddev_samp(h1_count) / avg(h1_count) AS cv FROM h1 GROUP BY 1) SELECT grp, round(cv, 6) AS cv,"
    " round(100 * (max(cv) OVER () - cv) / max(cv) OVER (), 6) AS better FROM c")
def t11(s, d):
    c = h1(s, d).groupBy("grp").agg(F.try_divide(F.stddev_samp("h1_count"), F.avg("h1_count")).alias("cv"))
    top = F.max("cv").over(Window.partitionBy(F.lit(0)))
    return c.select("grp", r6("cv"), r6("better", 100 * F.try_divide(top - F.col("cv"), top)))


F30 = "OVER (PARTITION BY grp ORDER BY ts ROWS 29 PRECEDING)"


@q("t12", COR + H1 + f" SELECT grp, ts, CASE WHEN count(h1_count) {F30} >= 30 THEN round(stddev_samp(h1_count) {F30}, 6) END AS vol FROM h1")
def t12(s, d):
    return h1(s, d).select("grp", "ts", r6("vol", R.rolling_std(F.col("h1_count"), 30, order="ts")))


@q("t13")
def t13(s, d):
    """The data (repetition 0) and 100 permutations of it."""
    return S.null_model(ret(s, d), reps=100, seed=42).select("grp", "rep", r6("mean_corr"), "h1_count", r6("h1_total"), r6("h1_cv"))


@q("t14")
def t14(s, d):
    return long_bars(s, d).select("grp", "ts", "dim", r6("birth"), r6("death"), r6("life", F.col("death") - F.col("birth")))


@q("t15", COR + FEATURES + " SELECT grp, ts, mean_corr < 0.5 OR std_corr > 0.2 AS ghost FROM feat")
def t15(s, d):
    return N.network_features(corr(s, d)).select("grp", "ts", ((F.col("mean_corr") < 0.5) | (F.col("std_corr") > 0.2)).alias("ghost"))


@q("t15_formal")
def t15_formal(s, d):
    f = S.topology(diagrams(s, d)).join(N.network_features(corr(s, d)), ["grp", "ts"]).join(S.spectra(vectors(s, d), TAU).select("grp", "ts", "corr_gap"), ["grp", "ts"])
    return f.select("grp", "ts", ((F.col("mean_corr") < 0.5) | (F.col("std_corr") > 0.2) | (F.col("corr_gap") < 2.0)).alias("ghost"), F.coalesce((F.col("h1_cv") > 0.55) & (F.col("mean_corr") < 0.5), F.lit(False)).alias("formal"))


@q("t16", COR + FEATURES + " SELECT grp, ts, CASE WHEN mean_corr > 0 AND mean_corr < 1 THEN round(0.35 / sqrt(mean_corr * (1 - mean_corr)), 6) END AS bound FROM feat")
def t16(s, d):
    m = F.col("mean_corr")
    return N.network_features(corr(s, d)).select("grp", "ts", r6("bound", F.when((m > 0) & (m < 1), 0.35 / F.sqrt(m * (1 - m)))))


def cv_and_rho(s, d):
    m = F.col("mean_corr")
    f = S.topology(diagrams(s, d)).join(N.network_features(corr(s, d)), ["grp", "ts"]).filter((m > 0) & (m < 1) & F.col("h1_cv").isNotNull())
    return f.withColumn("scaled", F.col("h1_cv") * F.sqrt(m * (1 - m)))


@q("t16_fitted")
def t16_fitted(s, d):
    f = cv_and_rho(s, d)
    a = f.groupBy("grp").agg(F.avg("scaled").alias("alpha"))
    return f.join(a, "grp").groupBy("grp").agg(r6("alpha", F.first("alpha")), F.count(F.when(F.col("scaled") > F.col("alpha"), 1)).alias("over"), F.count("*").alias("n"))


@q("t17")
def t17(s, d):
    w = R.past(30, order="t_idx")
    return cv_and_rho(s, d).select("grp", "ts", r6("snr", F.try_divide(F.lit(1.0), F.col("h1_cv"))), r6("alpha", F.avg("scaled").over(w)))


@q("t18")
def t18(s, d):
    return long_bars(s, d).groupBy("grp", "ts").agg(r6("ratio", F.avg(F.when(F.col("dim") == 1, F.try_divide(F.col("birth"), F.col("death"))))), r6("h0_total", F.sum(F.when(F.col("dim") == 0, F.col("death")))))
