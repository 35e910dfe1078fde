"""Sources, panel shaping, windows and ranking (S, P, W, K)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import rolling as R
from tessera.operators import scan
from tessera.plans.oracle import EW, base
from tessera.plans.registry import query
from tessera.sources import panel as P

B, RET, COR = base(upto="bars"), base(), base(upto="corr")


def r6(name: str, c=None, n: int = 6):
    return F.round(F.col(name) if c is None else c, n).alias(name)


def raw(s, d):
    return P.ship_brand(s, d)


def bars(s, d):
    """Kept, as shaping a panel reads its bars many times over."""
    return shared("bars", s, d, lambda: P.ship_brand(s, d))


def nation(s, d):
    return shared("nation", s, d, lambda: P.nation(s, d))


def clean(s, d):
    return P.clean(bars(s, d))


def scratch(s, name):
    """A path of its own in the folder that driver and executors share, spark.checkpoint.dir. Where it is unset, a session
    on one machine uses a folder of the warehouse; a cluster is refused."""
    found = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = s.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{s.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_SHARED: dict = {}


def release(but: tuple | None = None) -> None:
    """Forget what ``shared`` keeps, but for the session and folder ``but``. The tables stay, as frames made from them may
    still be read."""
    for key in [k for k in list(_SHARED) if k[:2] != but]:
        del _SHARED[key]


def _there(s, path) -> bool:
    p = s._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).exists(p)


def shared(name, s, d, build):
    """What several queries of a session start from is written once and read again instead of being computed by each; what
    belongs to another folder or session is forgotten first.

    A table has no past. Frames that are only cached carry their whole plan along, each use of each anew, and the plans of
    frames kept on top of each other outgrew the driver."""
    key = (s.sparkContext.applicationId, d, name)
    if key in _SHARED and _there(s, _SHARED[key][0]):
        return _SHARED[key][1]
    release(key[:2])
    df, path = build(), scratch(s, re.sub(r"\W+", "_", name))
    df.write.option("compression", "zstd").parquet(path)
    _SHARED[key] = path, s.read.schema(df.schema).parquet(path)
    return _SHARED[key][1]


def ret(s, d, log=True):
    return shared(f"ret{log}", s, d, lambda: P.returns(clean(s, d), log))


def ew(s, d):
    """Equal-weight return of each group."""
    return shared("ew", s, d, lambda: ret(s, d).groupBy("grp", "ts", "t_idx").agg(F.avg("r").alias("r")))


def q(name, sql):
    return query(name, sql)


@q("s01", B + " SELECT grp, asset, ts, round(px, 4) AS px FROM bars")
def s01(s, d):
    return raw(s, d).select("grp", "asset", "ts", r6("px", n=4))


@q("s02", "WITH a AS (SELECT o_custkey % 5 AS asset, o_orderdate AS ts, o_totalprice AS px FROM orders), b AS (SELECT asset"
    ", date_trunc('month', ts)::TIMESTAMP AS ts, round(avg(px), 4) AS px, count(*) AS n, FALSE AS failed FROM a WHERE px IS NOT NULL"
    " GROUP BY 1, 2) SELECT * FROM b UNION ALL SELECT asset, NULL, NULL, 0, TRUE FROM (SELECT unnest(range(7)) AS asset)"
    " WHERE asset NOT IN (SELECT asset FROM b)")
def s02(s, d):
    """Seven assets are asked for one by one, three tries each; two are not there and are returned as failed."""
    o = P.table(s, d, "orders")

    def one(asset):
        x = o.filter((F.col("o_custkey") % 5 == asset) & F.col("o_totalprice").isNotNull())
        return x.select(F.lit(asset).cast("long").alias("asset"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("px"))

    got, failed = P.fetch(one, range(7), tries=3)
    out = got.groupBy("asset", F.date_trunc("month", "ts").alias("ts")).agg(r6("px", F.avg("px"), 4), F.count("*").alias("n")).withColumn("failed", F.lit(False))
    missing = s.createDataFrame([(a, None, None, 0, True) for a in failed], out.schema)
    return out.unionByName(missing)


@q("s03", "SELECT event_type AS asset, time_bucket(INTERVAL '5 minutes', ts)::TIMESTAMP AS ts, round(avg(value), 6) AS px,"
    " round(arg_max(value, (ts, event_id)), 6) AS last_px, count(*) AS n FROM events GROUP BY 1, 2")
def s03(s, d):
    return P.event_bars(s, d, 5).select("asset", "ts", r6("px"), r6("last_px"), "n")


@q("s05", "WITH f AS (SELECT date_trunc('week', l_shipdate)::TIMESTAMP AS ts, avg(l_discount) AS mkt, avg(l_tax) AS smb FROM lineitem"
    " GROUP BY 1), m AS (SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS ts, avg(o_totalprice) / 1e6 AS umd FROM orders"
    " GROUP BY 1) SELECT f.ts, round(mkt / 100, 8) AS mkt, round(smb / 100, 8) AS smb, round(umd / 100, 8) AS umd FROM f"
    " JOIN m ON f.ts = m.ts")
def s05(s, d):
    a, b = factors(s, d)
    return a.join(b, "ts").select("ts", *[r6(c, F.col(c) / 100, 8) for c in ("mkt", "smb", "umd")])


def factors(s, d):
    a = P.table(s, d, "lineitem").groupBy(F.date_trunc("week", "l_shipdate").alias("ts")).agg(F.avg("l_discount").alias("mkt"), F.avg("l_tax").alias("smb"), (F.avg("l_quantity") / 1e3).alias("hml"), (F.avg("l_extendedprice") / 1e7).alias("rmw"), (F.min("l_extendedprice") / 1e8).alias("rf"))
    b = P.table(s, d, "orders").groupBy(F.date_trunc("week", "o_orderdate").alias("ts")).agg((F.avg("o_totalprice") / 1e6).alias("umd"), (F.stddev_samp("o_totalprice") / 1e7).alias("cma"))
    return a, b


@q("s12", "SELECT DISTINCT 'B' || ((regexp_extract(p_brand, '(\\d+)', 1)::INT - 1) // 5) AS grp, p_brand AS asset, ((regexp_extract(p_brand"
    ", '(\\d+)', 1)::INT - 1) % 5)::INT AS ord FROM part")
def s12(s, d):
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") - 1
    return P.table(s, d, "part").select(F.concat(F.lit("B"), F.floor(n / 5).cast("string")).alias("grp"), F.col("p_brand").alias("asset"), (n % 5).cast("int").alias("ord")).distinct()


@q("p01", "SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS day, l_extendedprice AS px FROM lineitem")
def p01(s, d):
    return P.table(s, d, "lineitem").select(F.date_trunc("day", "l_shipdate").alias("day"), F.col("l_extendedprice").alias("px"))


@q("p02", base("nation") + " SELECT grp, asset FROM cover")
def p02(s, d):
    return P.coverage(nation(s, d))


@q("p03", base("nation") + " SELECT grp, asset, ts, round(px, 4) AS px FROM filled")
def p03(s, d):
    p = nation(s, d)
    return P.forward_fill(p.join(P.coverage(p), ["grp", "asset"], "left_semi")).select("grp", "asset", "ts", r6("px", n=4))


@q("p04", base("nation") + " SELECT grp, asset, ts, round(px, 4) AS px FROM panel")
def p04(s, d):
    return P.clean(nation(s, d)).select("grp", "asset", "ts", r6("px", n=4))


@q("p05", base("nation", upto="bars") + " SELECT grp, ts, count(px)::BIGINT AS n FROM bars GROUP BY 1, 2 HAVING count(px) > 0")
def p05(s, d):
    return nation(s, d).groupBy("grp", "ts").agg(F.count("px").alias("n")).filter("n > 0")


@q("p06", RET + " SELECT grp, asset, ts, round(px / lag(px) OVER w - 1, 6) AS r FROM panel WINDOW w AS (PARTITION BY grp, asset ORDER BY ts) QUALIFY lag(px) OVER w IS NOT NULL")
def p06(s, d):
    return ret(s, d, log=False).select("grp", "asset", "ts", r6("r"))


@q("p07", RET + " SELECT grp, asset, ts, t_idx, round(r, 6) AS r FROM ret")
def p07(s, d):
    return ret(s, d).select("grp", "asset", "ts", "t_idx", r6("r"))


@q("p08", RET + " SELECT grp, asset, ts, round(r, 6) AS r, ts <= TIMESTAMP '1998-12-31' AS train FROM ret WHERE ts <= TIMESTAMP '1998-12-31' OR ts >= TIMESTAMP '2000-01-01'")
def p08(s, d):
    train = F.col("ts") <= F.lit(P.TRAIN_END).cast("timestamp_ntz")
    return ret(s, d).filter(train | (F.col("ts") >= F.lit("2000-01-01").cast("timestamp_ntz"))).select("grp", "asset", "ts", r6("r"), train.alias("train"))


@q("p09", base("nation") + " SELECT grp, count(DISTINCT asset) AS assets, count(DISTINCT ts) AS dates FROM panel GROUP BY grp HAVING"
    " count(DISTINCT asset) >= 4 AND count(DISTINCT ts) >= 100")
def p09(s, d):
    return P.clean(nation(s, d)).groupBy("grp").agg(F.count_distinct("asset").alias("assets"), F.count_distinct("ts").alias("dates")).filter("assets >= 4 and dates >= 100")


@q("p10", COR + " SELECT grp, ts, a, b, round(rho, 6) AS rho FROM corr WHERE (t_idx - 60) % 20 = 0")
def p10(s, d):
    from tessera.operators import network as N

    return N.strided_corr(ret(s, d)).select("grp", "ts", "a", "b", r6("rho"))


@q("p11", "WITH e AS (SELECT * FROM events WHERE hour(ts) * 60 + minute(ts) BETWEEN 570 AND 959), f AS (SELECT date_trunc('day'"
    ", ts)::TIMESTAMP AS day, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 75) SELECT day, n FROM f")
def p11(s, d):
    minute = F.hour("ts") * 60 + F.minute("ts")
    return P.table(s, d, "events").filter(minute.between(570, 959)).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n")).filter("n >= 75")


@q("p12", RET + EW + " SELECT grp, year(ts)::INT AS year, " + ", ".join(f"round(sum(r) FILTER (WHERE month(ts) = {m}), 6) AS m{m}" for m in range(1, 13)) + " FROM ew GROUP BY 1, 2")
def p12(s, d):
    wide = ew(s, d).withColumn("m", F.month("ts")).groupBy("grp", F.year("ts").alias("year")).pivot("m", list(range(1, 13))).agg(F.sum("r"))
    return wide.select("grp", "year", *[F.round(F.col(f"`{m}`"), 6).alias(f"m{m}") for m in range(1, 13)])


@q("p13", RET + EW + " SELECT grp, ts, round(r, 6) AS r FROM ew")
def p13(s, d):
    return ew(s, d).select("grp", "ts", r6("r"))


@q("p14", "SELECT DISTINCT 'resid_' || lower(replace(p_brand, '#', '_')) AS label, string_split(p_type, ' ')[1] AS first_word,"
    " upper(p_brand[1:1]) || lower(p_brand[2:]) AS title FROM part")
def p14(s, d):
    return P.table(s, d, "part").select(F.concat(F.lit("resid_"), F.lower(F.regexp_replace("p_brand", "#", "_"))).alias("label"), F.split("p_type", " ")[0].alias("first_word"), F.initcap("p_brand").alias("title")).distinct()


@q("p15", RET + EW + " SELECT grp, date_trunc('month', ts)::TIMESTAMP AS month, round(sum(r), 6) AS r FROM ew GROUP BY 1, 2")
def p15(s, d):
    return ew(s, d).groupBy("grp", F.date_trunc("month", "ts").alias("month")).agg(r6("r", F.sum("r")))


@q("p16", COR + " SELECT grp, ts, a, b, round(least(2.0, greatest(0.0, rho)), 4) AS rho FROM corr")
def p16(s, d):
    return corr(s, d).select("grp", "ts", "a", "b", r6("rho", F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.col("rho"))), 4))


def corr(s, d, **k):
    from tessera.operators import network as N

    return shared(f"corr{k}", s, d, lambda: N.rolling_corr(ret(s, d), **k))


@q("p17", RET + " SELECT grp, asset, round(avg(r), 6) AS m, CASE WHEN avg(r) > 0.0005 THEN 'Success' WHEN"
    " avg(r) > 0 THEN 'Marginal' ELSE 'Failed' END AS label FROM ret GROUP BY 1, 2")
def p17(s, d):
    m = F.col("m")
    return ret(s, d).groupBy("grp", "asset").agg(F.avg("r").alias("m")).select("grp", "asset", r6("m"), F.when(m > 0.0005, "Success").when(m > 0, "Marginal").otherwise("Failed").alias("label"))


@q("p18", RET + ", v AS (SELECT grp, asset, stddev_samp(r) AS v FROM ret GROUP BY 1, 2) SELECT grp, asset, round((v - min(v) OVER ()) / (max(v)"
    " OVER () - min(v) OVER ()), 6) AS up, round(1 - (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS down FROM v")
def p18(s, d):
    v = ret(s, d).groupBy("grp", "asset").agg(F.stddev_samp("r").alias("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    unit = F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo"))
    return v.join(F.broadcast(ends)).select("grp", "asset", F.round(unit, 6).alias("up"), F.round(1 - unit, 6).alias("down"))  # one row


WIN = "WINDOW w AS (PARTITION BY grp ORDER BY t_idx)"


@q("w01", RET + EW + f" SELECT grp, ts, round(lag(r) OVER w, 6) AS prev FROM ew {WIN}")
def w01(s, d):
    return ew(s, d).select("grp", "ts", r6("prev", F.lag("r").over(R.in_order())))


@q("w02", RET + EW + f" SELECT grp, ts, round(lead(r) OVER w, 6) AS next1, round(lead(r, 5) OVER w, 6) AS next5, coalesce((lead(r) OVER w > 0)::INT, -1) AS up FROM ew {WIN}")
def w02(s, d):
    w = R.in_order()
    return ew(s, d).select("grp", "ts", r6("next1", F.lead("r").over(w)), r6("next5", F.lead("r", 5).over(w)), F.coalesce((F.lead("r").over(w) > 0).cast("int"), F.lit(-1)).alias("up"))


def _roll(n):
    f = f"OVER (PARTITION BY grp ORDER BY t_idx ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count(r) {f} >= {n} THEN round(avg(r) {f}, 6) END AS m{n}, CASE WHEN count(r) {f} >= {n} THEN round(stddev_samp(r) {f}, 6) END AS s{n}"


@q("w03", RET + EW + " SELECT grp, ts, " + ", ".join(map(_roll, (20, 30, 60))) + " FROM ew")
def w03(s, d):
    x = F.col("r")
    return ew(s, d).select("grp", "ts", *[c for n in (20, 30, 60) for c in (r6(f"m{n}", R.rolling_mean(x, n)), r6(f"s{n}", R.rolling_std(x, n)))])


@q("w04", RET + EW + " SELECT grp, ts, CASE WHEN count(r) OVER w >= 60 THEN round(quantile_cont(r, 0.75) OVER w, 6) END AS p75"
    " FROM ew WINDOW w AS (PARTITION BY grp ORDER BY t_idx ROWS UNBOUNDED PRECEDING)")
def w04(s, d):
    return R.expanding_quantile(ew(s, d), "r", 0.75, "p75").select("grp", "ts", r6("p75"))


CUM = (
    EW + ", cum AS (SELECT grp, ts, t_idx, r, product(1 + r) OVER (PARTITION BY grp ORDER BY t_idx ROWS UNBOUNDED PRECEDING) AS cum FROM ew)"
    ", dd AS (SELECT *, cum / max(cum) OVER (PARTITION BY grp ORDER BY t_idx ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM cum)"
)


@q("w05", RET + CUM + " SELECT grp, ts, round(cum, 6) AS cum FROM cum")
def w05(s, d):
    return scan.equity(ew(s, d), "r").select("grp", "ts", r6("cum"))


@q("w06", RET + CUM + " SELECT grp, ts, round(dd, 6) AS dd FROM dd")
def w06(s, d):
    return scan.drawdown(ew(s, d), "r").select("grp", "ts", r6("dd"))


@q("w07", RET + EW + f" SELECT grp, ts, round(abs(r - lag(r) OVER w), 6) AS step FROM ew {WIN}")
def w07(s, d):
    return ew(s, d).select("grp", "ts", r6("step", F.abs(F.col("r") - F.lag("r").over(R.in_order()))))


F60 = "OVER (PARTITION BY grp ORDER BY t_idx ROWS 59 PRECEDING)"


@q("w08", RET + EW + f" SELECT * FROM (SELECT grp, ts, CASE WHEN count(r) {F60} >= 60 THEN round((r - avg(r) {F60}) / stddev_samp(r) {F60}, 6) END AS z"
    f" FROM ew) WHERE z IS NOT NULL")
def w08(s, d):
    return ew(s, d).select("grp", "ts", r6("z", R.z_score(F.col("r"), 60))).filter("z is not null")


@q("w09", RET + EW + f" SELECT grp, ts, CASE WHEN count(r) {F60} >= 60 THEN round((r - avg(r) {F60}) / (stddev_pop(r) {F60} + 1e-9), 6) END AS z FROM ew")
def w09(s, d):
    return ew(s, d).select("grp", "ts", r6("z", R.z_score(F.col("r"), 60, pop=True)))


@q("w10", RET + EW + ", p AS (SELECT *, (r > 0)::INT AS raw FROM ew) SELECT grp, ts, last_value(CASE WHEN t_idx % 5 = 0 THEN raw END IGNORE NULLS)"
    " OVER (PARTITION BY grp ORDER BY t_idx ROWS UNBOUNDED PRECEDING) AS pos FROM p")
def w10(s, d):
    return scan.hold(ew(s, d), F.when(F.col("t_idx") % 5 == 0, (F.col("r") > 0).cast("int")), "pos").select("grp", "ts", "pos")


F252 = "OVER (PARTITION BY grp ORDER BY t_idx ROWS 251 PRECEDING)"


@q("w11", RET + EW + f" SELECT grp, ts, CASE WHEN count(r) {F252} >= 252 THEN round(avg(r) {F252} / stddev_samp(r) {F252} * sqrt(252), 6) END AS sharpe FROM ew")
def w11(s, d):
    x, w = F.col("r"), R.past(252)
    return ew(s, d).select("grp", "ts", r6("sharpe", R.full(F.try_divide(F.avg(x).over(w), F.stddev_samp(x).over(w)) * F.sqrt(F.lit(252.0)), x, w, 252)))


@q("w12", RET + " SELECT grp, asset, ts, CASE WHEN count(r) OVER w >= 20 THEN round(sum(r) OVER w, 6) END AS mom20"
    " FROM ret WINDOW w AS (PARTITION BY grp, asset ORDER BY t_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def w12(s, d):
    w = R.past(20, keys=("grp", "asset"), skip=1)
    return ret(s, d).select("grp", "asset", "ts", r6("mom20", R.full(F.sum("r").over(w), F.col("r"), w, 20)))


RV = (
    ", rv AS (SELECT grp, ts, t_idx, avg(s) * sqrt(252) AS rv FROM (SELECT grp, asset, ts, t_idx, stddev_samp(r) OVER (PARTITION BY grp"
    ", asset ORDER BY t_idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS s FROM ret) WHERE t_idx >= 60 GROUP BY 1, 2, 3)"
)


def realized_vol(rets, window=60):
    sd = F.stddev_samp("r").over(R.past(window, keys=("grp", "asset"), skip=1))
    return rets.withColumn("s", sd).filter(F.col("t_idx") >= window).groupBy("grp", "ts", "t_idx").agg((F.avg("s") * F.sqrt(F.lit(252.0))).alias("rv"))


@q("w13", RET + RV + " SELECT grp, ts, round(rv, 6) AS rv FROM rv")
def w13(s, d):
    return realized_vol(ret(s, d)).select("grp", "ts", r6("rv"))


@q("w14", RET + " SELECT grp, ts, (dense_rank() OVER (PARTITION BY grp ORDER BY ts) - 1)::INT AS pos FROM ret")
def w14(s, d):
    return ret(s, d).select("grp", "ts", (F.dense_rank().over(Window.partitionBy("grp").orderBy("ts")) - 1).cast("int").alias("pos"))


@q("w15", RET + CUM + " SELECT grp, round(arg_max(cum, t_idx), 6) AS final FROM cum GROUP BY grp")
def w15(s, d):
    return ew(s, d).withColumn("cum", R.equity(F.col("r"))).groupBy("grp").agg(r6("final", F.max_by("cum", "t_idx")))


@q("w16", RET + EW + ", sm(grp, t_idx, v) AS (SELECT grp, t_idx, r FROM ew WHERE t_idx = 0 UNION ALL SELECT e.grp, e.t_idx, 0.85 * e.r + 0.15 * s.v"
    " FROM sm s JOIN ew e ON e.grp = s.grp AND e.t_idx = s.t_idx + 1) SELECT grp, t_idx, round(v, 6) AS v FROM sm")
def w16(s, d):
    return scan.recurrence(ew(s, d), "r", 0.85, 0.15, "v").select("grp", "t_idx", r6("v"))


LS = (
    ", k AS (SELECT grp, asset, ts, row_number() OVER (PARTITION BY grp, ts ORDER BY round(r, 9), asset) AS lo, row_number()"
    " OVER (PARTITION BY grp, ts ORDER BY round(r, 9) DESC, asset DESC) AS hi FROM ret)"
)


def ranked(x, col="r"):
    v = F.round(F.col(col), 9)
    low = Window.partitionBy("grp", "ts").orderBy(v, "asset")
    high = Window.partitionBy("grp", "ts").orderBy(v.desc(), F.col("asset").desc())
    return x.withColumn("lo", F.row_number().over(low)).withColumn("hi", F.row_number().over(high))


@q("k01", RET + LS + " SELECT grp, asset, ts, CASE WHEN lo <= 2 THEN 0.5 WHEN hi <= 2 THEN -0.5 ELSE 0.0 END::DOUBLE AS w FROM k")
def k01(s, d):
    return ranked(ret(s, d)).select("grp", "asset", "ts", F.when(F.col("lo") <= 2, 0.5).when(F.col("hi") <= 2, -0.5).otherwise(0.0).alias("w"))


@q("k02", RET + LS + " SELECT grp, asset, ts, CASE WHEN hi <= 2 THEN 'top' ELSE 'bottom' END AS side FROM k WHERE hi <= 2 OR lo <= 2")
def k02(s, d):
    return ranked(ret(s, d)).filter("hi <= 2 or lo <= 2").select("grp", "asset", "ts", F.when(F.col("hi") <= 2, "top").otherwise("bottom").alias("side"))


VOL = ", v AS (SELECT grp, asset, stddev_samp(r) AS vol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM ret GROUP BY 1, 2)"


def vols(s, d):
    return ret(s, d).groupBy("grp", "asset").agg(F.stddev_samp("r").alias("vol"), (F.try_divide(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.lit(252.0))).alias("sharpe"))


@q("k03", RET + VOL + " SELECT grp, asset, round(vol, 6) AS vol, row_number() OVER (ORDER BY round(vol, 9), asset)::INT AS place FROM v ORDER BY place")
def k03(s, d):
    return vols(s, d).select("grp", "asset", r6("vol"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("vol", 9), "asset")).cast("int").alias("place")).orderBy("place")


@q("k04", RET + VOL + " SELECT grp, arg_max(asset, (round(sharpe, 9), asset)) AS best, round(max(sharpe), 6) AS sharpe FROM v GROUP BY grp")
def k04(s, d):
    return vols(s, d).groupBy("grp").agg(F.max_by("asset", F.struct(F.round("sharpe", 9), "asset")).alias("best"), r6("sharpe", F.max("sharpe")))


@q("k05", RET + EW + ", m AS (SELECT grp, round(avg(r) / stddev_samp(r), 9) AS s FROM ew GROUP BY grp), n AS (SELECT *, max((s > 0)::INT)"
    " OVER () AS any_up, row_number() OVER (ORDER BY (s > 0)::INT DESC, s DESC, grp) AS by_s, row_number() OVER (ORDER BY grp) AS by_g"
    " FROM m) SELECT grp FROM n WHERE CASE WHEN any_up = 1 THEN s > 0 AND by_s <= 3 ELSE by_g <= 3 END")
def k05(s, d):
    return best_groups(ew(s, d))


def best_groups(x):
    """grp of up to three groups with the greatest positive ratio of mean to deviation of ``r``; without any, the first three."""
    m = x.groupBy("grp").agg(F.round(F.try_divide(F.avg("r"), F.stddev_samp("r")), 9).alias("s"))
    every = Window.partitionBy(F.lit(0))
    m = m.withColumn("any_up", F.max((F.col("s") > 0).cast("int")).over(every)).withColumn("by_s", F.row_number().over(every.orderBy((F.col("s") > 0).cast("int").desc(), F.col("s").desc(), "grp"))).withColumn("by_g", F.row_number().over(every.orderBy("grp")))
    return m.filter(((F.col("any_up") == 1) & (F.col("s") > 0) & (F.col("by_s") <= 3)) | ((F.col("any_up") == 0) & (F.col("by_g") <= 3))).select("grp")
