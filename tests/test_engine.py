import math

import numpy as np
import pytest

from tessera.functions import kernels as K


def square():
    r = math.sqrt(2)
    return np.array([[0, 1, r, 1], [1, 0, 1, r], [r, 1, 0, 1], [1, r, 1, 0]])


def test_square_has_one_loop():
    d = K.persistence(square())
    assert sorted(b[2] for b in d if b[0] == 0 and b[2]) == [1, 1, 1]
    assert [b[1:] for b in d if b[0] == 1] == [(1.0, pytest.approx(math.sqrt(2)))]


def test_equidistant_points_have_no_loop():
    d = np.ones((5, 5)) - np.eye(5)
    assert not [b for b in K.persistence(d) if b[0] == 1]


def test_complete_graph_spectrum():
    c = np.full((5, 5), 0.5) + 0.5 * np.eye(5)
    assert K.spectrum(c)["fiedler"] == pytest.approx(5 / 4)


def test_isolated_node_keeps_unit_diagonal():
    c = np.eye(3)
    c[0, 1] = c[1, 0] = 0.8
    assert K.laplacian(c)[2, 2] == 1.0


def test_distribution_tails():
    assert K.t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert K.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert K.f_upper(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)


def test_assignment_is_least():
    rng = np.random.default_rng(1)
    from itertools import permutations

    for _ in range(20):
        c = rng.random((5, 5))
        assert K.assignment(c) == pytest.approx(min(sum(c[i, p[i]] for i in range(5)) for p in permutations(range(5))))


def test_diagram_distances():
    assert K.wasserstein([[0, 1]], [[0, 1]]) == 0
    assert K.bottleneck([[0.0, 1.0]], [[0.0, 1.2]]) == pytest.approx(0.2)
    assert K.wasserstein([], [[0, 1]]) == 0


def plain_bars(d, limit=np.inf):
    """All triangles, and the boundary matrix over two elements reduced column by column."""
    n = len(d)
    edges = sorted((d[i, j], (i, j)) for i in range(n) for j in range(i + 1, n) if d[i, j] <= limit)
    row = {e: k for k, (_, e) in enumerate(edges)}
    faces = sorted((max(d[i, j], d[i, k], d[j, k]), [row[i, j], row[i, k], row[j, k]]) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n) if {(i, j), (i, k), (j, k)} <= row.keys())

    def reduced(columns):
        lows = {}
        for value, column in columns:
            column = set(column)
            while column and max(column) in lows:
                column ^= lows[max(column)][1]
            if column:
                lows[max(column)] = value, column
        return lows

    zero, one = reduced([(v, e) for v, e in edges]), reduced(faces)
    negative, seen = set(), {}
    for k, (_, e) in enumerate(edges):
        column = set(e)
        while column and max(column) in seen:
            column ^= seen[max(column)]
        if column:
            seen[max(column)] = column
            negative.add(k)
    out = [(0, 0.0, float(edges[k][0])) for k in negative if edges[k][0] > 0] + [(0, 0.0, None)] * (n - len(zero))
    for k in set(range(len(edges))) - negative:
        death = one[k][0] if k in one else None
        if death is None or death > edges[k][0]:
            out.append((1, float(edges[k][0]), None if death is None else float(death)))
    return sorted(out, key=str)


def test_bars_are_those_of_the_boundary_matrix():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 9, 14):
        for kind in range(4):
            x = rng.normal(size=(n, 2 if kind else 6))
            d = np.linalg.norm(x[:, None] - x[None], axis=2)
            if kind == 2:
                d = np.round(d, 1)  # ties
            if kind == 3 and n > 2:
                a = np.arange(n) * 2 * np.pi / n
                x = np.stack([np.cos(a), np.sin(a)], axis=1)
                d = np.round(np.linalg.norm(x[:, None] - x[None], axis=2), 9)
            for limit in (np.inf, float(np.median(d)), 0.0):
                assert sorted(((k, b, e) for k, b, e in K.persistence(d, limit)), key=str) == plain_bars(d, limit), (n, kind, limit)
    assert K.persistence(np.zeros((4, 4))) == [(0, 0.0, None)]


def plain_distances(p, q):
    """Both distances over all bars and as many places on the diagonal, by assignment."""
    n, m = len(p), len(q)
    made = []
    for power in (2, np.inf):
        c = np.zeros((n + m, n + m))
        for i in range(n + m):
            for j in range(n + m):
                if i < n and j < m:
                    c[i, j] = np.linalg.norm(p[i] - q[j], power)
                elif i < n or j < m:
                    bar = p[i] if i < n else q[j]
                    c[i, j] = (bar[1] - bar[0]) / (np.sqrt(2) if power == 2 else 2)
        made.append(c)
    levels = np.unique(made[1])
    return K.assignment(made[0]), next(float(t) for t in levels if K.assignment((made[1] > t).astype(float)) == 0)


def test_distances_of_diagrams_are_plain_matchings():
    rng = np.random.default_rng(12)
    for n, m in [(1, 1), (1, 4), (3, 2), (6, 6), (9, 4), (12, 15), (20, 20)]:
        for scale in (0.05, 0.5):
            p, q = (np.stack([b := rng.random(k), b + scale * rng.random(k)], axis=1) for k in (n, m))
            q[: min(n, m) // 2] = p[: min(n, m) // 2] + rng.normal(size=(min(n, m) // 2, 1)) * 0.01
            w, b = plain_distances(p, q)
            assert K.wasserstein(p, q) == pytest.approx(w, abs=1e-9) and K.bottleneck(p, q) == pytest.approx(b, abs=1e-12)
            assert K.bottleneck(q, p) == pytest.approx(b, abs=1e-12)
    tied = np.array([[0.0, 1.0]] * 5)
    assert K.wasserstein(tied, tied) == 0 and K.bottleneck(tied, tied[:3]) == 0.5
    assert K.covers(np.zeros((0, 3), bool)) and not K.covers(np.zeros((1, 0), bool)) and not K.covers(np.ones((3, 2), bool))


def test_loop_counts_agree_with_neighbour_graph(spark):
    from pyspark.sql import functions as F

    from tessera.operators import network as N
    from tessera.operators import spectral as S

    rng = np.random.default_rng(3)
    rows = [("g", "abcdef"[k], i, i, float(x)) for i in range(40) for k, x in enumerate(rng.normal(size=6))]
    rets = spark.createDataFrame(rows, "grp string, asset string, ts int, t_idx int, r double")
    corr = N.rolling_corr(rets, 10)
    counts = {r.ts: r.h1_count for r in N.h1_counts(corr).collect()}
    bars = {r.ts: r.h1_count for r in S.topology(S.diagrams(N.corr_vectors(corr))).collect()}
    assert counts == bars and len(bars) == 30
    assert corr.filter(F.abs("rho") > 1 + 1e-12).count() == 0


def test_correlations_do_not_look_ahead(spark):
    from pyspark.sql import functions as F

    from tessera.operators import network as N

    rng = np.random.default_rng(4)
    rows = [("g", "abcd"[k], i, i, float(x)) for i in range(30) for k, x in enumerate(rng.normal(size=4))]
    rets = spark.createDataFrame(rows, "grp string, asset string, ts int, t_idx int, r double")
    changed = rets.withColumn("r", F.when(F.col("ts") >= 20, F.col("r") * 3 + 1).otherwise(F.col("r")))
    before = [N.rolling_corr(x, 10).filter("ts <= 20").orderBy("ts", "a", "b").toPandas()["rho"].to_numpy() for x in (rets, changed)]
    assert np.allclose(*before)


def test_constant_price_gives_no_correlation(spark):
    from tessera.operators import network as N

    rows = [("g", a, i, i, 0.0 if a == "x" else float(i % 3)) for i in range(15) for a in "xy"]
    c = N.rolling_corr(spark.createDataFrame(rows, "grp string, asset string, ts int, t_idx int, r double"), 10).collect()
    assert len(c) == 5 and all(r.rho is None for r in c)


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_bars_match_batch(spark, tmp_path):
    from tessera.sources.panel import table
    from tessera.streaming.bars import stream_bars

    src = table(spark, "/root/testdata/sf0.001", "events").select("ts", "event_type", "value")
    src.write.parquet(str(tmp_path / "in"))
    batch = {(r.asset, r.ts): r.n for r in stream_bars(src).collect()}
    q = stream_bars(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("bars").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.asset, r.ts): r.n for r in spark.table("bars").collect()} == batch


@pytest.mark.parametrize("inclusive", [False, True])
def test_correlations_with_gaps_and_scales_are_pandas(spark, inclusive):
    """Null and NaN on either side, a quiet stretch after a wild one, a constant stretch, windows with one pair or none."""
    import pandas as pd

    from tessera.operators import network as N
    from tessera.plans import network_queries as nq

    rng = np.random.default_rng(4)
    x = rng.normal(size=(130, 4)) + 0.5 * rng.normal(size=(130, 1))
    x[:45] *= 1e3
    x[45:] *= 1e-4
    x[70:90, 2] = 3e-5
    gaps = [(3, 0), (20, 1), (60, 1), (61, 1), (110, 0), *((k, 3) for k in range(96, 115))]
    for k, (t, c) in enumerate(gaps):
        x[t, c] = np.nan
    rows = [("g", "abcd"[k], i, i, None if (i, k) in gaps[::2] else float(x[i, k])) for i in range(130) for k in range(4)]
    rets = spark.createDataFrame(rows, "grp string, asset string, ts int, t_idx int, r double").repartition(3)

    def want(w, a, b):
        f = pd.DataFrame(w[:, ["abcd".index(a), "abcd".index(b)]]).dropna()
        if len(f) < 2 or (f.max() == f.min()).any():
            return None
        f = f - f.mean()  # pandas alone would lose digits of a small stretch
        return float((f[0] * f[1]).sum() / np.sqrt((f[0] ** 2).sum() * (f[1] ** 2).sum()))

    made = {(r.t_idx, r.a, r.b): r.rho for r in N.rolling_corr(rets, 16, inclusive).collect()}
    assert len(made) == 6 * (130 - 16 + inclusive) and sum(v is None for v in made.values()) > 5
    for (t, a, b), rho in made.items():
        v = want(x[t - 16 + inclusive : t + inclusive], a, b)
        assert (rho is None) == (v is None) and (v is None or rho == pytest.approx(v, abs=1e-9)), (t, a, b)
        if v is not None:
            whole = pd.DataFrame(x[t - 16 + inclusive : t + inclusive]).corr().iloc["abcd".index(a), "abcd".index(b)]
            assert rho == pytest.approx(whole, abs=1e-6)
    if not inclusive:
        kept = {(r.t_idx, r.a, r.b): r.rho for r in N.strided_corr(rets, 16, 10).collect()}
        assert all((v is None) == (made[k] is None) and (v is None or v == pytest.approx(made[k], abs=1e-9)) for k, v in kept.items())
        whole = {(r.a, r.b): r.rho for r in nq.whole_corr(rets).collect()}
        assert all(v == pytest.approx(want(x, *k), abs=1e-9) for k, v in whole.items())


def test_curve_and_delong_are_brute_force(spark, monkeypatch):
    from tessera.operators import roc as C
    from tessera.plans import strategy_queries as sq

    rng = np.random.default_rng(9)
    rows = []
    for g, n in (("a", 80), ("b", 41), ("one", 5)):
        for k in range(n):
            y = 1 if g == "one" else int(rng.random() < 0.4)
            rows.append((g, k, round(float(rng.normal() * 0.05 + 0.03 * y), 2), round(float(rng.normal() + y), 1), y))
    rows += [("a", 900, None, 1.0, 1), ("a", 901, float("nan"), 1.0, 0), ("a", 902, 0.1, None, 0), ("a", 903, 0.1, 0.2, None)]
    df = spark.createDataFrame(rows, "grp string, ts int, rho double, spread double, y int").repartition(4)
    curve = {(r.grp, r.threshold): (r.tpr, r.fpr) for r in C.curve(C.counted(df, "rho", "y")).collect()}
    best = {r.grp: r for r in C.best(C.counted(df, "rho", "y")).collect()}
    monkeypatch.setattr(sq, "scored", lambda s, d: df)
    p = {r.grp: r.p for r in sq.h14_delong_p(spark, "").collect()}
    two = {r.grp: r for r in C.delong(df, "rho", "spread", "y").collect()}
    for g in ("a", "b"):
        own = [(r[2], r[4]) for r in rows if r[0] == g and r[2] is not None and r[2] == r[2] and r[4] is not None]
        pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
        want = {t: (sum(s >= t for s in pos) / len(pos), sum(s >= t for s in neg) / len(neg)) for t in {s for s, _ in own}}
        assert {t: v for (k, t), v in curve.items() if k == g} == {t: pytest.approx(v) for t, v in want.items()}
        top = max(want, key=lambda t: (round(want[t][0] - want[t][1], 12), t))
        assert best[g].threshold == top and best[g].auc == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
        both = [(r[2], r[3], r[4]) for r in rows if r[0] == g and None not in r[2:] and r[2] == r[2]]
        up, down = [r for r in both if r[2]], [r for r in both if not r[2]]
        psi = [np.array([[(a[k] > b[k]) + (a[k] == b[k]) / 2 for b in down] for a in up]) for k in (0, 1)]
        v10, v01 = [m.mean(axis=1) for m in psi], [m.mean(axis=0) for m in psi]
        s10, s01 = np.cov(v10), np.cov(v01)
        var = (s10[0, 0] + s10[1, 1] - 2 * s10[0, 1]) / len(up) + (s01[0, 0] + s01[1, 1] - 2 * s01[0, 1]) / len(down)
        r = two[g]
        assert (r.auc_a, r.auc_b) == pytest.approx((psi[0].mean(), psi[1].mean())) and r.z == pytest.approx((psi[0].mean() - psi[1].mean()) / np.sqrt(var))
        assert p[g] == pytest.approx(K.normal_two_sided(r.z), abs=1e-6)
    assert best["one"].auc is None and two["one"].z is None and p["one"] is None
    assert C.delong(df.filter("false"), "rho", "spread", "y").count() == 0 and C.curve(C.counted(df.filter("false"), "rho", "y")).count() == 0


def test_adaptive_strategy_walks_the_loop(spark, monkeypatch):
    from tessera.plans import strategy_queries as sq

    rng = np.random.default_rng(6)
    n, assets = 200, "abcdef"
    r = rng.normal(size=(n, 6)) * 0.01
    loops = rng.integers(0, 9, n)
    frame = spark.createDataFrame([("g", a, i, i, float(r[i, k])) for i in range(n) for k, a in enumerate(assets)], "grp string, asset string, ts int, t_idx int, r double")
    monkeypatch.setattr(sq, "ret", lambda s, d: frame)
    monkeypatch.setattr(sq, "h1", lambda s, d: spark.createDataFrame([("g", i, 6, int(loops[i])) for i in range(n)], "grp string, ts int, n_assets int, h1_count int"))
    made = {x.ts: (x.regime, x.r) for x in sq.x13(spark, "").collect()}
    turn = 0
    for t in range(59, n):
        seen = loops[t - 59 : t + 1]
        z = (loops[t] - seen.mean()) / seen.std(ddof=1)
        past = r[t - 20 : t].sum(axis=0)
        order = np.argsort(past)
        got = 0.0
        if abs(z) > 1:
            got = (r[t, order[:2]].mean() - r[t, order[-2:]].mean()) / 2 * min(abs(z) / 2, 1)
            got -= 10 * 0.0005 if turn % 5 == 0 else 0
        assert made[t][0] == ("high_stress" if z > 1 else "low_stress" if z < -1 else "normal")
        assert made[t][1] == pytest.approx(got, abs=2e-6)
        turn += 1
    assert len(made) == n - 59 and {v[0] for v in made.values()} == {"high_stress", "low_stress", "normal"}


def test_null_model_takes_the_whole_series(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.operators.permute import shuffled_place
    from tessera.plans import network_queries as nq
    from tessera.plans import strategy_queries as sq

    rng = np.random.default_rng(7)
    n, assets = 150, "abcdefghij"
    series = rng.normal(size=(n, len(assets)))
    series[60:] += rng.normal(size=(n - 60, 1)) * 0.5  # correlated only after the first 60
    rows = [("g", a, i, i, float(series[i, k])) for i in range(n) for k, a in enumerate(assets)]
    monkeypatch.setattr(nq, "ret", lambda s, d: spark.createDataFrame(rows, "grp string, asset string, ts int, t_idx int, r double"))
    rows += [("g", "a", n, n, float("nan")), ("g", "b", n, n, 1.0), ("g", "a", n + 1, n + 1, None)]  # dates that are not complete
    at = spark.range(n).crossJoin(spark.range(1, 101).withColumnRenamed("id", "k")).select("id", F.col("k").cast("int").alias("rep"), F.lit("g").alias("grp"), F.explode(F.array(*map(F.lit, assets))).alias("asset"))
    to = at.select("id", "rep", "asset", shuffled_place(F.col("id"), F.lit(n), 42, "grp", "asset", "rep").alias("to")).toPandas()
    moved = {k: v.sort_values("id")["to"].to_numpy() for k, v in to.groupby(["rep", "asset"])}
    want = []
    for rep in range(101):  # the data and the reference's 100 permutations
        x = series.copy()
        for k, a in enumerate(assets if rep else ""):
            x[moved[rep, a], k] = series[:, k]
        c = np.corrcoef(x.T)
        lives = [e - b for k, b, e in K.persistence(K.distances(c)) if k == 1 and e is not None and e > b]
        want.append((c[np.triu_indices(len(c), 1)].mean(), len(lives), sum(lives)))
    made = {r.rep: r for r in nq.t13(spark, "").collect()}
    assert len(made) == 101
    assert all(made[i].mean_corr == pytest.approx(m, abs=1e-6) and made[i].h1_count == k and made[i].h1_total == pytest.approx(t, abs=1e-5) for i, (m, k, t) in enumerate(want))
    null = np.array([k for _, k, _ in want[1:]], float)
    (h,) = sq.h10(spark, "").collect()
    assert h.h1_count == want[0][1] and h.z_loops == pytest.approx((want[0][1] - null.mean()) / max(null.std(), 0.1), abs=1e-5)
    real, cv = made[0].h1_cv, [made[i].h1_cv or 0.0 for i in range(1, 101)]
    assert real is not None and h.cv == real and h.cv_mean == pytest.approx(np.mean(cv), abs=1e-5)
    z = (real - np.mean(cv)) / np.std(cv)
    p = K.normal_two_sided(z)
    assert h.z == pytest.approx(z, abs=1e-4) == h.cohens_d and h.p == pytest.approx(p, abs=1e-5)
    assert h.label == ("No signal" if p >= 0.05 else "Signal confirmed" if z < 0 else "Heterogeneity issue")


def test_every_asset_has_its_place(spark, monkeypatch):
    from tessera.plans import panel_queries as pq

    rows = [("g", f"a{k:04}", i, i, float((k + 1) * (-1) ** i)) for k in range(1200) for i in range(3)]
    frame = spark.createDataFrame(rows, "grp string, asset string, ts int, t_idx int, r double")
    monkeypatch.setattr(pq, "ret", lambda s, d: frame)
    made = pq.k03(spark, "").collect()
    assert [(r.asset, r.place) for r in made] == [(f"a{k:04}", k + 1) for k in range(1200)]


def test_resamples_trees_and_rounds_are_the_references(spark, monkeypatch):
    import pandas as pd

    from tessera.plans import model_queries as mq
    from tessera.plans import strategy_queries as sq

    made = mq.learners()
    assert made["forest"].getNumTrees() == 200 and made["boosting"].getMaxIter() == 200 and made["boosting"].getStepSize() == 0.05
    rng = np.random.default_rng(9)
    f = pd.DataFrame({"grp": "g", "ts": range(40), "mean_corr": rng.uniform(-0.2, 0.2, 40), "r": rng.normal(size=40)})
    monkeypatch.setattr(sq, "rho_ret", lambda s, d: spark.createDataFrame(f).coalesce(1))
    from pyspark.sql import functions as F

    from tessera.operators import regression as G

    x, y, best, plain = f["mean_corr"].to_numpy(), f["r"].to_numpy(), [], []

    def first_break(x, y):
        rss = []
        for k in range(16):
            a = np.column_stack([np.ones(len(x)), x, np.maximum(0, x + 0.15 - 0.02 * k)])
            b = np.linalg.lstsq(a, y, rcond=None)[0]
            rss.append(float(((y - a @ b) ** 2).sum()))
        return -0.15 + 0.02 * int(np.argmin(np.round(rss, 10)))

    weights = spark.createDataFrame(f[["grp", "ts"]]).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(999)))).select("ts", "rep", G.poisson_weight(42, "grp", "ts", "rep").alias("w")).toPandas()
    counts = weights.pivot(index="rep", columns="ts", values="w").to_numpy()
    assert abs(counts.mean() - 1) < 0.02 and abs(counts.var() - 1) < 0.05
    rng = np.random.default_rng(3)
    for w in counts:
        best.append(first_break(np.repeat(x, w), np.repeat(y, w)))
        i = rng.integers(0, 40, 40)
        plain.append(first_break(x[i], y[i]))
    (h,) = sq.h06(spark, "").collect()
    assert h.mean == pytest.approx(np.mean(best), abs=1e-6) and h.std == pytest.approx(np.std(best), abs=1e-6)
    assert (h.low, h.high) == pytest.approx(tuple(np.percentile(best, [2.5, 97.5])), abs=1e-6)
    assert h.mean == pytest.approx(np.mean(plain), abs=0.02) and h.std == pytest.approx(np.std(plain), abs=0.02)


def test_sharpe_errors_are_numpy(spark):
    from tessera.operators import bootstrap as Boot

    rng = np.random.default_rng(8)
    series = {"a": rng.normal(0.01, 0.1, 61), "b": 1e3 + rng.normal(size=5), "flat": np.full(7, 0.5), "one": np.array([0.1])}
    rows = [(g, 3 * i, float(v)) for g, s in series.items() for i, v in enumerate(s)] + [("a", 1, None), ("a", 2, float("nan")), ("none", 0, None)]
    df = spark.createDataFrame(rows, "grp string, t_idx int, r double")
    blocks = Boot.draws(Boot.placed(df, "r", ("grp",), "t_idx"), 30, 4.0).collect()
    made = {(x.grp, x.rep): x.sharpe for x in Boot.sharpe_bootstrap(df, reps=30, length=4.0).collect()}
    assert set(made) == {(g, k) for g in series for k in range(1, 31)}
    for g, s in series.items():
        for rep in range(1, 31):
            begins = {x.place: x.start for x in blocks if (x.grp, x.rep) == (g, rep)}
            taken, at = [], 0
            for place in range(len(s)):
                at = begins.get(place, at)
                taken.append(s[at % len(s)])
                at += 1
            spread = np.std(taken, ddof=1) if len(s) > 1 else 0
            if spread < 1e-9:
                assert made[g, rep] is None
            else:
                assert made[g, rep] == pytest.approx(np.mean(taken) / spread * 252**0.5, rel=1e-6)
    lengths = len([x for x in blocks if x.grp == "a"]) / 30
    assert 10 < lengths < 24  # 1 + 60 / 4 blocks are expected
    got = {x.grp: x for x in Boot.sharpe_interval(df).collect()}
    for g in "ab":
        s = series[g]
        z, sr = (s - s.mean()) / s.std(ddof=1), s.mean() / s.std(ddof=1)
        u = z - sr / 2 * (z * z - 1)
        v = (u @ u + 2 * sum((1 - k / 6) * (u[k:] @ u[:-k]) for k in range(1, 6) if k < len(u))) / len(u)
        se = np.sqrt(max(v, 0) / len(u)) * 252**0.5
        assert (got[g].n, got[g].sharpe) == (len(s), pytest.approx(sr * 252**0.5))
        assert got[g].se == pytest.approx(se, rel=1e-6, abs=1e-6) and got[g].high - got[g].low == pytest.approx(2 * 1.959963984540054 * se, rel=1e-6, abs=1e-6)
        assert got[g].se_iid == pytest.approx(np.sqrt((1 + sr * sr / 2) / len(s)) * 252**0.5)
    assert got["flat"].sharpe is None and got["one"].sharpe is None and "none" not in got
    empty = df.filter("false")
    assert Boot.sharpe_interval(empty).count() == 0 and Boot.sharpe_bootstrap(empty, reps=3).count() == 0


def test_scale_consistent_strategy_walks_the_loop(spark, own_panel):
    from tessera.plans import panel_queries as pq
    from tessera.plans import strategy_queries as sq

    f = pq.ret(spark, "").toPandas().pivot(index="ts", columns="asset", values="r").sort_index()
    r, days, train = f.to_numpy(), list(f.index), f.index <= np.datetime64("1998-12-31")
    count = {t: sum(k == 1 for k, _, _ in K.persistence(K.distances(np.corrcoef(r[t - 5 : t].T)), 1.3)) for t in range(5, len(r))}
    cut = np.percentile([c for t, c in count.items() if train[t]], 75)
    made = {x.ts: x for x in sq.x12_wide(spark, "").collect()}
    test = [t for t in count if not train[t]]
    assert len(made) == len(test) > 20
    for turn, t in enumerate(test):
        order = np.argsort(r[t - 5 : t].sum(axis=0))
        on = count[t] > cut
        want = (r[t, order[:2]].mean() - r[t, order[-2:]].mean()) / 2 - (0.005 if turn % 5 == 0 else 0) if on else 0
        got = made[days[t].to_pydatetime()]
        assert (got.h1_count, got.position) == (count[t], int(on)) and got.r == pytest.approx(want, abs=2e-6)


def test_strategies_side_by_side_are_pandas(spark, monkeypatch):
    import pandas as pd

    from tessera.plans import strategy_queries as sq

    rng = np.random.default_rng(12)
    f = pd.DataFrame(rng.normal(0.001, 0.01, (40, 5)) + rng.normal(0, 0.01, (40, 1)), columns=sq.STRATEGIES)
    f.insert(0, "hold", rng.normal(0, 0.01, 40))
    f["ensemble"] = f[sq.STRATEGIES].mean(axis=1)
    wide = f.assign(grp="g", ts=range(40), t_idx=range(40))
    frame = spark.createDataFrame(wide)
    monkeypatch.setattr(sq, "strategies", lambda s, d: frame)
    rho = f[sq.STRATEGIES].corr()
    made = sq.x15_matrix(spark, "").collect()
    mean = rho.to_numpy()[np.triu_indices(5, 1)].mean()
    assert len(made) == 10
    for x in made:
        assert (x.rho, x.mean_rho) == pytest.approx((rho.loc[x.a, x.b], mean), abs=1e-6)
        assert x.diversification == ("good" if mean < 0.5 else "some" if mean < 0.7 else "limited")
    ratio = f.mean() / f.std() * 252**0.5
    best = ratio[sq.STRATEGIES].idxmax()
    (w,) = sq.x15_winner(spark, "").collect()
    assert (w.best, w.ensemble_wins) == (best, bool(ratio["ensemble"] > ratio[best]))
    assert w.improvement_pct == pytest.approx((ratio[best] - ratio["reversion"]) / abs(ratio["reversion"]) * 100, abs=1e-3)
    assert w.ensemble_gain_pct == pytest.approx((ratio["ensemble"] - ratio[best]) / abs(ratio[best]) * 100, abs=1e-3)
    cum = (1 + f).cumprod()
    for x in sq.x15(spark, "").collect():
        c = cum[x.strategy]
        drop = (c / c.cummax() - 1).min()
        assert x.calmar == pytest.approx((c.iloc[-1] ** (252 / 40) - 1) / abs(drop), rel=1e-4)


def test_newey_west_is_numpy(spark):
    import pandas as pd

    from tessera.operators import regression as G

    rng = np.random.default_rng(3)
    parts = []
    for g in "ab":
        x = rng.normal(size=(120, 3)) * [1.0, 1e-3, 10.0] + [0.0, 0.02, 5.0]
        e = np.convolve(rng.normal(size=124), [1, 0.6, 0.3, 0.2, 0.1], "valid")
        parts.append(pd.DataFrame({"grp": g, "ts": range(120), "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "y": x @ [0.5, 30.0, -0.1] + e}))
    f = pd.concat(parts)
    made = {r.grp: r for r in G.newey_west(spark.createDataFrame(f).repartition(3), "y", ["x0", "x1", "x2"]).collect()}
    for g, own in f.groupby("grp"):
        x = np.column_stack([np.ones(len(own)), own[["x0", "x1", "x2"]]])
        y, inv = own["y"].to_numpy(), np.linalg.inv(x.T @ x)
        b = inv @ x.T @ y
        u = (y - x @ b)[:, None] * x
        m = u.T @ u
        for lag in range(1, 6):
            c = u[lag:].T @ u[:-lag]
            m += (1 - lag / 6) * (c + c.T)
        assert np.allclose(made[g].beta, b) and np.allclose(made[g].t, b / np.sqrt(np.diag(inv @ m @ inv)), rtol=1e-6)
        assert made[g].r2 == pytest.approx(1 - ((y - x @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum()) and made[g].n == 120


def test_two_regressors_are_least_squares(spark):
    from tessera.operators import regression as G

    rng = np.random.default_rng(5)
    x = rng.normal(size=80)
    y = 1 + 2 * x - x**2 + rng.normal(size=80)
    d = spark.createDataFrame([(float(a), float(a * a), 3.0 * float(a) + 1, float(b)) for a, b in zip(x, y, strict=True)], "x double, z double, line double, y double")
    r = d.agg(*[c.alias(k) for k, c in G.two_regressors("x", "z", "y").items()]).first()
    a = np.column_stack([np.ones(80), x, x * x])
    b, *_ = np.linalg.lstsq(a, y, rcond=None)
    assert np.allclose([r.b0, r.bx, r.bz], b) and r.rss == pytest.approx(((y - a @ b) ** 2).sum())
    r = d.agg(*[c.alias(k) for k, c in G.two_regressors("x", "line", "y").items()]).first()  # collinear
    assert r.bz == 0 and r.bx == pytest.approx(np.polyfit(x, y, 1)[0])


def test_expanding_quantile_is_numpy(spark):
    from tessera.operators import rolling as R

    rng = np.random.default_rng(8)
    x = [None if i % 11 == 5 else float(v) for i, v in enumerate(rng.normal(size=200))]
    rows = [(g, i, v) for g in "ab" for i, v in enumerate(x)]
    made = R.expanding_quantile(spark.createDataFrame(rows, "grp string, t_idx int, x double").repartition(5), "x", 0.75, "q", least=20).collect()
    assert len(made) == 400
    for r in made:
        seen = [v for v in x[: r.t_idx + 1] if v is not None]
        assert r.q is None if len(seen) < 20 else r.q == pytest.approx(np.percentile(seen, 75))


@pytest.mark.parametrize("inclusive", [False, True])
def test_rolling_and_strided_correlations_are_numpy(spark, inclusive):
    from tessera.operators import network as N

    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3)) + 5
    x[20:60, 1] = 7.0  # constant for longer than the window
    rets = spark.createDataFrame([("g", "abc"[k], i, i, float(x[i, k])) for i in range(90) for k in range(3)], "grp string, asset string, ts int, t_idx int, r double")
    made = {(r.t_idx, r.a, r.b): r.rho for r in N.rolling_corr(rets, 15, inclusive).collect()}
    assert len(made) == 3 * (90 - 15 + inclusive)
    for (t, a, b), rho in made.items():
        w = x[t - 15 + inclusive : t + inclusive][:, ["abc".index(a), "abc".index(b)]]
        assert rho is None if w.std(axis=0).min() < 1e-12 else rho == pytest.approx(np.corrcoef(w.T)[0, 1], abs=1e-9)
    if not inclusive:
        kept = {(r.t_idx, r.a, r.b): r.rho for r in N.strided_corr(rets, 15, 10).collect()}
        assert set(kept) == {k for k in made if (k[0] - 15) % 10 == 0}
        assert all(made[k] is None and v is None or v == pytest.approx(made[k], abs=1e-9) for k, v in kept.items())


def test_fetch_tries_again_and_tells_what_failed(spark):
    from tessera.sources.panel import fetch

    asked = []

    def read(asset):
        asked.append(asset)
        if asset == "bad" or asset == "late" and asked.count("late") < 3:
            raise OSError(asset)
        return spark.range(0 if asset == "none" else 2)

    got, failed = fetch(read, ["a", "bad", "late", "none"])
    assert got.count() == 4 and failed == ["bad", "none"] and asked.count("bad") == 3 == asked.count("late")


def test_ranks_by_buckets_give_the_area(spark):
    from tessera.plans import model_queries as mq

    rng = np.random.default_rng(6)
    score = np.r_[np.round(rng.random(150), 2), rng.normal(size=50) * 1e3]
    y = (rng.random(200) < 0.5).astype(int)
    rows = [(float(a), int(a > 0.5), int(b), float(rng.normal())) for a, b in zip(score, y, strict=True)]
    got = mq.measures(spark.createDataFrame(rows, "score double, predicted int, target int, next_ret double")).first()
    pos, neg = score[y == 1], score[y == 0]
    assert got.auc == pytest.approx(np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos]), abs=1e-6)


@pytest.fixture()
def own_panel(monkeypatch):
    """A panel of the test's own in place of the tables: folder "" is the panel, "later" has other prices at the end."""
    import pandas as pd

    from tessera.plans import panel_queries as pq
    from tessera.sources import panel as P

    rng = np.random.default_rng(11)
    dates = pd.date_range("1997-01-06", periods=150, freq="W-MON")
    r = rng.normal(0, 0.1, (150, 7)) + rng.normal(0, 0.05, (150, 1))
    other = r.copy()
    other[130:] = rng.normal(0, 0.3, (20, 7))

    def made(s, d, unit="week"):
        px = 100 * np.exp(np.cumsum(other if d == "later" else r, axis=0))
        rows = [("g", "abcdefg"[k], dates[i].to_pydatetime(), float(px[i, k])) for i in range(150) for k in range(7)]
        return s.createDataFrame(rows, "grp string, asset string, ts timestamp_ntz, px double")

    monkeypatch.setattr(P, "ship_brand", made)
    pq.release()
    yield dates[130].to_pydatetime()
    pq.release()


def test_strategies_do_not_look_ahead(spark, own_panel):
    from tessera.plans import strategy_queries as sq

    names = ("x01", "x02", "x05", "x09", "x11", "x13")
    runs = []
    for d in ("", "later"):
        runs.append({n: {tuple(r)[:2]: tuple(r)[2:] for r in getattr(sq, n)(spark, d).collect()} for n in names})
    for n in names:
        before = [{k: v for k, v in run[n].items() if k[1] < own_panel} for run in runs]
        assert before[0] and before[0] == before[1], n
    assert sum(runs[0][n] != runs[1][n] for n in names) >= 3  # the rows after the change do differ


def test_topology_queries_agree_with_their_bars(spark, own_panel):
    from tessera.plans import network_queries as nq

    by = lambda q: {r.ts: r for r in q.collect()}
    bars = {}
    for r in nq.t14(spark, "").collect():
        bars.setdefault(r.ts, []).append(r)
    t02, t05, t06, t07, t10, t18 = (by(q(spark, "")) for q in (nq.t02, nq.t05_lifetimes, nq.t06, nq.t07, nq.t10, nq.t18))
    c13, c14, spectrum = (by(q(spark, "")) for q in (nq.c13, nq.c14, nq.c15_spectrum))
    corr = {}
    for r in nq.c01(spark, "").collect():
        corr.setdefault(r.ts, np.eye(7))[["abcdefg".index(r.a), "abcdefg".index(r.b)], ["abcdefg".index(r.b), "abcdefg".index(r.a)]] = r.rho
    assert len(bars) == len(corr) == 89
    for ts, own in bars.items():
        life = np.array([r.life for r in own if r.dim == 1 and r.death is not None])
        assert t05[ts].h1_count == len(life) and t05[ts].h1_total == pytest.approx(life.sum(), abs=1e-5)
        if len(life) and life.mean() > 1e-4:
            assert t06[ts].h1_cv == pytest.approx(life.std() / life.mean(), abs=0.02)
        if len(life) > 1 and life.min() > 1e-4:
            share = life / life.sum()
            assert t07[ts].h1_entropy == pytest.approx(-(share * np.log(share)).sum() / np.log(len(life)), abs=1e-2)
        assert t10[ts].h1_count == (life > 0.1).sum()
        short = [r for r in own if r.dim == 1 and r.birth <= 1.35]
        assert t02[ts].h1_count + t02[ts].h1_essential == len(short)
        assert t18[ts].h0_total == pytest.approx(sum(r.death for r in own if r.dim == 0 and r.death is not None), abs=1e-4)
        e = np.sort(np.linalg.eigvalsh(corr[ts]))[::-1]
        assert spectrum[ts].corr_lambda1 == pytest.approx(e[0], abs=1e-4)
        lap = np.sort(np.linalg.eigvalsh(K.laplacian(corr[ts], nq.TAU)))
        assert c14[ts].lap_lambda1 == pytest.approx(K.spectrum(corr[ts], nq.TAU)["lap_lambda1"], abs=1e-4) and lap.min() > -1e-9
        assert c13[ts].fiedler == pytest.approx(K.spectrum(corr[ts], nq.TAU)["fiedler"], abs=1e-4)


def test_embedding_and_repair_keep_what_they_promise():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    bad = np.full((6, 6), -0.5) + 1.5 * np.eye(6)
    fixed = K.nearest_correlation(bad, 0.01)
    assert np.allclose(np.diag(fixed), 1) and np.linalg.eigvalsh(fixed).min() > 0 and np.allclose(fixed, fixed.T)
    c = 1 - d**2 / 2 / d.max() ** 2  # distances that three dimensions hold
    y = K.mds(c)
    e = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
    assert np.allclose(e, K.distances(c), atol=1e-6)


def test_the_entry_imports_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
