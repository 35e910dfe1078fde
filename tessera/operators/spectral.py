"""Dense-matrix operators: each row is one window's correlation vector, so no shuffle follows the pair aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.operators import scan
from tessera.operators.network import corr_vectors
from tessera.operators.permute import shuffled_place

_BAR = "array<struct<dim:int,birth:double,death:double>>"


def _kept(df: DataFrame) -> str:
    return f"grp string, ts {dict(df.dtypes)['ts']}"


def spectra(vectors: DataFrame, tau: float = 0.3) -> DataFrame:
    """Laplacian and correlation spectra of every window."""
    names = list(K.spectrum(np.eye(2)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [K.spectrum(K.square(r, len(a)), tau) for r, a in zip(f["rho"], f["assets"], strict=True)]
            yield pd.concat([f[["grp", "ts"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return vectors.mapInPandas(run, ", ".join([_kept(vectors), *(f"{n} double" for n in names)]))


def diagrams(vectors: DataFrame, limit: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """grp, ts, diagram: bars of dimension 0 and 1; death null where the class never dies (or beyond ``limit``). Columns of
    ``keep`` stay."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [[{"dim": k, "birth": b, "death": e} for k, b, e in K.persistence(K.distances(K.square(r, len(a))), np.inf if limit is None else limit)] for r, a in zip(f["rho"], f["assets"], strict=True)]
            yield pd.DataFrame({"grp": f["grp"], "ts": f["ts"], "diagram": made, **{c: f[c] for c in keep}})

    return vectors.mapInPandas(run, ", ".join([_kept(vectors), f"diagram {_BAR}", *(f"{c} {dict(vectors.dtypes)[c]}" for c in keep)]))


def topology(diagram: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts, totals and longest bars of both dimensions, spread and entropy of loop lifetimes; no Python. Columns of
    ``keep`` stay."""
    lives = lambda k: F.transform(F.filter("diagram", lambda b: (b["dim"] == k) & b["death"].isNotNull()), lambda b: b["death"] - b["birth"])
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    d = diagram.withColumn("l0", lives(0)).withColumn("l1", lives(1)).withColumn("t1", total(F.col("l1"))).withColumn("n1", F.size("l1"))
    mean = F.try_divide(F.col("t1"), F.col("n1"))
    d = d.withColumn("m1", mean)
    spread = F.sqrt(F.try_divide(F.aggregate("l1", F.lit(0.0), lambda a, x: a + (x - F.col("m1")) * (x - F.col("m1"))), F.col("n1")))
    bits = F.aggregate("l1", F.lit(0.0), lambda a, x: a - x / F.col("t1") * F.ln(x / F.col("t1")))
    return d.select(
        "grp", "ts", *keep, F.size("l0").alias("h0_count"), total(F.col("l0")).alias("h0_total"), F.array_max("l0").alias("h0_max"),
        F.col("n1").alias("h1_count"), F.col("t1").alias("h1_total"), F.coalesce(F.array_max("l1"), F.lit(0.0)).alias("h1_max"),
        F.size(F.filter("diagram", lambda b: (b["dim"] == 1) & b["death"].isNull())).alias("h1_essential"),
        F.when(F.col("m1") > 1e-10, F.try_divide(spread, F.col("m1"))).alias("h1_cv"),
        F.when(F.col("n1") == 0, 0.0).otherwise(F.try_divide(bits, F.when(F.col("n1") > 1, F.ln(F.col("n1"))).otherwise(1.0))).alias("h1_entropy"),
    )


def diagram_distances(diagram: DataFrame) -> DataFrame:
    """1-Wasserstein (Euclidean) and bottleneck distance of the loops to the previous window's; 0 if either has none."""
    w = Window.partitionBy("grp").orderBy("ts")
    loops = F.transform(F.filter("diagram", lambda b: (b["dim"] == 1) & b["death"].isNotNull()), lambda b: F.array(b["birth"], b["death"]))
    d = diagram.select("grp", "ts", loops.alias("now")).withColumn("before", F.coalesce(F.lag("now").over(w), F.array().cast("array<array<double>>")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pairs = [([list(x) for x in a], [list(x) for x in b]) for a, b in zip(f["before"], f["now"], strict=True)]
            yield pd.DataFrame({"grp": f["grp"], "ts": f["ts"], "wasserstein": [K.wasserstein(*p) for p in pairs], "bottleneck": [K.bottleneck(*p) for p in pairs]})

    return d.mapInPandas(run, f"{_kept(d)}, wasserstein double, bottleneck double")


def mds_coordinates(vectors: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for g, t, r, a in zip(f["grp"], f["ts"], f["rho"], f["assets"], strict=True):
                x = K.mds(K.square(r, len(a)))
                x = np.pad(x, ((0, 0), (0, 3 - x.shape[1])))
                out += [(g, t, name, *row) for name, row in zip(a, x.tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["grp", "ts", "asset", "x", "y", "z"])

    return vectors.mapInPandas(run, f"{_kept(vectors)}, asset string, x double, y double, z double")


def repaired(vectors: DataFrame, floor: float = 0.01) -> DataFrame:
    """Correlations after the eigenvalue floor and rescaling, as the row-major upper triangle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [K.nearest_correlation(K.square(r, len(a)), floor)[np.triu_indices(len(a), 1)].tolist() for r, a in zip(f["rho"], f["assets"], strict=True)]
            yield pd.DataFrame({"grp": f["grp"], "ts": f["ts"], "fixed": made})

    return vectors.mapInPandas(run, f"{_kept(vectors)}, fixed array<double>")


def null_model(rets: DataFrame, reps: int = 100, seed: int = 42) -> DataFrame:
    """Every asset's whole return series shuffled for itself, ``reps`` times (repetitions 1 to ``reps``), and the series as it
    is (0): grp, rep, mean_corr, loops (h1_count), their total length and its spread.

    Dates count on which every asset of the group has a return. A date's new place follows from group, asset, repetition
    and place, so shuffling is grouping by the new place; means and deviations do not change, and a correlation is a sum
    of products of standardised returns. No row holds more than one date or one repetition's correlations. An asset that
    does not vary is correlated with none (0). Groups of one asset have no row."""
    good = rets.filter(F.col("r").isNotNull() & ~F.isnan("r")).select("grp", "asset", "t_idx", "r")
    many = rets.groupBy("grp").agg(F.count_distinct("asset").alias("many"))
    days = good.groupBy("grp", "t_idx").agg(F.count_distinct("asset").alias("c")).join(many, "grp").filter("c = many").select("grp", "t_idx")
    days = scan.place(days, "place").join(days.groupBy("grp").agg(F.count("*").alias("n")), "grp")
    whole = good.join(days, ["grp", "t_idx"])
    of = whole.groupBy("grp", "asset").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"))
    z = F.coalesce(F.try_divide(F.col("r") - F.col("mean"), F.col("sd")), F.lit(0.0))
    rows = whole.join(of, ["grp", "asset"]).select("grp", "asset", "place", "n", z.alias("z"), F.explode(F.sequence(F.lit(0), F.lit(reps))).alias("rep"))
    to = F.when(F.col("rep") == 0, F.col("place")).otherwise(shuffled_place(F.col("place"), F.col("n"), seed, "grp", "asset", "rep"))
    dates = rows.select("grp", "rep", to.alias("to"), "asset", "z", "n").groupBy("grp", "rep", "to").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("asset", "z"))).alias("x"))
    ordered = F.flatten(F.transform("x", lambda u, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda v: F.struct(u["asset"].alias("a"), v["asset"].alias("b"), (u["z"] * v["z"]).alias("p")))))
    corr = dates.select("grp", F.col("rep").alias("ts"), "n", F.explode(ordered).alias("p")).groupBy("grp", "ts", "p.a", "p.b").agg((F.sum("p.p") / F.first("n")).alias("rho"))
    mean = F.aggregate("rho", F.lit(0.0), lambda s, x: s + x) / F.size("rho")
    vectors = corr_vectors(corr).withColumn("mean_corr", mean)
    return topology(diagrams(vectors, keep=("mean_corr",)), keep=("mean_corr",)).select("grp", F.col("ts").alias("rep"), "mean_corr", "h1_count", "h1_total", "h1_cv")


def diffusion_residuals(vectors: DataFrame, rets: DataFrame, tau: float = 0.3, alpha: float = 0.5, steps: int = 3) -> DataFrame:
    """grp, asset, ts, e: x - (I - alpha L)^steps x for the day's returns x against the window before the day.

    A day's returns meet its window's correlations by group and date; the small dense product is made row by row."""
    x = rets.groupBy("grp", "ts").agg(F.map_from_entries(F.collect_list(F.struct("asset", "r"))).alias("x"))
    days = vectors.join(x, ["grp", "ts"]).select("grp", "ts", "assets", "rho", F.transform("assets", lambda a: F.col("x")[a]).alias("x"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for g, t, a, r, x in zip(f["grp"], f["ts"], f["assets"], f["rho"], f["x"], strict=True):
                step = np.eye(len(a)) - alpha * K.laplacian(K.square(r, len(a)), tau)
                x = np.asarray(x, float)
                out += [(g, n, t, e) for n, e in zip(a, x - np.linalg.matrix_power(step, steps) @ x, strict=True)]
            yield pd.DataFrame(out, columns=["grp", "asset", "ts", "e"])

    kind = dict(days.dtypes)["ts"]
    return days.mapInPandas(run, f"grp string, asset string, ts {kind}, e double")
