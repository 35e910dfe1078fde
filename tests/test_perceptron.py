import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import perceptron as N


def frame(spark, x, y):
    rows = [(v.tolist(), None if t is None else int(t)) for v, t in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "features array<double>, label int").repartition(3)


def loss(weights, x, y):
    z = N.outputs(weights, x)[-1][:, 0]
    return float(np.logaddexp(0, np.where(y > 0.5, -z, z)).sum())


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(30, 4)), rng.integers(0, 2, 30).astype(float), N.begun((4, 5, 3, 1), 2)
    g, at = N.flat(N.gradient(w, x, y)), N.flat(w)
    for k in range(len(at)):
        up, down = at.copy(), at.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert g[k] == pytest.approx((loss(N.shaped(up, w), x, y) - loss(N.shaped(down, w), x, y)) / 2e-6, abs=1e-4)


def test_a_step_sums_over_all_partitions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] > 0).astype(float)
    df = frame(spark, x, y).select(F.col("features").alias("x"), F.col("label").cast("double").alias("y"), (F.col("features")[2] > 1.2).alias("kept"))
    w, held = N.begun((3, 4, 1), 5), x[:, 2] > 1.2
    net = N.EarlyStoppedNetwork(batches=3)
    got = [net._sums(df, w, 1, b) for b in range(3)]
    size = N.flat(w).size
    assert np.allclose(sum(g[:size] for g in got), N.flat(N.gradient(w, x[~held], y[~held])))  # every row in one batch
    assert sum(g[size] for g in got) == (~held).sum() and all(g[size] > 30 for g in got)
    right = ((N.outputs(w, x[held])[-1][:, 0] > 0) == (y[held] > 0.5)).sum()
    assert (got[0][size + 1], got[0][size + 2]) == (right, held.sum()) and got[1][size + 2] == got[2][size + 2] == 0


def test_training_stops_at_the_best_of_rows_held_back(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, size=(600, 2))
    y = x[:, 0] * x[:, 1] > 0  # no line parts the classes
    net = N.EarlyStoppedNetwork(batches=1, rate=0.05, epochs=60, patience=4)
    model = net.fit(frame(spark, [*x, x[0]], [*y, None]))
    n, top = len(model.shares), max(model.shares)
    assert model.shares[model.best - 1] == top and model.shares.index(top) == model.best - 1
    run, ends = 0, []
    for k, s in enumerate(model.shares):
        run = run + 1 if k and s < max(model.shares[:k]) + 1e-4 else 0
        ends.append(run > 4)
    assert n == 60 or (ends[-1] and not any(ends[:-1]))
    rows = frame(spark, x, y).union(spark.createDataFrame([(None, 1)], "features array<double>, label int"))
    made = model.transform(rows).select("features", "label", "prediction", N.vector_to_array(F.coalesce("probability", N.array_to_vector(F.array(F.lit(-1.0), F.lit(-1.0)))))[1].alias("p")).collect()
    known = [r for r in made if r.features is not None]
    assert np.mean([r.prediction == r.label for r in known]) > 0.9 and len(made) == 601
    assert all(r.prediction is None and r.p == -1 for r in made if r.features is None)
    want = N.odds_to_share(N.outputs(model.weights, np.array([r.features for r in known]))[-1][:, 0])
    assert np.allclose([r.p for r in known], want)


def test_noise_ends_early_and_nothing_at_once(spark):
    rng = np.random.default_rng(4)
    model = N.EarlyStoppedNetwork(batches=1, patience=2, epochs=40).fit(frame(spark, rng.normal(size=(200, 2)), rng.integers(0, 2, 200)))
    assert len(model.shares) < 40
    empty = N.EarlyStoppedNetwork().fit(frame(spark, np.zeros((0, 2)), []))
    assert empty.shares == []
