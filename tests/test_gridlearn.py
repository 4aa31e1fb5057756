"""Learners over a grid: spark.ml's optimum, separable data, repeatable forests, many cells in few jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import gridlearn as G
from seriesloom.operators import learn as L

NAMES = [f"f{k}" for k in range(6)]


@pytest.fixture(scope="module")
def data(spark):
    """Windows of 60 series in 3 classes that a circle separates, but no profile; cell 0 holds all, cell 1 half, cell 2 nothing."""
    rng = np.random.default_rng(6)
    rows = []
    for series in range(120):
        for w in range(4):
            x = rng.normal(size=6)
            cls = int(x[0] * x[1] > 0) + int(x[0] * x[1] > 0 and x[2] > 0)
            rows.append((series, w, cls, *[None if rng.random() < 0.01 and k == 5 else float(v) for k, v in enumerate(x)]))
    windows = spark.createDataFrame(rows, "series_id long, w int, cls int, " + ", ".join(f"{n} double" for n in NAMES))
    windows = windows.withColumn("f4", F.lit(3.0))  # a constant
    sets = spark.createDataFrame([(s, c) for s in range(80) for c in ((0, 1) if s < 40 else (0,))], "series_id long, c int")
    return windows, G.training_rows(windows, NAMES, sets, F.col("c"))


def test_logistic_agrees_with_spark_ml(spark, data):
    windows, rows = data
    fit = G.fit_logistic(rows, 3, 3)
    assert fit.gradient.max() <= 1e-8 and fit.steps < 25 and not fit.coef[2].any()
    clean = windows.na.fill(0.0).where("series_id < 80")
    test = windows.na.fill(0.0).where("series_id >= 80")
    plain = L.ml_learner("logistic", NAMES, max_iter=1000)(clean, test).select("series_id", "w", "proba")
    ours = G.grid_proba(test.withColumn("cells", F.array(F.lit(0))), NAMES, "cells", fit, 3).select("series_id", "w", F.col("proba").alias("own"))
    gap = plain.join(ours, ["series_id", "w"]).agg(F.max(F.array_max(F.zip_with("proba", "own", lambda a, b: F.abs(a - b)))).alias("d"), F.count("*").alias("n")).first()
    assert gap.n == 160 and gap.d < 1e-4
    both = G.fit_logistic(rows.repartition(5), 3, 3)
    assert np.allclose(both.coef, fit.coef, atol=1e-9)


def accuracy(windows, model, cell):
    test = windows.where("series_id >= 80").withColumn("cells", F.array(F.lit(cell)))
    calls = L.window_call(G.grid_proba(test, NAMES, "cells", model, 3))
    return calls.agg(F.avg((F.col("pred") == F.col("cls")).cast("double"))).first()[0]


def test_forest_beats_profiles_and_repeats_itself(spark, data, monkeypatch):
    windows, rows = data
    fit = G.fit_forest(rows, 3, 3, trees=60, depth=8, seed=4)
    assert fit.jobs <= 8
    own = accuracy(windows, fit, 0)
    w = windows.na.fill(0.0).withColumn("m", F.array(*NAMES, F.col("f0"), F.col("f1"))).withColumn("subject", F.lit(1))
    profile = L.window_call(L.profile_learner(3)(w.where("series_id < 80"), w.where("series_id >= 80")))
    assert own > 0.85 and own > 0.2 + profile.agg(F.avg((F.col("pred") == F.col("cls")).cast("double"))).first()[0]
    assert accuracy(windows, fit, 1) > 0.7
    # the same trees whatever the partitions, chunks and batches are
    monkeypatch.setattr(G, "CHUNK", 7)
    monkeypatch.setattr(G, "DENSE", 5000)
    again = G.fit_forest(rows.repartition(5), 3, 3, trees=60, depth=8, seed=4)
    for a, b in zip(fit.feature + fit.bin, again.feature + again.bin, strict=True):
        n = min(a.shape[1], b.shape[1])
        assert (a[:, :n] == b[:, :n]).all()
    other = G.fit_forest(rows, 3, 3, trees=60, depth=2, seed=5)
    assert other.jobs == 2 and max(f.shape[1] for f in other.feature) <= 8


def test_forest_splits_hold_their_counts(data):
    """The shares of every node are those of the weighted rows that reach it."""
    _, rows = data
    fit = G.fit_forest(rows, 3, 3, trees=5, depth=4, seed=9)
    held = rows.toPandas()
    key, cls = held["key"].to_numpy(), held["cls"].to_numpy()
    b = G.binned(np.array(held["x"].tolist()), fit.edges)
    weight = G.balanced(np.bincount(cls, minlength=3)[None, :])[0]
    times = G.drawn(key, 9, 0, np.arange(5))
    for tree in range(5):
        at = np.zeros(len(b), int)
        for _ in range(5):
            sums = {n: np.bincount(cls[at == n], times[at == n, tree], 3) * weight for n in np.unique(at)}
            for n, s in sums.items():
                assert np.allclose(fit.share[0][tree, n], s / s.sum())
            f = fit.feature[0][tree, at]
            at = np.where(f >= 0, fit.left[0][tree, at] + (b[np.arange(len(b)), np.maximum(f, 0)] > fit.bin[0][tree, at]), at)


def test_empty_training_rows(spark, data):
    windows, rows = data
    none = rows.limit(0)
    assert G.fit_logistic(none, 2, 3).steps == 0
    assert G.fit_forest(none, 2, 3, trees=3).jobs == 0
