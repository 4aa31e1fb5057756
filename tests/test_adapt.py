"""Self-training without a row per window and without ranking every row: the same results as the plain forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import learn as L
from seriesloom.operators import selection as SEL
from seriesloom.operators import votes as V
from seriesloom.plans import adapt as AP
from seriesloom.plans import experiment as X


@pytest.fixture(scope="module")
def signals(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        ch = (rng.normal(size=(4, 16)) + i % 5).tolist()
        if i == 7:
            ch[1][3] = None
        elif i == 8:
            ch[2] = [None] * 16
        elif i == 9:
            ch[0][0] = float("nan")
        elif i == 10:
            ch = [c[:5] for c in ch]  # no whole window
        elif i == 11:
            ch = [c[:9] for c in ch]
        rows.append((i, i // 10, i % 5 if i != 12 else None, 1, ch))
    rows.append((20, 2, 0, 1, rng.normal(size=(4, 16)).tolist()))  # a second row of series 20
    return spark.createDataFrame(rows, "series_id bigint, subject bigint, cls int, period_order int, ch array<array<double>>").repartition(3).cache()


def by_id(df, *cols):
    return {r["series_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-12)))


def test_packed_windows_have_the_mean_measures_of_the_series(signals):
    plain, packed = by_id(L.series_mean(X.windows_of(signals)), "m"), by_id(X.packed_windows(signals).withColumn("m", L.mean_measures("ms")), "m", "ms")
    assert plain.keys() == packed.keys() and 10 not in plain and len(packed[11][1]) == 1 and len(packed[20][1]) == 10
    for k, (m,) in plain.items():
        assert all(same(x, y) for x, y in zip(m, packed[k][0], strict=True)), k


def test_packed_calls_are_those_of_the_windows_and_nothing_is_shuffled(spark, signals):
    windows, series = X.windows_of(signals), X.packed_windows(signals).withColumn("m", L.mean_measures("ms"))
    train = series.where("series_id between 30 and 90 and cls <> 3").select("series_id", "cls", "m", F.explode(F.array(F.lit(1), F.lit(2))).alias("repeat"))
    train = train.where("repeat = 1 or cls <> 1")
    profiles = L.fit_profiles(train, ["repeat"])
    plain = V.mean_proba_call(L.profile_proba(windows.join(profiles.select("repeat"), how="cross"), profiles, ["repeat"], 5, 2), ["repeat"], 5)
    models = {r.repeat: (r.profiles, r.scale) for r in profiles.collect()}
    calls = L.packed_calls(series.withColumn("cells", F.array(F.lit(1), F.lit(2), F.lit(9))), models, 5)
    want = {(r["repeat"], r.series_id): (r.truth, r.pred, r.conf) for r in plain.collect()}
    got = {(r.cell, r.series_id): (r.truth, r.pred, r.conf) for r in calls.collect()}
    assert want.keys() == got.keys() and len(got) == 2 * 119 and got[1, 7][1] is not None and got[1, 8][1:] == (None, None)
    assert all(same(x, y) for k in want for x, y in zip(want[k], got[k], strict=True))
    table = spark.createDataFrame([], series.withColumn("cells", F.array(F.lit(1))).schema)
    assert "Exchange" not in L.packed_calls(table, models, 5)._jdf.queryExecution().executedPlan().toString()
    assert L.packed_calls(table, models, 5).count() == 0


@pytest.mark.parametrize(("steps", "fetched"), [(2, 0), (128, 0), (16, 40), (128, 100_000)])
def test_nth_values_of_any_values(spark, steps, fetched):
    rng = np.random.default_rng(1)
    inf, nan = float("inf"), float("nan")
    groups = {"plain": rng.normal(size=90).tolist(), "outlier": [*rng.normal(size=40).tolist(), 1e300, -1e308, 1e308], "ties": [0.5] * 30 + [0.25] * 9 + [0.75],
              "infinite": [inf, -inf, 1.0, inf, 2.0, -3.0, inf], "nan": [nan, 1.0, nan, 3.0, nan, nan], "tiny": [5e-324, 0.0, 1e-323, 1.5e-323, -5e-324],
              "one": [4.0], "none": [None, None], None: [3.0, None, 1.0, 2.0]}
    d = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values], "g string, v double").repartition(3).cache()
    wanted = {"lo": lambda n: (n - 1) // 2, "hi": lambda n: n // 2, "last": lambda n: n - 1, "beyond": lambda n: n}
    found = SEL.nth_values(d, ["g"], "v", wanted, {"rows": F.count(F.lit(1))}, steps, fetched)
    assert found.keys() == {(k,) for k in groups}
    for k, values in groups.items():
        order, f = sorted((v for v in values if v is not None), key=lambda v: (v != v, v)), found[k,]
        assert f["n"] == len(order) and f["rows"] == len(values) and f["beyond"] is None
        for name, place in wanted.items():
            if 0 <= place(len(order)) < len(order):
                v = order[place(len(order))]
                assert same(f[name], v) and f[f"{name}_before"] == next(i for i, w in enumerate(order) if same(w, v)), (k, name)
            else:
                assert f[name] is None and f[f"{name}_before"] is None


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.5, 0.8, 1.0])
def test_top_fraction_of_a_table(spark, fraction):
    rows = [(i, i % 2, i % 3, round(math.sin(i), 1)) for i in range(300)] + [(1000 + i, 0, 1, 0.7) for i in range(200)] + [(2000, 0, None, None), (2001, 1, 1, None)]
    d = spark.createDataFrame(rows, "series_id bigint, repeat int, pred int, conf double").repartition(5).cache()
    want, got = (f(d, ["repeat"], fraction).collect() for f in (SEL.top_fraction_per_class, SEL.top_fraction_of_table))
    assert sorted(want) == sorted(got) and bool(got) == (fraction > 0)


def test_fitted_profiles_are_those_of_one_aggregation(spark, signals):
    train = X.packed_windows(signals).withColumn("m", L.mean_measures("ms")).where("series_id <> 9").select("cls", "m", F.explode(F.array(F.lit(1), F.lit(2))).alias("repeat"))
    train = train.where("repeat = 1 or cls <> 1").cache()
    want = {r["repeat"]: (r.profiles, r.scale) for r in L.fit_profiles(train.where("cls is not null"), ["repeat"]).collect()}
    for got in (AP.profiles_table(train, ["repeat"]).collect(),):
        assert {r["repeat"] for r in got} == want.keys()
        for r in got:
            profiles, scale = want[r["repeat"]]
            assert [p.cls for p in r.profiles] == [p.cls for p in profiles]
            assert all(same(x, y) for p, q in zip(r.profiles, profiles, strict=True) for x, y in zip(p.mu, q.mu, strict=True))
            assert r.scale == pytest.approx(scale, rel=1e-12)


def test_rounds_of_self_training_name_all_unlabeled_series_and_move_no_window(spark, signals, monkeypatch):
    def moved(*_, **__):
        raise AssertionError("a row per window")

    for module, name in ((L, "profile_proba"), (V, "mean_proba_call")):
        monkeypatch.setattr(module, name, moved)
    both = F.explode(F.array(F.lit(1), F.lit(2))).alias("repeat")
    ids = signals.select("series_id").distinct()
    labeled, unlabeled = ids.where("series_id between 30 and 49").select("series_id", both), ids.where("series_id >= 50").select("series_id", both)
    unlabeled = unlabeled.unionByName(spark.createDataFrame([(60, 1), (60, 7), (9999, 1)], "series_id bigint, repeat int"))
    done = AP.self_train(spark, X.packed_windows(signals), labeled, unlabeled, ["repeat"], (0.5, 0.8), 5, 2)
    rows = sorted(done.diagnostics.collect(), key=lambda r: (r["repeat"], r["round"]))
    assert [(r["repeat"], r["round"], r["fraction"], r["n_unlabeled"]) for r in rows] == [(a, b, f, 70) for a in (1, 2) for b, f in ((1, 0.5), (2, 0.8))]
    assert all(r["acc_all"] > 0.9 and r["n_pseudo"] >= math.ceil(r["fraction"] * 70) for r in rows)  # classes differ by their level
    assert done.known.count() == 40 and done.calls.count() == 140 and done.kept.count() == sum(r["n_pseudo"] for r in rows if r["round"] == 2)
