"""Statistics against numpy and known values."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.columns import normal_two_sided
from seriesloom.operators import stats as ST


def frame(spark, values, key="g"):
    rows = [(k, i, float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"{key} string, subject bigint, v double")


def test_bootstrap_of_constants_and_of_nulls(spark):
    d = frame(spark, {"const": [2.0] * 9, "x": np.random.default_rng(1).normal(size=30)})
    odd = d.unionByName(spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), (None, 3, None)], d.schema))
    split = {r["g"]: r for r in ST.bootstrap_ci(odd, ["g"], "subject", "v", 200).collect()}
    assert (split[None]["mean"], split[None]["n"], split[None]["ci_lo"], split[None]["ci_hi"]) == (1.5, 3, 1.0, 2.0)
    assert split["const"]["ci_lo"] == split["const"]["ci_hi"] == 2.0
    x = split["x"]
    assert x["ci_lo"] < x["mean"] < x["ci_hi"] and 0.3 < (x["ci_hi"] - x["ci_lo"]) / (2 * 1.96 / 30 ** 0.5) < 1.5


def test_poisson_bootstrap_has_a_similar_width(spark):
    d = frame(spark, {"x": np.random.default_rng(2).normal(size=400)})
    a = ST.bootstrap_ci(d, ["g"], "subject", "v", 300).first()
    b = ST.bootstrap_ci(d, ["g"], "subject", "v", 300, method="poisson").first()
    assert abs((a["ci_hi"] - a["ci_lo"]) / (b["ci_hi"] - b["ci_lo"]) - 1) < 0.25


def test_signed_rank_exact_matches_enumeration():
    for n in (1, 4, 7):
        for w in range(n * (n + 1) // 4 + 1):
            sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product([0, 1], repeat=n)]
            assert ST._exact_tail(n, w) == pytest.approx(min(1.0, 2 * np.mean(np.array(sums) <= w)))
    assert ST._exact_tail(23, 0) == pytest.approx(2.0 ** -22)


def test_paired_compare_cases(spark):
    base = {"zero": [1, 1, 1, 1], "equal": [1, 1, 1, 1], "tied": [1, 2, 3, 4, 5], "plain": list(range(23))}
    plus = {"zero": [0] * 4, "equal": [.5] * 4, "tied": [.5, .5, -.5, .25, 0], "plain": [.1 * (i + 1) for i in range(23)]}
    b = frame(spark, base)
    a = frame(spark, {k: [x + y for x, y in zip(base[k], plus[k])] for k in base})
    r = {x["g"]: x for x in ST.paired_compare(a, b, ["g"], "v", 50).collect()}
    assert r["zero"]["p"] == 1.0 and r["zero"]["n_used"] == 0 and r["zero"]["n"] == 4
    assert r["equal"]["w"] == 0 and r["equal"]["method"] == "normal" and r["equal"]["ci_lo"] == pytest.approx(0.5)
    # |d| = .25, .5, .5, .5: ranks 1 and 3
    assert (r["tied"]["w_plus"], r["tied"]["w_minus"], r["tied"]["n_used"]) == (7.0, 3.0, 4)
    assert r["tied"]["z"] == pytest.approx((3 - 5) / np.sqrt(4 * 5 * 9 / 24 - 24 / 48))
    assert r["plain"]["p"] == pytest.approx(2.0 ** -22) and r["plain"]["method"] == "exact" and r["plain"]["n_positive"] == 23


def test_normal_tail(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (1.959964,), (-2.575829,)], "z double").select(normal_two_sided(F.col("z"))).collect()]
    assert np.allclose(got, [1.0, 0.05, 0.01], atol=1e-6)


def test_n_threshold(spark):
    rows = [("up", n, y) for n, y in zip((2, 4, 8), (0.0, .5, 1.0))] + [("flat", n, 1.0) for n in (2, 4, 8)]
    rows += [("over", n, y) for n, y in zip((2, 4, 8), (0.0, 1.2, 1.0))]
    c = spark.createDataFrame(rows, "g string, n int, y double")
    got = {r["g"]: r["n_needed"] for r in ST.n_threshold(c, ["g"], "n", "y", 0.9).collect()}
    assert got["up"] == pytest.approx(4 + 4 * .4 / .5) and got["flat"] is None and got["over"] == pytest.approx(2 + 2 * .9 / 1.2)


def test_equivalent_x_on_a_dented_curve(spark):
    c = spark.createDataFrame([("a", n, y) for n, y in zip((2, 4, 6, 8), (.2, .5, .4, .9))], "g string, n int, y double")
    s = spark.createDataFrame([("a", v) for v in (.1, .2, .35, .5, .7, .9, .95)], "g string, v double")
    got = {round(r["v"], 2): r["equivalent_x"] for r in ST.equivalent_x(s, c, ["g"], "n", "y", "v").collect()}
    assert got[.1] is None and got[.95] is None and got[.2] == 2 and got[.35] == pytest.approx(3) and got[.9] == 8
    assert got[.7] == pytest.approx(7) and got[.5] == 6


def test_within_slopes_and_shares(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(a), float(b), float(5 * g + 2 * a - b + rng.normal(0, .1))) for g in range(5) for a, b in rng.normal(size=(20, 2))]
    d = spark.createDataFrame(rows, "g int, a double, b double, y double").withColumn("all", F.lit(1))
    r = ST.within_slopes(d, ["all"], "g", F.col("y"), F.col("a"), F.col("b")).first()
    X = np.array([[1.0 if i == g else 0 for i in range(5)] + [a, b] for g, a, b, _ in rows])
    beta = np.linalg.lstsq(X, np.array([y for *_, y in rows]), rcond=None)[0]
    assert r["slope_1"] == pytest.approx(beta[-2]) and r["slope_2"] == pytest.approx(beta[-1]) and r["within_r2"] > 0.99
    v = ST.variance_shares(d, "g", "a", "y").first()
    assert v["between_class"] + v["between_subject"] + v["residual"] == pytest.approx(1) and v["residual"] == pytest.approx(0)
