"""Split ordered operators must equal plain windows, also when one key holds most rows and pieces are tiny."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.functions import ordering as O


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(3000).select(
        F.when(F.col("id") % 3 != 0, 0).otherwise(F.col("id") % 7 + 1).alias("k"), F.col("id").alias("i"),
        (F.hash("id") % 40).cast("double").alias("v"), F.when(F.col("id") % 11 != 0, F.col("id") * 2).alias("t"))
    return d.cache()


def piece(n=37):
    return F.floor(F.col("i") / n)


def test_split_rank(rows):
    out = O.split_rank(rows, ["k"], [F.col("i")], piece())
    bad = out.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("i"))).where("w <> rank")
    assert bad.count() == 0 and out.count() == 3000


def test_split_lag_crosses_pieces_and_keeps_nulls(rows):
    out = O.split_lag(rows, ["k"], ["i"], piece(), ["t", "v"])
    w = Window.partitionBy("k").orderBy("i")
    bad = (
        out.withColumns({"w1": F.lag("v").over(w), "w2": F.lag("t").over(w)})
        .where("not (prev_v <=> w1) or not (prev_t <=> w2)"))
    assert bad.count() == 0


def test_split_running_sum(rows):
    out = O.split_running_sum(rows, ["k"], ["i"], piece(), ["v"])
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    assert out.withColumn("w", F.sum("v").over(w)).where("abs(w - run_v) > 1e-9").count() == 0


def test_split_enumerate(rows):
    out = O.split_enumerate(rows, ["k"], ["i"], piece(), ["v"], "i")
    w, whole = Window.partitionBy("k").orderBy("i"), Window.partitionBy("k")
    bad = out.withColumns({"a": F.row_number().over(w) - 1, "b": F.lag("v").over(w), "n": F.count("*").over(whole),
                           "lo": F.min("i").over(whole), "hi": F.max("i").over(whole)}).where(
        "a <> idx or not (b <=> prev_v) or n <> n_total or lo <> first_i or hi <> last_i")
    assert bad.count() == 0


@pytest.mark.parametrize("piece_rows", [10**9, 5, 1])
def test_value_ranks_and_quantiles(rows, piece_rows):
    r = O.value_ranks(rows, ["k"], "v", piece_rows=piece_rows)
    w = Window.partitionBy("k").orderBy("v")
    plain = rows.withColumns({"r": F.rank().over(w) - 1, "n": F.count("*").over(Window.partitionBy("k", "v"))})
    both = plain.join(r.withColumnRenamed("n", "m"), ["k", "v"])
    assert both.where("r <> n_before or n <> m").count() == 0 and both.count() == 3000
    q = {x["k"]: x for x in O.split_quantiles(rows, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.99}, piece_rows=piece_rows).collect()}
    pdf = rows.select("k", "v").toPandas()
    for k, g in pdf.groupby("k"):
        assert np.allclose([q[k]["a"], q[k]["b"], q[k]["c"]], np.quantile(g.v, [0.05, 0.5, 0.99]))


def test_global_quantile_without_keys(rows):
    got = O.split_quantiles(rows, [], "v", {"m": 0.37}).first()["m"]
    assert got == pytest.approx(np.quantile(rows.toPandas().v, 0.37))


def test_mid_ranks(rows):
    import pandas as pd

    got = O.mid_ranks(rows.select("k", "i", "v"), ["k"], "v", "r").toPandas().sort_values("i")
    want = rows.toPandas().sort_values("i").groupby("k").v.rank()
    pd.testing.assert_series_equal(got.r.reset_index(drop=True), want.reset_index(drop=True), check_names=False)


def test_first_k_limits_before_the_shuffle(rows):
    out = O.first_k(rows, ["k"], [F.col("i")], 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    assert out.groupBy("k").count().where("count <> 4").count() == 0


@pytest.fixture(scope="module")
def holes(spark):
    """NULL keys, NULL values and NULL pieces."""
    d = spark.range(200).select(F.when(F.col("id") % 4 != 0, F.col("id") % 3).alias("k"), F.when(F.col("id") > 20, F.col("id")).alias("i"),
                                F.when(F.col("id") % 5 != 0, (F.hash("id") % 7).cast("double")).alias("v"), F.col("id"))
    return d.cache()


@pytest.mark.parametrize("n", [1, 7, 10**6])
def test_nulls_are_treated_alike_at_every_size(spark, holes, n):
    w = Window.partitionBy("k").orderBy("i", "id")
    same = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) < 1e-9, F.col(a).isNull() & F.col(b).isNull())
    order = [F.col("i"), F.col("id")]
    out = O.split_rank(holes, ["k"], order, piece(n)).withColumn("a", F.row_number().over(w))
    assert out.count() == 200 and out.where(~same("a", "rank")).count() == 0
    out = O.split_lag(holes, ["k"], ["i", "id"], piece(n), ["v", "id"]).withColumn("a", F.lag("v").over(w))
    assert out.count() == 200 and out.where(~same("a", "prev_v")).count() == 0
    out = O.split_running_sum(holes, ["k"], ["i", "id"], piece(n), ["v"]).withColumn("a", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert out.count() == 200 and out.where(~same("a", "run_v")).count() == 0
    out = O.split_enumerate(holes, ["k"], ["i", "id"], piece(n), ["v"], "id")
    assert out.count() == 200 and out.where("idx IS NULL OR n_total IS NULL").count() == 0
    ranks = O.mid_ranks(holes, ["k"], "v", "r", piece_rows=n).toPandas()
    want = ranks.groupby("k", dropna=False).v.rank()
    assert len(ranks) == 200 and np.allclose(ranks.r, want, equal_nan=True)
    empty = holes.unionByName(spark.range(3).select(F.lit(9).cast("bigint").alias("k"), F.lit(1).cast("bigint").alias("i"), F.lit(None).cast("double").alias("v"), "id"))
    got = {r.k: r.m for r in O.quantiles(empty, ["k"], {"m": ("v", 0.3)}, piece_rows=n).collect()}
    pdf = empty.toPandas()
    assert set(got) == {None, 0, 1, 2, 9} and got[9] is None
    assert all(abs(got[None if np.isnan(k) else k] - g.v.quantile(0.3)) < 1e-9 for k, g in pdf.groupby("k", dropna=False) if k != 9)


def test_nothing_runs_while_a_plan_is_built(spark, holes):
    tracker = spark.sparkContext.statusTracker()
    before = tracker.getJobIdsForGroup(None)
    O.mid_ranks(O.split_rank(holes, ["k"], [F.col("i")], piece()), ["k"], "v", "r")
    O.quantiles(holes, ["k"], {"m": ("v", 0.3)})
    assert tracker.getJobIdsForGroup(None) == before
