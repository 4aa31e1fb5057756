"""Votes, running calls and subject metrics on small hand-made cases."""

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import scores as S
from seriesloom.operators import selection as SEL
from seriesloom.operators import votes as V

SCHEMA = "series_id string, subject string, cls int, w int, t0_s double, proba array<double>"


def windows(spark, rows):
    return spark.createDataFrame([(s, "p", c, w, float(w), p) for s, c, w, p in rows], SCHEMA)


def test_vote_and_its_ties(spark):
    w = windows(spark, [
        ("majority", 0, 0, [.6, .4, 0.]), ("majority", 0, 1, [.6, .4, 0.]), ("majority", 0, 2, [.1, .9, 0.]),
        ("by_proba", 1, 0, [.6, .4, 0.]), ("by_proba", 1, 1, [.1, .9, 0.]),
        ("lowest", 1, 0, [0., .75, .25]), ("lowest", 1, 1, [0., .25, .75]),
        ("first_max", 0, 0, [.5, .5, 0.])])
    got = {r["series_id"]: (r["pred"], r["n_windows"]) for r in V.vote_series(w, [], 3).collect()}
    assert got == {"majority": (0, 3), "by_proba": (1, 2), "lowest": (1, 2), "first_max": (0, 1)}


def test_running_vote_asof_and_stability(spark):
    a, b = [.75, .25, 0.], [.25, .75, 0.]
    # right, wrong, wrong (tie breaks), right ... truth 0
    w = windows(spark, [("s", 0, i, p) for i, p in enumerate([a, b, b, a, a, a])] + [("t", 1, 0, a), ("t", 1, 1, a)])
    for size in (1, 2, 4096):
        r = V.running_vote(w, [], 3, 2.0, piece_windows=size)
        calls = [x["call"] for x in r.where("series_id = 's'").orderBy("w").collect()]
        assert calls == [0, 0, 1, 0, 0, 0]
    at = {(x["series_id"], x["t_s"]): x["call"] for x in V.asof_calls(r, [], [1.0, 2.0, 4.0, 4.5, 99.0]).collect()}
    assert at[("s", 1.0)] == 0 and at[("s", 4.0)] == 1 and at[("s", 4.5)] == 1 and at[("s", 99.0)] == 0 and at[("s", None)] == 0
    st = {x["series_id"]: x["stable_s"] for x in V.stable_since(r, []).collect()}
    assert st == {"s": 5.0, "t": None}
    end = V.vote_series(w, [], 3).select("series_id", "pred").collect()
    assert {x["series_id"]: x["pred"] for x in end} == {k: at[(k, None)] for k in ("s", "t")}


def test_subject_scores_with_an_absent_class(spark):
    p = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("a", 1, 1), ("b", 2, 2)], "subject string, truth int, pred int")
    s = {r["subject"]: r for r in S.subject_scores(p, ["subject"], 4).collect()}
    assert s["a"]["macro_f1"] == pytest.approx((2 / 3 + 2 / 3) / 4) and s["a"]["balanced_acc"] == pytest.approx(0.75)
    assert s["a"]["accuracy"] == pytest.approx(2 / 3) and s["b"]["macro_f1"] == pytest.approx(0.25) and s["b"]["n_bouts"] == 1
    present = S.subject_scores(p, ["subject"], 4, labels="present").where("subject = 'b'").first()
    assert present["macro_f1"] == 1.0


def test_confusion_is_complete(spark):
    p = spark.createDataFrame([(0, 0), (0, 1), (2, 2)], "truth int, pred int")
    c = {(r["truth"], r["pred"]): (r["n"], r["pct"]) for r in S.confusion(p, 3).collect()}
    assert len(c) == 9 and c[(0, 1)] == (1, 50.0) and c[(1, 1)] == (0, None)


def test_top_fraction_rounds_up_and_breaks_ties_by_id(spark):
    rows = [(i, "p", 0, i % 2, 0.5 if i < 8 else 0.9) for i in range(10)]
    d = spark.createDataFrame(rows, "series_id bigint, subject string, truth int, pred int, conf double")
    kept = SEL.top_fraction_per_class(d, [], 0.5)
    assert sorted(r["series_id"] for r in kept.collect()) == [0, 1, 2, 3, 8, 9]


def test_select_pairs_fills_short_bands(spark):
    rows = [(0, 1, .97, True, 5, 9), (0, 2, .99, False, 9, 9), (1, 2, .70, False, 9, 9), (1, 3, .60, True, 9, 9), (2, 3, .72, True, 1, 9)]
    d = spark.createDataFrame(rows, "class_a int, class_b int, balanced_acc double, same_family boolean, n_a int, n_b int")
    got = SEL.select_pairs(d, {"easy": (0.95, 1.01), "hard": (0.65, 0.78)}).orderBy("band", "pick").collect()
    assert [(r["band"], r["class_a"], r["class_b"], r["in_band"]) for r in got] == [
        ("easy", 0, 1, True), ("easy", 0, 2, True), ("easy", 2, 3, False),
        ("hard", 2, 3, True), ("hard", 1, 2, True), ("hard", 1, 3, False)]


def test_complete_cases(spark):
    d = spark.createDataFrame([("a", 2), ("a", 4), ("b", 2)], "subject string, n int")
    assert {r["subject"] for r in S.complete_cases(d, ["subject"], "n", 2).collect()} == {"a"}


def test_calibration_last_bin_holds_one(spark):
    d = spark.createDataFrame([(1, 1, 1.0), (0, 1, 0.95)], "pred int, truth int, conf double")
    b = S.calibration_bins(d, 10).collect()
    assert len(b) == 1 and b[0]["bin"] == 9 and b[0]["ece"] == pytest.approx(abs(0.975 - 0.5))


def test_top_fraction_when_most_confidences_are_equal(spark):
    rows = [(i, "p", 0, 0, 0.5 if i % 10 else 0.9) for i in range(400)] + [(1000 + i, "p", 0, 0, 0.1) for i in range(100)]
    d = spark.createDataFrame(rows, "series_id bigint, subject string, truth int, pred int, conf double").repartition(7)
    kept = {r["series_id"] for r in SEL.top_fraction_per_class(d, [], 0.3).collect()}
    assert kept == {r[0] for r in sorted(rows, key=lambda r: (-r[4], r[0]))[:150]}


def test_class_pairs_of_many_classes(spark):
    from seriesloom.operators import joins as J

    rows = spark.range(90).select((F.col("id") % 30).cast("int").alias("cls"), F.col("id").alias("subject"))
    rows = rows.unionByName(spark.createDataFrame([(99, 1), (None, 2)], "cls int, subject bigint"))
    found = {(r.class_a, r.class_b) for r in J.class_pairs(rows, 3).collect()}
    assert found == {(a, b) for a in range(30) for b in range(a + 1, 30)}


def streamed(spark, folder, batches, **kw):
    """Rows of running_calls over ``batches`` of windows, a file and a micro-batch each."""
    import os
    import shutil
    import time

    from seriesloom.streaming import running as R

    schema = "series_id long, subject long, truth int, w int, t0_s double, proba array<double>, time timestamp"
    os.makedirs(folder / "in", exist_ok=True)
    for k, rows in enumerate(batches):
        d = spark.createDataFrame(rows, schema.replace("time timestamp", "time string")).withColumn("time", F.to_timestamp("time"))
        d.coalesce(1).write.parquet(str(folder / f"b{k}"))
        (part,) = (folder / f"b{k}").glob("part-*")
        shutil.copyfile(part, folder / "in" / f"{k}.parquet")
        os.utime(folder / "in" / f"{k}.parquet", (time.time() - 1000 + k,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    return R.drain(spark, R.running_calls(stream, [], 2, 1.0, **kw), "late").collect()


def window(series, w, share):
    return (series, 1, 0, w, float(w), [share, 1 - share], f"2024-01-01 00:{w // 60:02d}:{w % 60:02d}")


def test_running_calls_wait_for_earlier_windows(spark, tmp_path):
    """A window that comes after later ones of its series counts in its place; repeated rows are told apart."""
    batches = [
        [window(1, 0, .9), window(1, 2, .8)],
        [window(1, 3, .1), window(2, 1, .2)],
        [window(1, 1, .0), window(1, 2, .8)],
        [window(2, 0, .6), window(1, 4, .0)],
    ]
    got = streamed(spark, tmp_path, batches, time_col="time", delay="10 seconds", idle_s=60)
    counted = sorted((r.series_id, r.w, r.call) for r in got if not r.late)
    assert counted == [(1, 0, 0), (1, 1, 1), (1, 2, 0), (1, 3, 1), (1, 4, 1), (2, 0, 0), (2, 1, 1)]
    assert [(r.series_id, r.w, r.call) for r in got if r.late] == [(1, 2, 1)]


def test_running_calls_pass_gaps_with_the_watermark_and_free_state(spark, tmp_path):
    batches = [
        [window(1, 0, .9), window(1, 3, .05), window(1, 5, .2)],
        [window(2, 30, .0)],
        [window(2, 31, .0)],  # the watermark has passed 5, so windows 1, 2 and 4 cannot come any more
        [window(1, 1, .0)],  # and are not counted
        [window(2, 200, .0)],
        [window(3, 400, .0)],  # closes series 1
        [window(1, 6, .0)],
    ]
    got = streamed(spark, tmp_path, batches, time_col="time", delay="10 seconds", idle_s=60)
    assert sorted((r.w, r.call, r.late) for r in got if r.series_id == 1 and r.w < 6) == [(0, 0, False), (3, 1, False), (5, 1, False)]
    assert sorted(r.w for r in got if r.series_id == 2) == [30, 31, 200]


def test_shuffled_stream_ends_at_the_batch_vote(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(8)
    rows = [window(s, w, round(float(rng.random()), 3)) for s in range(6) for w in range(20)]
    order = sorted(range(len(rows)), key=lambda k: rows[k][3] + rng.integers(0, 12))  # out of order inside the watermark
    batches = [[rows[k] for k in order[lo : lo + 24]] for lo in range(0, len(rows), 24)]
    got = streamed(spark, tmp_path, batches, time_col="time", delay="30 seconds", idle_s=600)
    schema = "series_id long, subject long, cls int, w int, t0_s double, proba array<double>, time string"
    whole = spark.createDataFrame(rows, schema)
    want = {(r.series_id, r.w): r.call for r in V.running_vote(whole, [], 2, 1.0).collect()}
    assert {(r.series_id, r.w): r.call for r in got} == want and not any(r.late for r in got)
    ends = {r.series_id: r.pred for r in V.vote_series(whole, [], 2).collect()}
    assert {s: max((r.w, r.call) for r in got if r.series_id == s)[1] for s in ends} == ends
