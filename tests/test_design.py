"""Plans: nesting, disjointness, leakage checks, guards; files; streams."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import audit as A
from seriesloom.operators import joins as J
from seriesloom.plans import cohort as P
from seriesloom.sources import files as FI

D = P.Design(repeats=2, n_new=2, sizes=(2, 4), ks=(1, 2), n_classes=3)


@pytest.fixture(scope="module")
def bouts(spark):
    rows = [(s * 100 + c * 10 + p * 4 + j, s, c, p) for s in range(8) for c in range(3) for p in (1, 2) for j in range(3)]
    return spark.createDataFrame(rows, "series_id bigint, subject bigint, cls int, period_order int").cache()


def build(bouts):
    roles = P.make_roles(bouts, D)
    order = P.nested_set_order(bouts, roles, D)
    return roles, order, P.train_sets(order, D), P.test_sets(bouts, roles, D)


def test_plan_is_nested_and_clean(bouts):
    roles, order, train, test = build(bouts)
    t = train.toPandas()
    for r in (1, 2):
        s = {(n, k): set(t[(t.repeat == r) & (t.n_team == n) & (t.k == k)].series_id) for n in D.sizes for k in D.ks}
        assert s[2, 1] < s[2, 2] < s[4, 2] and s[2, 1] < s[4, 1] < s[4, 2] and len(s[4, 2]) == 4 * 3 * 2
    assert P.leak_violations(train, test, bouts, roles).agg(F.sum("n_violations")).first()[0] == 0
    again = P.train_sets(P.nested_set_order(bouts.repartition(5), roles, D), D)
    assert again.exceptAll(train).count() == 0
    assert P.missing_sets(train, D).where("short_classes > 0").count() == 0


def test_leaks_are_found(bouts):
    roles, order, train, test = build(bouts)
    wrong = test.select("repeat", "n_team", "k", "subject", "cls", "series_id").limit(5)
    new = roles.where("role = 'new'").select("repeat", "subject").join(bouts.where("period_order = 1"), "subject").select(
        "repeat", F.lit(2).alias("n_team"), F.lit(1).alias("k"), "subject", "cls", "series_id")
    v = {r["check"]: r["n_violations"] for r in P.leak_violations(train.unionByName(wrong).unionByName(new), test, bouts, roles).collect()}
    assert all(v[c] > 0 for c in v) and v["series in train and test"] == 5


def test_guard_reports_missing_sets(bouts):
    roles = P.make_roles(bouts, D)
    thin = bouts.where("not (cls = 1 and period_order = 1 and series_id % 10 <> 4)")
    train = P.train_sets(P.nested_set_order(thin, roles, D), D)
    short = P.missing_sets(train, D)
    assert short.where("k = 2 and short_classes = 1").count() == short.where("k = 2").count() > 0
    assert short.where("k = 1 and short_classes > 0").count() == 0


def test_depth_and_extra(bouts):
    roles, order, *_ = build(bouts)
    d = P.depth_sets(bouts, roles, D, 2, 4, ["series_id"]).toPandas()
    g = d[d.set_rank <= 3]
    assert (g.period_order == 1).all() and (d[d.set_rank == 4].period_order == 2).all()
    same = d[d.set_rank <= 2].merge(order.toPandas(), on=["repeat", "series_id"])
    assert (same.set_rank_x == same.set_rank_y).all() and len(same) == 2 * 2 * 3 * 2
    e = P.extra_sets(order, 2, [1]).groupBy("repeat", "subject", "cls").count().toPandas()
    assert (e["count"] == e.cls.map(lambda c: 2 if c == 1 else 1)).all()


@pytest.mark.parametrize("n,frac,want", [(35, 0.3, 10), (3, 0.1, 1), (5, 0.5, 2)])
def test_subject_split_sizes(spark, n, frac, want):
    s = P.subject_split(spark.range(n).withColumnRenamed("id", "subject"), frac, 1).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in s} == {"test": want, "train": n - want}


def test_group_kfold_has_no_shared_subject(bouts):
    f = P.group_kfold(bouts, 3)
    assert f.count() == 8 and f.groupBy("subject").count().where("count > 1").count() == 0
    assert f.groupBy("fold").count().where("count > 3").count() == 0


def test_quality_flags(spark):
    rows = [("ok", 0, 1, 0, 1.0), ("ok", 1, 1, 0, 1.0), ("ok", 2, 1, 40, 1.0), ("ok", 3, 1, 1000, 1.0),
            ("bad", 0, 1, 10, 1.0), ("bad", 1, 3, 5, None), ("bad", 2, 1, 10, 1.0), ("one", 0, 1, 7, 1.0)]
    d = spark.createDataFrame(rows, "series_id string, i int, row int, t_ms bigint, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    for size in (1, 2, 100):
        q = {r["series_id"]: r for r in A.series_quality(d, ["i"], F.floor(F.col("i") / size)).collect()}
        assert q["ok"]["error"] == "" and q["ok"]["rate_hz"] == pytest.approx(3.0) and q["ok"]["frac_shared_ts"] == pytest.approx(1 / 3)
        assert q["ok"]["max_gap_ms"] == 960
        assert q["bad"]["error"] == "missing values; non-sensor rows; timestamps go backwards; zero duration"
        assert q["one"]["error"] == "zero duration" and q["one"]["rate_hz"] is None and q["one"]["max_gap_ms"] == 0


def test_exclusion_precedence(spark):
    d = spark.createDataFrame([(1, ""), (1, "zero duration"), (5, ""), (5, "missing values")], "rep_count int, error string")
    got = [(r["exclude_reason"], r["include"]) for r in A.flag_exclusions(d).collect()]
    assert got == [("rep_count<=1", False), ("zero duration", False), ("", True), ("missing values", False)]


def test_reconcile(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(2, 2.5), (3, 1.0)], "k int, v double")
    r = J.reconcile(a, b, ["k"], "v").first()
    assert (r["matched"], r["only_left"], r["only_right"], r["max_abs_diff"], r["agrees"]) == (1, 1, 1, 0.5, False)
    assert J.reconcile(a, a, ["k"], "v").first()["agrees"]


def test_sample_and_side_files(spark, tmp_path):
    stem = "ann_2024_0131_101500_segment03_06"
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann" / f"{stem}.csv").write_text("1,0,0.5,0,9.8\n2,5,0,0,0\n1,10,0.6,0,9.8\n")
    s = FI.scan_samples(spark, str(tmp_path))
    assert [tuple(r) for r in s.orderBy("pos").select("stem", "t_ms", "x").collect()] == [(stem, 0, 0.5), (stem, 10, 0.6)]
    assert FI.scan_samples(spark, str(tmp_path), sensor_only=False).count() == 3
    (tmp_path / "ann" / f"{stem}.txt").write_text("ann,12,f,19x0,60.5,-\n6,DEADLIFT,8\n")
    i = FI.attach_sidecar(s, FI.scan_sidecars(spark, str(tmp_path))).first()
    assert i["birth_year"] is None and i["height_cm"] is None and i["weight_kg"] == 60.5 and i["reps"] == 8 and i["class_agrees"]
    p = A.parse_series_name(spark.createDataFrame([(stem,), ("ann_2024_0131_101500_segment03_rest",)], "name string")).collect()
    assert p[0]["session_id"] == "ann_2024_0131_101500" and str(p[0]["period_date"]) == "2024-01-31" and p[0]["cls"] == 6
    assert not p[1]["matched"] and p[1]["cls"] is None


def test_results_round_trip(spark, tmp_path):
    d = FI.with_run_info(spark.createDataFrame([(1, 0.5)], "n int, v double"), seed=3, revision="abc")
    for fmt in ("parquet", "csv", "csv.gz"):
        p = FI.write_result(d, str(tmp_path / fmt), fmt)
        back = FI.scan_table(spark, p, None if fmt == "parquet" else "n int, v double, seed int, revision string", fmt=fmt.split(".")[0])
        assert [tuple(r) for r in back.collect()] == [(1, 0.5, 3, "abc")]


def test_late_rows_are_dropped(spark, tmp_path):
    from seriesloom.streaming import running as R

    src = tmp_path / "in"
    src.mkdir()

    def put(name, rows):
        pdf = pd.DataFrame(rows, columns=["ts", "subject", "x"])
        pdf["ts"] = pd.to_datetime(pdf.ts).astype("datetime64[us]")
        pdf.to_parquet(src / name)

    import os

    put("a.parquet", [("2024-01-01 00:00:10", "s", 1.0), ("2024-01-01 01:00:00", "s", 2.0)])
    put("b.parquet", [("2024-01-01 01:30:00", "s", 2.0)])
    # the watermark of one batch filters late rows in the next but one
    put("c.parquet", [("2024-01-01 00:00:20", "s", 50.0), ("2024-01-01 02:00:00", "s", 3.0)])
    for i, name in enumerate("abc"):
        os.utime(src / f"{name}.parquet", (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema("ts timestamp, subject string, x double").option("maxFilesPerTrigger", 1).parquet(str(src))
    out = R.drain(spark, R.windowed_features(stream, "2 seconds", "1 second", "1 minute"), "late")
    assert out.agg(F.max("max")).first()[0] == 2.0 and out.where("mean = 50.0").count() == 0
    assert out.where("mean = 1.0").count() == 2


def test_streamed_state_survives_batches(spark, tmp_path):
    from seriesloom.operators import votes as V
    from seriesloom.streaming import running as R

    rng = __import__("numpy").random.default_rng(0)
    rows = [(s, "p", s % 3, w, float(w), rng.dirichlet([1, 1, 1]).tolist()) for s in range(6) for w in range(8)]
    schema = "series_id bigint, subject string, truth int, w int, t0_s double, proba array<double>"
    d = spark.createDataFrame(rows, schema)
    for i, (a, b) in enumerate(((0, 3), (3, 4), (4, 8))):
        d.where(f"w >= {a} and w < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    got = R.drain(spark, R.running_calls(stream, [], 3, 2.0), "state")
    want = V.running_vote(d.withColumnRenamed("truth", "cls"), [], 3, 2.0)
    both = got.join(want.withColumnRenamed("call", "batch_call"), ["series_id", "w"])
    assert both.count() == 48 and both.where("call <> batch_call").count() == 0


def test_stream_table_reads_files_and_folders(spark, tmp_path):
    from seriesloom.streaming import running as R

    df = spark.range(20).repartition(3)
    df.write.parquet(str(tmp_path / "parts" / "a.parquet"))
    (tmp_path / "one").mkdir()
    df.toPandas().to_parquet(tmp_path / "one" / "a.parquet")
    df.write.parquet(str(tmp_path / "one" / "b.parquet"))
    for folder in ("parts", "one"):
        got = R.drain(spark, R.stream_table(spark, str(tmp_path / folder), "a"), "read")
        assert sorted(r.id for r in got.collect()) == list(range(20))
