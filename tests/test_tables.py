"""Joins against tables, sketches, bootstraps, permutations and kept tables on small cases: NULL keys, ties, empty tables, hot keys."""

import itertools
import math
from hashlib import md5

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from seriesloom import session
from seriesloom.functions import ordering as O
from seriesloom.functions.hashing import leading_digits
from seriesloom.operators import audit as A
from seriesloom.operators import features as FE
from seriesloom.operators import joins as J
from seriesloom.operators import selection as SEL
from seriesloom.operators import stats as ST
from seriesloom.operators import votes as V
from seriesloom.plans import cohort as P
from seriesloom.plans import variants as VA


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- as-of against a table ---------------------------------------------------------------------------


def test_split_last_equals_a_plain_pass(spark):
    rng = np.random.default_rng(1)
    rows = [(k, t, None if rng.random() < 0.6 else int(rng.integers(0, 9))) for k in (1, 2, None) for t in range(50)]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    want, last = {}, {}
    for k, t, v in rows:
        last[k] = v if v is not None else last.get(k)
        want[k, t] = last[k]
    for width in (3, 1000):
        found = O.split_last(df, ["k"], ["t"], F.floor(F.col("t") / width), "v", "out")
        assert {(r.k, r.t): r.out for r in found.collect()} == want
    assert O.split_last(df.limit(0), ["k"], ["t"], F.col("t"), "v", "out").count() == 0


def test_asof_join(spark):
    running = spark.createDataFrame([(None, 1, 1.0, 5), (None, 1, 2.0, 6), (None, 1, 9.0, 7), ("a", 1, 4.0, 8)], "c string, series_id long, end_s double, call int")
    asked = [(None, 1, 0.2, "early"), (None, 1, 1.0, "inclusive"), (None, 1, 1.9, "x"), (None, 1, 2.0, "x"), (None, 1, 2.0, "x"), (None, 1, 8.9, None), (None, 1, None, "end"), ("a", 1, 3.0, "y"), ("b", 1, 3.0, "none")]
    times = spark.createDataFrame(asked, "c string, series_id long, t_s double, tag string")
    want = sorted(((*a, c) for a, c in zip(asked, (5, 5, 5, 6, 6, 6, 7, 8, None), strict=True)), key=repr)
    for piece in (0.5, 600.0):
        found = V.asof_join(running, times, ["c"], piece_s=piece)
        assert rows_of(found) == want
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert V.asof_join(running, times.limit(0), ["c"]).count() == 0


# --- interval joins ----------------------------------------------------------------------------------


@pytest.mark.parametrize(("width", "crowd"), [(None, 100_000), (0.7, 5), (50.0, 1)])
def test_interval_join_equals_all_pairs(spark, width, crowd):
    rng = np.random.default_rng(2)
    rows = [(i, (None, "a", "b")[int(rng.integers(0, 3))], None if i % 17 == 0 else float(round(rng.normal() * 3, 1))) for i in range(200)] + [(1000 + i, "a", 2.0) for i in range(40)]
    bands = [(f"b{j}", (None, "a", "b")[j % 3], float(lo), float(lo + n)) for j, (lo, n) in enumerate(zip(rng.integers(-8, 8, 30), rng.choice([0.0, 0.5, 3.0, -1.0, 9.0], 30), strict=True))]
    bands += [("open", "a", None, 1.0), ("edge", "a", 2.0, 2.5), ("ends", "a", 1.5, 2.0)]
    d = spark.createDataFrame(rows, "i int, k string, v double")
    b = spark.createDataFrame(bands, "band string, k string, lo double, hi double")
    want = [(i, n) for i, k, v in rows for n, c, lo, hi in bands if k == c and v is not None and lo is not None and lo <= v < hi]
    found = J.interval_join(d, "v", b, "lo", "hi", ["k"], width, crowd)
    assert rows_of(found.select("i", "band")) == sorted(want, key=repr)
    left = J.interval_join(d, "v", b, "lo", "hi", ["k"], width, crowd, "left")
    assert rows_of(left.select("i", "band")) == sorted(want + [(i, None) for i, *_ in rows if i not in {w[0] for w in want}], key=repr)
    assert J.interval_join(d, "v", b.limit(0), "lo", "hi", ["k"]).count() == 0


def test_interval_sums_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [((None, "a", "b")[i % 3], None if i % 17 == 0 else float(round(rng.normal() * 3, 1)), None if i % 5 == 0 else float(rng.integers(-90, 90)) / 8) for i in range(300)]
    bands = [(f"b{j}", (None, "a", "b", "c")[j % 4], float(lo), float(lo + n)) for j, (lo, n) in enumerate(zip(rng.integers(-8, 8, 40), rng.choice([0.0, 0.5, 3.0, -1.0, 99.0], 40), strict=True))]
    bands += [("open", "a", None, 1.0), ("b1", "a", -50.0, 50.0), ("big", "a", -1e300, 1e300)]
    d = spark.createDataFrame(rows, "k string, v double, x double")
    b = spark.createDataFrame(bands, "band string, k string, lo double, hi double")
    want = []
    for band, c, lo, hi in bands:
        own = [x for k, v, x in rows if k == c and v is not None and lo is not None and lo <= v < hi]
        if own:
            want.append((band, len(own), sum(x for x in own if x is not None) if any(x is not None for x in own) else None))
    found = J.interval_sums(d, "v", b, "lo", "hi", {"s": "x"}, ["k"])
    assert rows_of(found.select("band", "n_rows", "s")) == sorted(want, key=repr)
    assert J.interval_sums(d.where("v = 0.25"), "v", b, "lo", "hi", {"s": "x"}, ["k"]).count() == 0
    assert J.interval_sums(d, "v", b.limit(0), "lo", "hi", {"s": "x"}, ["k"]).count() == 0
    whole = J.interval_sums(d, "v", b.where("band = 'big'"), "lo", "hi", {"s": "x"}).first()
    assert whole.n_rows == sum(v is not None for _, v, _ in rows)
    odd = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, float("nan"))], "i int, v double")
    half = spark.createDataFrame([(0.5, 1.5), (1.5, 9.0)], "lo double, hi double")
    assert rows_of(J.interval_sums(odd, "i", half, "lo", "hi", {}).select("lo", "n_rows")) == [(0.5, 1), (1.5, 2)]
    assert rows_of(J.interval_sums(odd, "v", half, "lo", "hi", {"s": "v"}).select("lo", "n_rows", "s")) == [(0.5, 1, 1.0), (1.5, 1, 2.0)]


def test_interval_join_query_makes_no_pairs(spark, tmp_path):
    """Every customer's interval holds every order, of which there are too many for their pairs to be made in a test."""
    from seriesloom.catalog import scoring

    n = 100_000
    spark.range(n).select(F.col("id").alias("c_custkey"), F.lit(0.0).alias("c_acctbal")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") % 400 + 0.25).alias("o_totalprice")).write.parquet(str(tmp_path / "orders.parquet"))
    got = scoring.interval_join(spark, str(tmp_path)).agg(F.count(F.lit(1)), F.min("n_orders"), F.max("total"), F.min("total")).first()
    total = sum(i % 400 + 0.25 for i in range(n))
    assert tuple(got) == (n, n, total, total)


def test_equivalent_x_on_long_and_flat_curves(spark):
    curve = spark.createDataFrame([("a", x, y) for x, y in ((1, 0.2), (2, 0.5), (3, 0.4), (4, 0.5), (6, 0.9))] + [(None, x, x / 100) for x in range(300)], "k string, x int, y double")
    scores = spark.createDataFrame([("a", v) for v in (0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 0.95)] + [(None, 1.505), ("b", 0.3), ("a", None)], "k string, v double")
    found = {(r.k, r.v): r.equivalent_x for r in ST.equivalent_x(scores, curve, ["k"], "x", "y", "v").collect()}
    assert found["a", 0.1] is None and found["a", 0.95] is None and found["b", 0.3] is None and found["a", None] is None
    assert [found["a", v] for v in (0.2, 0.35, 0.5, 0.7, 0.9)] == pytest.approx([1.0, 1.5, 4.0, 5.0, 6.0])
    assert found[None, 1.505] == pytest.approx(150.5)


# --- NULL groups -------------------------------------------------------------------------------------


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("b", None)], "k string, v double")
    exact = {r.k: (r.n, r.p50) for r in A.describe(df, ["k"], "v", (50,)).collect()}
    assert exact == {None: (2, 2.0), "a": (1, 5.0), "b": (0, None)}
    rough = {r.k: (r.n, r.p50) for r in A.describe(df, ["k"], "v", (50,), approximate=True).collect()}
    assert rough == {None: (2, 1.0), "a": (1, 5.0), "b": (0, None)}
    assert A.describe(df, [], "v", (50,)).first().p50 == 3.0 and A.describe(df.limit(0), ["k"], "v", (50,)).count() == 0
    bouts = spark.createDataFrame([(None, 1, "s", 3, 2.0), (None, 2, "s", 4, 2.0), ("a", 1, "t", None, 1.0)], "cls string, subject int, session_id string, rep_count int, duration_s double")
    assert {r.cls: r.bouts for r in A.class_audit(bouts).collect()} == {None: 2, "a": 1}
    same = J.reconcile(df, df, ["k"], "v").first()
    keyed = df.where("v <> 3.0 OR v IS NULL")
    assert J.reconcile(keyed, keyed, ["k"], "v").first().agrees and same.only_left == same.only_right == 0


# --- sketches ----------------------------------------------------------------------------------------


def test_sketches_merge_over_periods(spark):
    df = spark.range(60_000).select((F.col("id") % 12).alias("month"), (F.col("id") % 30_000).alias("who"), (F.col("id") * 7919 % 60_000).cast("double").alias("v"))
    kept = A.period_sketches(df, ["month"], "v", ["who"])
    assert kept.count() == 12
    one = A.merged_sketches(kept, (), (5, 50, 95), ["who"]).first()
    assert one.n_rows == 60_000 and abs(one.n_who / 30_000 - 1) < 0.05
    assert all(abs(one[f"p{p}"] / 60_000 - p / 100) < 0.02 for p in (5, 50, 95))
    half = A.merged_sketches(kept.where("month < 6"), (), (50,), ["who"]).first()
    assert half.n_rows == 30_000 and abs(half.n_who / 15_000 - 1) < 0.05
    assert A.merged_sketches(A.period_sketches(df.limit(0), ["month"], "v"), ["month"], (50,)).count() == 0


# --- vector bootstrap --------------------------------------------------------------------------------


def test_vector_bootstrap_equals_weighted_sums(spark, monkeypatch):
    rows = [(k, u, None if u == 3 else float(u * u % 11)) for k in (None, "a") for u in range(20)] + [("b", 7, 2.0)]
    df = spark.createDataFrame(rows, "k string, u int, v double").repartition(3)
    cut = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(9)])
    weight = lambda r, u: int(np.searchsorted(cut, int(md5(f"5|{r}|{u}".encode()).hexdigest()[:8], 16) / 2**32, side="right"))
    want = {}
    for k in (None, "a", "b"):
        for r in range(1, 31):
            own = [(weight(r, u), v) for c, u, v in rows if c == k and v is not None]
            n = sum(w for w, _ in own)
            want[k, r] = sum(w * v for w, v in own) / n if n else None
    for held in (1 << 23, 1):
        monkeypatch.setattr(ST, "HELD_NUMBERS", held)
        found = {(r.k, r.rep): r.v for r in ST.poisson_resamples(df, ["k"], "u", ["v"], 30, 5).collect()}
        assert found.keys() == want.keys() and all(found[i] == pytest.approx(want[i]) for i in want)
    whole = ST.poisson_resamples(df, [], "u", ["v"], 10, 5)
    assert whole.count() == 10 and ST.poisson_resamples(df.limit(0), ["k"], "u", ["v"], 10, 5).count() == 0
    assert ST.bootstrap_ci(df, ["k"], "u", "v", 200, 5, method="poisson").where("ci_lo <= mean AND mean <= ci_hi").count() == 3


def test_vector_bootstrap_weighs_in_many_tasks(spark, tmp_path, monkeypatch):
    """However small the table, its draws are not made in one task."""
    df = spark.range(400).select(F.col("id").alias("u"), F.col("id").cast("double").alias("v")).coalesce(1)

    def told(heads, tails, both=False):
        (tmp_path / str(TaskContext.get().partitionId())).touch()
        return leading_digits(heads, tails, both)

    monkeypatch.setattr(ST, "leading_digits", told, raising=False)
    assert ST.poisson_resamples(df, [], "u", ["v"], 5, 1).count() == 5
    assert len(list(tmp_path.iterdir())) > 4


def test_leading_digits_equal_hashlib():
    heads = [f"7|{r}".encode() for r in (1, 10, 99, 12345)] + [b""]
    tails = [f"|{u}".encode() for u in (0, 31, 10**12)] + [b"", *(b"x" * n for n in (46, 47, 50, 51, 52, 55, 56, 80))]
    for both, size in ((False, 8), (True, 16)):
        got = {(h, t): int(v) for hs, ts, cells in leading_digits(heads, tails, both) for h, row in zip(hs, cells, strict=True) for t, v in zip(ts, row, strict=True)}
        assert got == {(i, j): int(md5(h + t).hexdigest()[:size], 16) for i, h in enumerate(heads) for j, t in enumerate(tails)}


# --- permutation p -----------------------------------------------------------------------------------


def test_rank_trend(spark):
    small = [("s", k, float(x), float(y)) for k, (x, y) in enumerate(((1, 2), (2, 1), (3, 3), (4, 5), (5, 5), (6, 9)))]
    flat = [("f", k, float(k), 1.0) for k in range(4)]
    rng = np.random.default_rng(3)
    large = [(None, k, float(k), float(k // 3 + rng.normal())) for k in range(60)] + [("r", k, float(k), float(rng.normal())) for k in range(60)] + [("r", 99, None, 1.0)]
    df = spark.createDataFrame(small + flat + large, "g string, u int, x double, y double")
    found = {r.g: r for r in ST.rank_trend(df, ["g"], "u", "x", "y", 99, 0).collect()}
    ranks = lambda v: np.array([np.mean([i + 1 for i, z in enumerate(sorted(v)) if z == a]) for a in v])
    x, y = ranks([r[2] for r in small]), ranks([r[3] for r in small])
    rho = np.corrcoef(x, y)[0, 1]
    every = [np.corrcoef(x, o)[0, 1] for o in itertools.permutations(y)]
    assert found["s"].rho == pytest.approx(rho) and found["s"].p == pytest.approx(np.mean(np.abs(every) >= abs(rho) - 1e-12))
    assert found["f"].rho is None and found["f"].p is None and found["f"].n == 4
    assert found[None].p == pytest.approx(0.01) and found["r"].n == 60 and found["r"].p > 0.01
    whole = ST.rank_trend(df.where("g = 's'"), [], "u", "x", "y", 99, 0).first()
    assert whole.p == pytest.approx(found["s"].p)


def test_permuted_sums_equal_sorted_orders(spark, monkeypatch):
    """Orders are sorted in parts of arrays, not as a row for each unit and order."""
    rng = np.random.default_rng(6)
    sizes = {1: 150, 2: 9, 3: 40}
    rows = [(g, k, f"u{g}-{k}" if k else None, float(rng.integers(2, 99)) / 2, float(rng.integers(2, 9)) / 2) for g, n in sizes.items() for k in range(n)]
    digits = lambda r, u: md5("|".join(["4", str(r), *([u] if u else [])]).encode()).hexdigest()
    want = {}
    for g in sizes:
        own = [r for r in rows if r[0] == g]
        for r in range(20):
            y = [q[4] for q in sorted(own, key=lambda q: digits(r + 1, q[2]))]
            want[g, r] = sum(q[3] * v for q, v in zip(own, y, strict=True))
    df = spark.createDataFrame(rows, "_g long, k long, _u string, _rx double, _ry double").withColumn("_i", F.col("k") + 1)
    for block, sent, parts in ((4096, 1 << 22, 1), (7, 100, 30), (1, 20, 1000)):
        monkeypatch.setattr(ST, "BLOCK", block)
        monkeypatch.setattr(ST, "SENT_CELLS", sent)
        found = ST.permuted_sums(df.withColumn("_parts", F.lit(parts).cast("bigint")), 20, 4)
        assert {(r["_g"], r["_r"]): r["_t"] for r in found.collect()} == want
    assert ST.permuted_sums(df.limit(0).withColumn("_parts", F.lit(1).cast("bigint")), 20, 4).count() == 0


# --- kept tables -------------------------------------------------------------------------------------


def test_materialize_follows_its_input(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(5).write.parquet(f"{folder}/a.parquet")
    calls = []

    def count():
        calls.append(1)
        return spark.read.parquet(f"{folder}/a.parquet")

    for outlive in (False, True):
        calls.clear()
        first = session.materialize(count, spark, ("kept-test", folder, outlive), outlive)
        assert session.materialize(count, spark, ("kept-test", folder, outlive), outlive).count() == first.count() and len(calls) == 1
        if outlive:  # as another session would
            session._saved.clear()
            assert session.materialize(count, spark, ("kept-test", folder, outlive), outlive).count() and len(calls) == 1
        old = first.inputFiles()[0].removeprefix("file://")
        spark.range(3).write.mode("append").parquet(f"{folder}/a.parquet")
        again = session.materialize(count, spark, ("kept-test", folder, outlive), outlive)
        assert len(calls) == 2 and again.count() > 5 and not __import__("os").path.exists(old)
    assert session.drop_materialized(spark, "kept-test") >= 1 and session.drop_materialized(spark, "kept-test") == 0


# --- refusals, first values, ids of any type -----------------------------------------------------------


def test_shared_subjects_and_missing_sets_are_refused(spark):
    a = spark.createDataFrame([("p1",), ("p2",), (None,)], "subject string")
    b = spark.createDataFrame([("p3",), (None,)], "subject string")
    P.refuse_shared(a, b)
    P.refuse_shared(a.limit(0), a)
    with pytest.raises(ValueError, match="p1, p2"):
        P.refuse_shared(a, a.unionByName(b))
    with pytest.raises(ValueError, match="p1 and more"):
        P.refuse_shared(a, a, shown=1)
    design = P.Design(n_classes=2)
    rows = [(1, 2, 1, 5, c, 10 + c) for c in (0, 1)] + [(1, 2, 2, 6, 0, 20), (1, 2, 2, 6, 0, 21), (1, 2, 2, 6, 1, 22)]
    train = spark.createDataFrame(rows, "repeat int, n_team int, k int, subject long, cls int, series_id long")
    P.refuse_missing(train.where("k = 1"), design)
    with pytest.raises(ValueError, match="subject 6 lacks them in 1 classes"):
        P.refuse_missing(train, design)


def test_first_known_values(spark):
    df = spark.createDataFrame([(1, 2, None, "b"), (1, 1, None, None), (1, 3, "x", "c"), (None, 1, "y", None)], "k int, t int, a string, b string")
    assert rows_of(SEL.first_known(df, ["k"], ["t"], ["a", "b"])) == sorted([(1, "x", "b"), (None, "y", None)], key=repr)
    assert SEL.first_known(df.limit(0), ["k"], ["t"], ["a"]).count() == 0


def test_top_fraction_takes_ids_of_any_type(spark):
    rows = [(f"s{k:03d}", k % 2, 0.5 if k < 30 else 0.9) for k in range(50)]
    named = spark.createDataFrame(rows, "series_id string, pred int, conf double")
    numbers = named.withColumn("series_id", F.substring("series_id", 2, 3).cast("long"))
    found = {int(r.series_id[1:]) for r in SEL.top_fraction_per_class(named, [], 0.5).collect()}
    assert found == {r.series_id for r in SEL.top_fraction_per_class(numbers, [], 0.5).collect()} and len(found) == 26
    assert {0, 1, 2, 3, 4, 5} <= found and set(range(30, 50)) <= found


# --- features and fold profiles ----------------------------------------------------------------------


def test_window_features_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    signal = lambda n: [rng.normal(size=n).tolist() for _ in range(4)]
    rows = [(1, signal(8)), (2, signal(16)), (3, None), (4, signal(8)), (5, [[1.0, 2.0]] * 3), (6, [[1.0], [1.0, 2.0], [1.0], [1.0]]), (7, [[], [], [], []])]
    df = spark.createDataFrame(rows, "i int, ch array<array<double>>").coalesce(1)
    found = {r.i: r for r in FE.window_features(df, 8.0).collect()}
    for i in (1, 2, 4):
        alone = FE.window_features(df.where(f"i = {i}"), 8.0).first()
        assert tuple(alone) == tuple(found[i]) and found[i][1] is not None
    assert all(v is None for i in (3, 5, 6, 7) for v in found[i][1:])
    for r in FE.spectral_features(df, 8.0).where("i = 2").collect():
        assert (r.domf, r.domp, r.spent) == tuple(found[2][f"{r.channel}_{s}"] for s in ("domf", "domp", "spent"))


def test_fold_profiles_equal_medians_of_the_other_folds(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 3)), int(rng.integers(0, 4)), [float(round(v, 1)) for v in rng.normal(size=2)]) for _ in range(200)] + [(9, 0, [1.0, None]), (9, 1, [2.0, 3.0])]
    found = {(r.cls, r.out, r.mi): (r.mu, r["var"]) for r in VA.fold_profiles(spark.createDataFrame(rows, "cls int, fold int, m array<double>"), 4).collect()}
    for cls in (0, 1, 2, 9):
        for out in range(4):
            for mi in range(2):
                own = [m[mi] for c, f, m in rows if c == cls and f != out and m[mi] is not None]
                if own:
                    mu, var = found.pop((cls, out, mi))
                    assert mu == pytest.approx(np.median(own)) and (var is None if len(own) < 2 else var == pytest.approx(np.var(own, ddof=1)))
    assert not found
