"""Re-timing, resampling, filters, windows and features on analytic signals."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import arrays as A
from seriesloom.operators import features as FE
from seriesloom.operators import augment as AU
from seriesloom.operators import gravity as GR
from seriesloom.operators import signal as S


def long_series(spark, n, rate, freq=1.0, sid="a", burst=3):
    t = np.arange(n) / rate
    stamp = (np.arange(n) // burst * burst / rate * 1000).astype(np.int64)
    stamp[-1] = int(t[-1] * 1000)
    return spark.createDataFrame(pd.DataFrame(dict(series_id=sid, i=np.arange(n), t_ms=stamp, x=np.sin(2 * np.pi * freq * t), y=0.0, z=9.81)))


def piece(n=100):
    return F.floor(F.col("i") / n)


def test_resample_keeps_rate_peak_and_constant(spark):
    d = long_series(spark, 950, 95.0)
    r = S.resample_linear(d, ["i"], piece(), 30.0).orderBy("g").toPandas()
    end = d.agg(F.max("t_ms")).first()[0] / 1000
    assert abs(len(r) - (int(end * 30) + 1)) <= 1 and list(r.g) == list(range(len(r)))
    f = np.fft.rfftfreq(len(r), 1 / 30)
    assert abs(f[np.abs(np.fft.rfft(r.x - r.x.mean())).argmax()] - 1.0) < 0.15
    assert np.allclose(r.z, 9.81, atol=1e-6)
    tt = np.arange(950) / (949 / end)
    assert np.allclose(r.x, np.interp(r.t_s, tt, d.orderBy("i").toPandas().x), atol=1e-9)


def test_resample_guards(spark):
    assert S.resample_linear(long_series(spark, 15, 50.0), ["i"], piece(4), 30.0).count() == 0
    assert S.resample_linear(long_series(spark, 16, 50.0, burst=1), ["i"], piece(4), 30.0).count() > 0
    still = long_series(spark, 40, 50.0).withColumn("t_ms", F.lit(5).cast("bigint"))
    assert S.resample_linear(still, ["i"], piece(4), 30.0).count() == 0


def test_zero_phase_on_sines():
    fs, t = 95.0, np.arange(1900) / 95.0
    low, high = np.sin(2 * np.pi * t), np.sin(2 * np.pi * 35 * t)
    y = S.zero_phase((low + high)[:, None], 4, 12.0, fs)[:, 0]
    assert np.abs(y - low)[50:-50].max() < 2e-3
    assert np.allclose(S.zero_phase(np.full((40, 1), 9.81), 4, 12.0, fs), 9.81, atol=1e-9)
    # at the cutoff one pass has gain 1/sqrt 2, two passes 1/2
    edge = S.zero_phase(np.sin(2 * np.pi * 12 * t)[:, None], 4, 12.0, fs)[200:-200, 0]
    assert abs(np.abs(edge).max() - 0.5) < 0.01


def test_chunked_filter_equals_whole_series(spark):
    d = long_series(spark, 1500, 95.0, 1.3, burst=1).withColumn("y", F.rand(3))
    whole = S.lowpass_zero_phase(d, ["i"], piece(), 4, 12.0).orderBy("idx").toPandas()
    parts = S.lowpass_zero_phase(d, ["i"], piece(), 4, 12.0, chunk=400).orderBy("idx").toPandas()
    assert len(whole) == len(parts) == 1500
    assert np.abs(whole[["x", "y", "z"]].to_numpy() - parts[["x", "y", "z"]].to_numpy()).max() < 1e-9


def test_filter_is_skipped_at_low_rates(spark):
    d = long_series(spark, 60, 20.0, burst=1)
    out = S.lowpass_zero_phase(d, ["i"], piece(), 4, 12.0).orderBy("idx").toPandas()
    assert np.allclose(out.x, d.orderBy("i").toPandas().x)


def packed_rows(spark, lengths, fill=None):
    rows = []
    for i, n in enumerate(lengths):
        x = np.random.default_rng(i).normal(size=(3, n)) if fill is None else fill(n)
        rows.append((i, 0, i % 2, np.vstack([x, np.sqrt((x ** 2).sum(0))]).tolist()))
    return spark.createDataFrame(rows, "series_id bigint, subject bigint, cls int, ch array<array<double>>")


def test_windows_at_the_edges(spark):
    d = packed_rows(spark, [59, 60, 95, 90, 40])
    w = FE.sliding_windows(d, 2.0, 0.5, 30.0)
    n = {r["series_id"]: r["count"] for r in w.groupBy("series_id").count().collect()}
    assert n == {1: 1, 2: 2, 3: 2}
    assert [r["series_id"] for r in FE.short_series(d, 2.0, 0.5, 30.0).orderBy("series_id").collect()] == [0, 4]
    second = w.where("series_id = 2 and w = 1").first()
    assert second["t0_s"] == 1.0 and len(second["ch"][0]) == 60
    assert second["ch"][0][0] == d.where("series_id = 2").first()["ch"][0][30]


def test_features_of_two_tones_and_flat_channels(spark):
    def tone(f):
        t = np.arange(60) / 30
        return lambda n: np.vstack([np.sin(2 * np.pi * f * t), np.zeros(60), np.full(60, 9.81)])

    d = packed_rows(spark, [60], tone(2)).unionByName(packed_rows(spark, [60], tone(5)).withColumn("series_id", F.lit(1).cast("bigint")))
    w = FE.sliding_windows(d, 2.0, 0.5, 30.0)
    f = FE.window_features(w, 30.0).orderBy("series_id").toPandas()
    assert len(FE.feature_names()) == 59 and abs(f.x_domf[0] - 2) < 0.5 and abs(f.x_domf[1] - 5) < 0.5
    assert np.isfinite(f[FE.feature_names()].to_numpy()).all()
    assert (f[["y_std", "y_skew", "z_kurt", "corr_xy", "corr_xz"]].abs() < 1e-9).all().all()
    native = A.drop_helpers(A.spectral_features(A.shape_features(A.stats_features(A.centre(FE.by_channel(w))), 30.0), 30.0)).toPandas()
    assert np.isfinite(native[FE.PER_CHANNEL].to_numpy()).all()
    x = native[native.channel == "x"].sort_values("series_id")
    for c in FE.PER_CHANNEL:
        assert np.allclose(x[c], f[f"x_{c}"], atol=1e-9), c


def test_variants_share_window_keys_and_add_up(spark):
    d = packed_rows(spark, [120, 95])
    w = {v: FE.sliding_windows(GR.split_variant(d, v, 30.0), 2.0, 0.5, 30.0).orderBy("series_id", "w").toPandas() for v in GR.VARIANTS}
    for v in w:
        assert list(zip(w[v].series_id, w[v].w)) == list(zip(w["full"].series_id, w["full"].w))
    a = lambda v: np.array([np.array([np.asarray(c) for c in ch][:3]) for ch in w[v].ch])
    assert np.allclose(a("gravity") + a("motion"), a("full"))
    assert len(w["magnitude"].ch[0]) == 1


def test_series_measures(spark):
    t = np.arange(300) / 30
    d = packed_rows(spark, [300], lambda n: np.vstack([9.81 + 2 * np.sin(2 * np.pi * t * 0.7), np.zeros(300), np.zeros(300)]))
    m = GR.series_measures(d, 30.0).first()
    assert m["forearm_direction"] == pytest.approx(1.0) and m["forearm_turning"] < 1e-4
    assert 0.1 < m["movement_size_g"] < 0.2 and 0.2 <= m["rep_speed_hz"] <= 3
    assert GR.series_measures(packed_rows(spark, [16]), 30.0, band=(0.1, 0.2)).first()["rep_speed_hz"] is None


def test_augmentation_is_seeded_and_stays_in_range(spark):
    d = packed_rows(spark, [120, 95])
    a = AU.augment_retime_scale(d, 3, 5, 30.0, max_degrees=15).orderBy("sim_id").toPandas()
    b = AU.augment_retime_scale(d.repartition(3), 3, 5, 30.0, max_degrees=15).orderBy("sim_id").toPandas()
    assert list(a.sim_id) == ["0#sim0", "0#sim1", "0#sim2", "1#sim0", "1#sim1", "1#sim2"]
    assert all(np.allclose(np.array([list(c) for c in x]), np.array([list(c) for c in y])) for x, y in zip(a.ch, b.ch))
    assert all(round(n / 1.2) - 1 <= len(ch[0]) <= round(n / 0.8) + 1 for ch, n in zip(a.ch, [120] * 3 + [95] * 3))
    w = FE.sliding_windows(d, 2.0, 0.5, 30.0)
    p = AU.augment_permute_rotate(w, 2, 5).toPandas()
    ch = np.array([[list(c) for c in x] for x in p.ch])
    assert ch.shape == (2 * w.count(), 4, 60) and np.allclose(ch[:, 3], np.linalg.norm(ch[:, :3], axis=1))
    with pytest.raises(Exception, match="pieces"):
        AU.augment_permute_rotate(FE.sliding_windows(d, 1.0, 0.5, 30.0), 1, 5).collect()


def test_turning_keeps_lengths_and_right_angles(spark):
    d = packed_rows(spark, [40])
    out = AU.turned(F.slice("ch", 1, 3), F.lit(1.1), F.lit(0.3), F.lit(2.0))
    r = d.select("ch", out.alias("t")).first()
    x, y = np.array([list(c) for c in r.ch])[:3], np.array([list(c) for c in r.t])
    assert np.allclose(x.T @ x, y.T @ y) and not np.allclose(x, y)


def test_places_of_a_warp_are_increasing_and_span_the_window(spark):
    from seriesloom.functions.hashing import draw_unit

    d = spark.range(50).select(AU.warped_places(F.lit(60), lambda tag: draw_unit(1, "id", F.lit(tag)), 4, 0.2).alias("p"))
    p = np.array([r.p for r in d.collect()])
    assert np.allclose(p[:, 0], 0) and np.allclose(p[:, -1], 59) and (np.diff(p, axis=1) > 0).all()


def test_short_series_are_what_windows_leave_out(spark):
    d = packed_rows(spark, [8, 10, 11, 12, 30])
    made = {r.series_id for r in FE.sliding_windows(d, 8.0, 0.5, 1.0, 2.0).collect()}
    short = {r.series_id for r in FE.short_series(d, 8.0, 0.5, 1.0, 2.0).collect()}
    assert made == {3, 4} and short == {0, 1, 2}


def test_measures_without_gravity_are_null(spark):
    m = GR.series_measures(packed_rows(spark, [20], lambda n: np.zeros((3, n))), 30.0).first()
    assert m["forearm_direction"] is None and m["forearm_turning"] is None and m["movement_size_g"] == 0


def test_filter_memory_does_not_follow_the_batch(monkeypatch):
    """Many short channels are transformed some at a time, with the same result."""
    import tracemalloc

    from seriesloom.operators import signal as S

    x = np.random.default_rng(0).normal(size=(16, 9000))
    tracemalloc.start()
    y = S.zero_phase(x, 2, 0.3, 8.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    assert np.array_equal(S.zero_phase(x[:, 4321], 2, 0.3, 8.0), S.zero_phase(x[:, 4321:4322], 2, 0.3, 8.0)[:, 0])
    monkeypatch.setattr(S, "TRANSFORMED", 1 << 30, raising=False)
    assert np.allclose(y, S.zero_phase(x, 2, 0.3, 8.0), rtol=0, atol=1e-12)
