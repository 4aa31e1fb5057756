"""Signal queries: re-timing, resampling, filters, windows, features, augmentation."""

import math

import numpy as np
from pyspark.sql import functions as F

from seriesloom.catalog.audit import piece
from seriesloom.catalog.registry import query, rounded
from seriesloom.catalog.sqlparts import part, using
from seriesloom.functions import arrays as AR
from seriesloom.operators import features as FE
from seriesloom.operators import augment as AU
from seriesloom.operators import gravity as GR
from seriesloom.operators import signal as S
from seriesloom.sources import adapters as AD

GRID_HZ = 1 / 21600  # one grid point per six hours of the event stream
WIN = (1.0, 0.75, AD.FS)

INDEXED = """, ix AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY i) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n,
  first_value(t_ms) OVER (PARTITION BY series_id ORDER BY i) AS t0,
  (last_value(t_ms) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
   - first_value(t_ms) OVER (PARTITION BY series_id ORDER BY i)) / 1000.0::DOUBLE AS dur FROM samples)""".replace("\n", " ")


def windows(spark, d):
    return FE.sliding_windows(AD.signals(spark, d), *WIN)


@query("retime_even", using("samples", INDEXED + "SELECT series_id, idx, x, y, z, idx * dur / (n - 1) AS t_s FROM ix"))
def retime_even(spark, d):
    return S.retime_even(AD.samples(spark, d), ["i"], piece())


@query("resample_linear", using("samples", INDEXED + f""", g AS (SELECT series_id, n, {GRID_HZ} * dur / (n - 1) AS r, unnest(range(0, CAST(floor(dur * {GRID_HZ} + 1e-9) AS BIGINT) + 1)) AS g
    FROM (SELECT DISTINCT series_id, n, dur FROM ix WHERE n >= 16 AND dur > 0)),
  h AS (SELECT *, least(CAST(floor(g / r) AS BIGINT), n - 2) AS j FROM g)
  SELECT h.series_id, g, round(g / {GRID_HZ}, 6) AS t_s, {', '.join(f'round(a.{c} + least(1.0, g / r - j) * (b.{c} - a.{c}), 6) AS {c}' for c in 'xyz')}
  FROM h JOIN ix a ON (a.series_id, a.idx) = (h.series_id, j) JOIN ix b ON (b.series_id, b.idx) = (h.series_id, j + 1)""".replace("\n", " ")))
def resample_linear(spark, d):
    return rounded(S.resample_linear(AD.samples(spark, d), ["i"], piece(), GRID_HZ))


@query("timing_check", using("samples", INDEXED + """, v AS (SELECT *, abs(t_ms - (t0 + idx * dur * 1000 / (n - 1))) AS dev, t_ms = lag(t_ms) OVER w AS st,
    x = lag(x) OVER w AND y = lag(y) OVER w AND z = lag(z) OVER w AS sv FROM ix WINDOW w AS (PARTITION BY series_id ORDER BY i))
  SELECT series_id, round(avg(st::INTEGER), 6) AS frac_same_t, round(avg((st AND sv)::INTEGER), 6) AS frac_same_t_and_v, round(avg(sv::INTEGER), 6) AS frac_same_v,
  round(max(dev), 3) AS dev_ms_max, round(quantile_cont(dev, 0.95), 3) AS dev_ms_p95 FROM v GROUP BY ALL""".replace("\n", " ")))
def timing_check(spark, d):
    t = S.timing_check(AD.samples(spark, d), ["i"], piece())
    return rounded(t.withColumns({c: F.round(c, 3) for c in ("dev_ms_max", "dev_ms_p95")}))


POLES, CUT = 4, 0.2  # cutoff as a share of each series' own rate


def lowpass_sql() -> str:
    """Forward and backward convolution with the filter's response, ends mirrored at a point, started in the steady state."""
    taps = ", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in enumerate(S.impulse_response(POLES, CUT).tolist()))
    m, keep = f"least({3 * (POLES + 1)}, n - 1)", ", ".join("xyz")
    mirrored = ", ".join(f"2 * b.{c} - a.{c} AS {c}" for c in "xyz")
    one_pass = lambda source, place: (
        f"SELECT e.series_id, e.n, e.lo, e.hi, e.idx, {', '.join(f'sum(v * s.{c}) AS {c}' for c in 'xyz')} FROM {source} e CROSS JOIN taps "
        f"JOIN {source} s ON s.series_id = e.series_id AND s.idx = {place} GROUP BY ALL")
    return using("samples", INDEXED + f""", ok AS (SELECT series_id, n, idx, {keep}, -{m} AS lo, n - 1 + {m} AS hi FROM ix WHERE n >= {S.MIN_SAMPLES} AND dur > 0),
      taps(k, v) AS (VALUES {taps}),
      ext AS MATERIALIZED (SELECT series_id, n, lo, hi, idx, {keep} FROM ok
        UNION ALL SELECT a.series_id, a.n, a.lo, a.hi, -a.idx, {mirrored} FROM ok a JOIN ok b USING (series_id) WHERE b.idx = 0 AND a.idx BETWEEN 1 AND -a.lo
        UNION ALL SELECT a.series_id, a.n, a.lo, a.hi, 2 * (a.n - 1) - a.idx, {mirrored} FROM ok a JOIN ok b USING (series_id) WHERE b.idx = b.n - 1 AND a.idx BETWEEN a.n - 1 + a.lo AND a.n - 2),
      fw AS MATERIALIZED ({one_pass('ext', 'greatest(e.idx - k, e.lo)')}), bw AS MATERIALIZED ({one_pass('fw', 'least(e.idx + k, e.hi)')})
      SELECT series_id, idx, {', '.join(f'round({c}, 6) AS {c}' for c in 'xyz')} FROM bw WHERE idx BETWEEN 0 AND n - 1""")


@query("lowpass_zero_phase", lowpass_sql())
def lowpass_zero_phase(spark, d):
    return rounded(S.lowpass_zero_phase(AD.samples(spark, d), ["i"], piece(), poles=POLES, cutoff=F.col("fs") * F.lit(CUT)))


def linear_map(name: str, order: int, cutoff: float) -> None:
    """For signals of one length the filter is a matrix: (i, j, v), output i from input j."""
    m = S.zero_phase(np.eye(16), order, cutoff, AD.FS).tolist()
    cells = ", ".join(f"({i}, {j}, {v!r}::DOUBLE)" for i, row in enumerate(m) for j, v in enumerate(row))
    part(name, (), f"SELECT * FROM (VALUES {cells}) t(i, j, v)")


linear_map("low_map", 4, 2.0)
linear_map("slow_map", GR.GRAVITY_POLES, GR.GRAVITY_HZ)
part("slow", ("points", "slow_map"), """
  SELECT p.series_id, p.c, m.i AS s, sum(m.v * p.v) AS g, max(p.v) FILTER (p.s = m.i) AS v FROM points p JOIN slow_map m ON m.j = p.s WHERE p.c < 3 GROUP BY ALL""")
part("axes", ("slow",), f"""
  SELECT series_id, s, {', '.join(f'max(g) FILTER (c = {c}) AS g{c}, max(v) FILTER (c = {c}) AS v{c}' for c in range(3))} FROM slow GROUP BY ALL""")


def long(df, keys, **columns):
    """A row for each channel and sample of nested arrays."""
    first, *rest = columns
    d = df.select(*keys, *[c.alias(k) for k, c in columns.items()]).select(*keys, *rest, F.posexplode(first).alias("c", "_a"))
    d = d.select(*keys, "c", *[F.get(k, F.col("c")).alias(k) for k in rest], F.posexplode("_a").alias("s", first))
    return d.select(*keys, "c", "s", first, *[F.get(k, F.col("s")).alias(k) for k in rest])


@query("lowpass_packed", using("points low_map", "SELECT series_id, c::INTEGER AS c, i AS s, round(sum(m.v * p.v), 6) AS v FROM points p JOIN low_map m ON m.j = p.s GROUP BY ALL"))
def lowpass_packed(spark, d):
    return rounded(long(GR.lowpass_packed(AD.signals(spark, d), 4, 2.0, AD.FS), ["series_id"], v=F.col("ch")))


@query("split_gravity_motion", using("slow", "SELECT series_id, c::INTEGER AS c, s, round(g, 6) AS gravity, round(v - g, 6) AS motion FROM slow"))
def split_gravity_motion(spark, d):
    """Values of the slow and fast parts."""
    return rounded(long(GR.with_parts(AD.signals(spark, d), AD.FS), ["series_id"], gravity=F.col("gravity"), motion=F.col("motion")))


@query("split_variant", using("axes", "SELECT series_id, 0 AS c, s, round(sqrt(v0 * v0 + v1 * v1 + v2 * v2), 6) AS v, 'magnitude' AS variant FROM axes UNION ALL "
       "SELECT series_id, 3, s, round(sqrt((v0 - g0) ** 2 + (v1 - g1) ** 2 + (v2 - g2) ** 2), 6), 'motion' FROM axes"))
def split_variant(spark, d):
    """The magnitude-only variant, and the magnitude channel of the motion variant."""
    s = AD.signals(spark, d)
    values = {v: long(GR.split_variant(s, v, AD.FS), ["series_id"], v=F.col("ch")).withColumn("variant", F.lit(v)) for v in ("magnitude", "motion")}
    return rounded(values["magnitude"].unionByName(values["motion"].where("c = 3")))


@query("edge_trim", using("points", "SELECT series_id, c, round(sum(v), 6) AS total, count(*) AS n FROM points WHERE s >= 2 AND s < 14 GROUP BY ALL"))
def edge_trim(spark, d):
    s = FE.edge_trim(AD.signals(spark, d), 2).select("series_id", F.posexplode("ch").alias("c", "a"))
    return rounded(s.select("series_id", "c", AR.total(F.col("a")).alias("total"), F.size("a").cast("bigint").alias("n")))


@query("sliding_windows", using("wpoints", """SELECT series_id, subject, cls, w::INTEGER AS w, t0_s, count(DISTINCT i) AS n_samples, round(sum(v), 6) AS total, round(min(v) FILTER (i = 0 AND c = 0), 6) AS first_x
  FROM wpoints GROUP BY ALL"""))
def sliding_windows(spark, d):
    w = windows(spark, d)
    return rounded(w.select("series_id", "subject", "cls", "w", "t0_s", F.size(F.get("ch", F.lit(0))).cast("bigint").alias("n_samples"),
                            AR.total(F.flatten("ch")).alias("total"), F.get(F.get("ch", F.lit(0)), F.lit(0)).alias("first_x")))


@query("short_series", "SELECT doc_id AS series_id, n_words AS n_samples FROM (SELECT doc_id, len(string_split(text, ' ')) AS n_words FROM documents) WHERE n_words < 50")
def short_series(spark, d):
    """Documents as series of word lengths: those with fewer samples than a 50-sample window are reported."""
    from seriesloom.session import table

    t = table(spark, d, "documents").select(F.col("doc_id").alias("series_id"), F.array(
        F.transform(F.split("text", " "), lambda w: F.length(w).cast("double"))).alias("ch"))
    return FE.short_series(t, 50.0, 0.5, 1.0).select("series_id", F.col("n_samples").cast("bigint").alias("n_samples"))


CHAN = "CASE c WHEN 0 THEN 'x' WHEN 1 THEN 'y' WHEN 2 THEN 'z' ELSE 'mag' END AS channel"
STATS_SQL = f"""SELECT series_id, w::INTEGER AS w, {CHAN}, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
  round(max(v) - min(v), 6) AS range, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(sqrt(avg(v * v)), 6) AS rms,
  round(avg(cc ** 3) / avg(cc ** 2) ** 1.5, 6) AS skew, round(avg(cc ** 4) / avg(cc ** 2) ** 2 - 3, 6) AS kurt
  FROM (SELECT *, v - avg(v) OVER (PARTITION BY series_id, w, c) AS cc FROM wpoints) GROUP BY series_id, w, c"""
SHAPE_SQL = f"""SELECT series_id, w::INTEGER AS w, {CHAN}, round(sum(((cc < 0) <> (pc < 0))::INTEGER) / 8.0::DOUBLE, 6) AS zc, round(avg(abs(v - pv)) * 8.0, 6) AS jerk FROM (
  SELECT *, lag(cc) OVER o AS pc, lag(v) OVER o AS pv FROM (SELECT *, v - avg(v) OVER (PARTITION BY series_id, w, c) AS cc FROM wpoints)
  WINDOW o AS (PARTITION BY series_id, w, c ORDER BY i)) GROUP BY series_id, w, c"""
SPEC_SQL = f"""SELECT series_id, w::INTEGER AS w, {CHAN}, round(arg_max(k, p) * 8.0 / 8, 6) AS domf, round(max(p) / greatest(sum(p), 1e-12), 6) AS domp,
  round(-sum(p / t * ln(greatest(p / t, 1e-12))) / ln(4), 6) AS spent FROM (
  SELECT *, greatest(sum(p) OVER (PARTITION BY series_id, w, c), 1e-12) AS t FROM (
    SELECT series_id, w, c, k, sum(cc * cos(2 * pi() * k * i / 8)) ** 2 + sum(cc * sin(2 * pi() * k * i / 8)) ** 2 AS p FROM (
      SELECT *, v - avg(v) OVER (PARTITION BY series_id, w, c) AS cc FROM wpoints), (SELECT unnest(range(1, 5)) AS k) GROUP BY ALL)) GROUP BY series_id, w, c"""
CORR_SQL = """SELECT series_id, w::INTEGER AS w, round(coalesce(corr(x, y), 0), 6) AS corr_xy, round(coalesce(corr(x, z), 0), 6) AS corr_xz, round(coalesce(corr(y, z), 0), 6) AS corr_yz FROM (
  SELECT series_id, w, i, max(v) FILTER (c = 0) AS x, max(v) FILTER (c = 1) AS y, max(v) FILTER (c = 2) AS z FROM wpoints GROUP BY ALL) GROUP BY ALL"""


@query("stats_features", using("wpoints", STATS_SQL))
def stats_features(spark, d):
    return rounded(AR.drop_helpers(AR.stats_features(FE.by_channel(windows(spark, d)))).select("series_id", "w", "channel", *AR.STATS))


@query("shape_features", using("wpoints", SHAPE_SQL))
def shape_features(spark, d):
    return rounded(AR.shape_features(FE.by_channel(windows(spark, d)), AD.FS).select("series_id", "w", "channel", *AR.SHAPE))


@query("spectral_features", using("wpoints", SPEC_SQL))
def spectral_features(spark, d):
    return rounded(FE.spectral_features(windows(spark, d), AD.FS).select("series_id", "w", "channel", *AR.SPECTRUM))


@query("axis_correlations", using("wpoints", CORR_SQL))
def axis_correlations(spark, d):
    return rounded(FE.axis_correlations(windows(spark, d)).select("series_id", "w", "corr_xy", "corr_xz", "corr_yz"))


def _wide(cols, block):
    return ", ".join(f"max({block}.{s}) FILTER ({block}.channel = '{c}') AS {c}_{s}" for c in FE.CHANNELS for s in cols)


@query("window_features", using("wpoints", f""", st AS ({STATS_SQL}), sh AS ({SHAPE_SQL}), sp AS ({SPEC_SQL}), co AS ({CORR_SQL})
  SELECT st.series_id, st.w, {_wide(AR.STATS, 'st')}, {_wide(AR.SHAPE, 'sh')}, {_wide(AR.SPECTRUM, 'sp')},
    max(corr_xy) AS corr_xy, max(corr_xz) AS corr_xz, max(corr_yz) AS corr_yz
  FROM st JOIN sh USING (series_id, w, channel) JOIN sp USING (series_id, w, channel) JOIN co USING (series_id, w) GROUP BY ALL""".replace("\n", " ")))
def window_features(spark, d):
    f = FE.window_features(windows(spark, d), AD.FS)
    return rounded(f.select("series_id", "w", *FE.feature_names()))


@query("series_measures", using("axes", """, u AS (SELECT *, sqrt(g0 * g0 + g1 * g1 + g2 * g2) AS r, sqrt((v0 - g0) ** 2 + (v1 - g1) ** 2 + (v2 - g2) ** 2) / 9.81 AS move FROM axes),
  m AS (SELECT series_id, avg(g0 / r) AS m0, avg(g1 / r) AS m1, avg(g2 / r) AS m2, sqrt(avg(move * move)) AS size, avg(move) AS mm FROM u GROUP BY ALL),
  t AS (SELECT series_id, stddev_pop(degrees(acos(greatest(-1.0, least(1.0, (g0 / r * m0 + g1 / r * m1 + g2 / r * m2) / sqrt(m0 * m0 + m1 * m1 + m2 * m2)))))) AS turning FROM u JOIN m USING (series_id) GROUP BY ALL),
  p AS (SELECT series_id, k, sum((move - mm) * cos(2 * pi() * k * s / 16)) ** 2 + sum((move - mm) * sin(2 * pi() * k * s / 16)) ** 2 AS power FROM u JOIN m USING (series_id), (SELECT unnest(range(1, 7)) AS k) GROUP BY ALL),
  f AS (SELECT series_id, arg_max(k, power) * 0.5 AS rate FROM p GROUP BY ALL)
  SELECT series_id, subject, cls, period_order, round(m0, 6) AS forearm_direction, round(turning, 6) AS forearm_turning, round(rate::DOUBLE, 6) AS rep_speed_hz,
    round(size, 6) AS movement_size_g, round(m1, 6) AS axis_y, round(m2, 6) AS axis_z FROM m JOIN t USING (series_id) JOIN f USING (series_id)
  JOIN (SELECT DISTINCT series_id, subject, cls, period_order FROM points) USING (series_id)""".replace("\n", " ")))
def series_measures(spark, d):
    return rounded(GR.series_measures(AD.signals(spark, d), AD.FS))


def draw_sql(key: str, tag: str) -> str:
    """The draw of ``hashing.draw_unit`` with seed 11."""
    return f"(('0x' || substr(md5('11|' || {key} || '|{tag}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def turn_sql(key: str, low: float, high: float) -> str:
    """Quaternion of the drawn rotation."""
    angle = f"({low!r} + {high - low!r} * {draw_sql(key, 'angle')})"
    height, around = f"(-1 + 2 * {draw_sql(key, 'height')})", f"(2 * pi() * {draw_sql(key, 'around')})"
    return (f"cos({angle} / 2) AS w_, sqrt(1 - {height} ** 2) * sin({angle} / 2) * cos({around}) AS i_, "
            f"sqrt(1 - {height} ** 2) * sin({angle} / 2) * sin({around}) AS j_, {height} * sin({angle} / 2) AS k_")


TURNED = ("(1 - 2 * (j_ * j_ + k_ * k_)) * b0 + 2 * (i_ * j_ - w_ * k_) * b1 + 2 * (i_ * k_ + w_ * j_) * b2",
          "2 * (i_ * j_ + w_ * k_) * b0 + (1 - 2 * (i_ * i_ + k_ * k_)) * b1 + 2 * (j_ * k_ - w_ * i_) * b2",
          "2 * (i_ * k_ - w_ * j_) * b0 + 2 * (j_ * k_ + w_ * i_) * b1 + (1 - 2 * (i_ * i_ + j_ * j_)) * b2")
COPY = "series_id || '|' || copy"
HALF_TURN = math.radians(15.0)


@query("augment_retime_scale", using("axes", f""", d AS (SELECT *, 0.8 + 0.4 * {draw_sql(COPY, 'tempo')} AS tempo, 0.8 + 0.4 * {draw_sql(COPY, 'intensity')} AS k, {turn_sql(COPY, -HALF_TURN, HALF_TURN)}
    FROM (SELECT DISTINCT series_id FROM axes), (SELECT unnest(range(4)) AS copy)),
  e AS (SELECT *, greatest(2, CAST(round_even(16 / tempo, 0) AS INTEGER)) - 1 AS steps FROM d), g AS (SELECT *, unnest(range(steps + 1)) AS s FROM e),
  q AS (SELECT *, s * 15.0::DOUBLE / steps AS pos FROM g),
  b AS (SELECT q.*, {', '.join(f'a.g{c} + k * (a.v{c} - a.g{c}) + (pos - floor(pos)) * (z.g{c} + k * (z.v{c} - z.g{c}) - a.g{c} - k * (a.v{c} - a.g{c})) AS b{c}' for c in range(3))}
    FROM q JOIN axes a ON a.series_id = q.series_id AND a.s = floor(pos) JOIN axes z ON z.series_id = q.series_id AND z.s = least(15, floor(pos) + 1))
  SELECT series_id || '#sim' || copy AS sim_id, s::INTEGER AS s, {', '.join(f'round({TURNED[c]}, 6) AS {n}' for c, n in enumerate('xyz'))},
    round(sqrt(b0 * b0 + b1 * b1 + b2 * b2), 6) AS mag FROM b""".replace("\n", " ")))
def augment_retime_scale(spark, d):
    a = AU.augment_retime_scale(AD.signals(spark, d), 4, 11, AD.FS, max_degrees=15.0)
    return samples_of(a, ["sim_id"])


def samples_of(df, keys):
    """A row for each sample of a packed signal, a column for each channel."""
    each = df.select(*keys, F.posexplode(F.arrays_zip(*[F.get("ch", F.lit(c)).alias(n) for c, n in enumerate(("x", "y", "z", "mag"))])).alias("s", "_v"))
    return rounded(each.select(*keys, "s", "_v.x", "_v.y", "_v.z", "_v.mag"))


WCOPY = "series_id || '|0|' || copy"


def permuted_sql() -> str:
    pace = lambda c, k: (f"exp(0.2 * sqrt(-2 * ln(1 - {draw_sql(WCOPY, f'pace{k} axis {c}')})) * cos(2 * pi() * {draw_sql(WCOPY, f'phase{k} axis {c}')}))")
    marks = ", ".join(f"list_concat([0.0::DOUBLE], [{', '.join(' + '.join(pace(c, j) for j in range(k + 1)) for k in range(5))}]) AS marks{c}" for c in range(3))
    cuts = ", ".join(f"CAST(floor({draw_sql(WCOPY, f'cut{k}')} * 5) AS INTEGER)" for k in range(3))
    turns = " UNION ALL ".join(f"SELECT series_id, copy, {k} AS k, {draw_sql(WCOPY, f'turn{k}')} AS u FROM c" for k in range(4))
    place = lambda c: (f"CASE WHEN s = 15 THEN 15.0::DOUBLE ELSE (marks{c}[floor(s / 3.0)::INTEGER + 1] + (s / 3.0::DOUBLE - floor(s / 3.0)) * "  # noqa: E731
                       f"(marks{c}[floor(s / 3.0)::INTEGER + 2] - marks{c}[floor(s / 3.0)::INTEGER + 1])) / marks{c}[6] * 15 END AS at{c}")
    joins = " ".join(f"JOIN axes a{c} ON a{c}.series_id = q.series_id AND a{c}.s = floor(at{c}) JOIN axes z{c} ON z{c}.series_id = q.series_id AND z{c}.s = least(15, floor(at{c}) + 1)" for c in range(3))
    warped = ", ".join(f"a{c}.v{c} + (at{c} - floor(at{c})) * (z{c}.v{c} - a{c}.v{c}) AS b{c}" for c in range(3))
    return using("axes", f""", c AS (SELECT * FROM (SELECT DISTINCT series_id FROM axes), (SELECT unnest(range(2)) AS copy)),
      d AS (SELECT series_id, copy, {marks}, list_sort([{cuts}]) AS cuts, {turn_sql(WCOPY, -math.pi, math.pi)} FROM c),
      q AS (SELECT *, {', '.join(place(c) for c in range(3))} FROM (SELECT *, unnest(range(16)) AS s FROM d)),
      b AS (SELECT q.*, {warped} FROM q {joins}),
      o AS (SELECT *, row_number() OVER (PARTITION BY series_id, copy ORDER BY u, k) AS rank FROM ({turns})),
      r AS (SELECT o.*, CASE k WHEN 0 THEN 0 ELSE cuts[k] + 3 * k END AS lo, CASE k WHEN 3 THEN 16 ELSE cuts[k + 1] + 3 * (k + 1) END AS hi FROM o JOIN d USING (series_id, copy)),
      t AS (SELECT *, coalesce(sum(hi - lo) OVER (PARTITION BY series_id, copy ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM r)
      SELECT b.series_id, 0 AS w, b.copy::INTEGER AS copy, CAST(t.at + b.s - t.lo AS INTEGER) AS s, {', '.join(f'round({TURNED[c]}, 6) AS {n}' for c, n in enumerate('xyz'))},
        round(sqrt(b0 * b0 + b1 * b1 + b2 * b2), 6) AS mag FROM b JOIN t ON t.series_id = b.series_id AND t.copy = b.copy AND b.s >= t.lo AND b.s < t.hi""".replace("\n", " "))


@query("augment_permute_rotate", permuted_sql())
def augment_permute_rotate(spark, d):
    w = FE.sliding_windows(AD.signals(spark, d), 2.0, 0.5, AD.FS)
    return samples_of(AU.augment_permute_rotate(w, 2, 11, min_piece=2), ["series_id", "w", "copy"])


@query("window_duplicates", using("wpoints", """SELECT CAST(count(*) FILTER (copies > 1) AS BIGINT) AS repeated_windows, count(*) AS distinct_windows FROM (
  SELECT h, count(*) AS copies FROM (SELECT series_id, w, md5(string_agg(CAST(CAST(round(v * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY c, i)) AS h FROM wpoints GROUP BY ALL) GROUP BY ALL)"""))
def window_duplicates(spark, d):
    h = windows(spark, d).select(F.md5(F.array_join(F.transform(F.flatten("ch"), lambda v: F.round(v * 10000).cast("bigint").cast("string")), ",")).alias("h"))
    g = h.groupBy("h").agg(F.count(F.lit(1)).alias("copies"))
    return g.agg(F.count(F.when(F.col("copies") > 1, 1)).alias("repeated_windows"), F.count(F.lit(1)).alias("distinct_windows"))
