"""Streaming queries, run over everything available and compared with their batch counterparts."""

from pyspark.sql import functions as F

from seriesloom.catalog.registry import query, rounded
from seriesloom.catalog.scoring import grid_models
from seriesloom.catalog.sqlparts import part, using
from seriesloom.operators import learn as L
from seriesloom.plans import cohort as P
from seriesloom.plans import experiment as X
from seriesloom.session import bounded_broadcast
from seriesloom.sources import adapters as AD
from seriesloom.streaming import running as R

D = P.Design()


@query("stream_windows", """WITH e AS (SELECT event_type AS subject, value AS x, ts, (epoch_us(ts) // 3600000000) * 3600 AS h FROM events),
  w AS (SELECT subject, x, to_timestamp(h - o * 3600) AT TIME ZONE 'UTC' AS start FROM e, (SELECT unnest([0, 1]) AS o))
  SELECT subject, start, start + INTERVAL 2 HOUR AS "end", count(*) AS n_samples, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max,
    round(sqrt(avg(x * x)), 6) AS rms FROM w GROUP BY ALL HAVING start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_windows(spark, d):
    """Two-hour windows every hour; windows that the watermark has closed are emitted."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    s = R.stream_table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("subject"), F.col("value").alias("x"))
    out = R.drain(spark, R.windowed_features(s, "2 hours", "1 hour", "10 minutes"), "stream-windows")
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}))


def streamed_calls(spark, d):
    """Vector stream -> windows -> probabilities of the static models -> stateful running calls."""
    r = X.saved_roles(spark, d, D)
    r = r.withColumn("_cells", F.filter(P.cells(D), lambda c: (F.col("role") == "new") | (c["n_team"] >= F.col("rank"))))
    r = r.select("repeat", "subject", F.when(F.col("role") == "new", "new").otherwise("recorded").alias("role"), "_cells")
    s = AD.packed(R.stream_table(spark, d, "embeddings")).where("period_order > 1")
    s = s.withColumn("recorded", F.timestamp_seconds("series_id"))  # a second for each id stands in for the time of the recording
    w = X.windows_of(s.join(bounded_broadcast(r, D.max_roles), "subject"))
    w = w.select("*", F.explode("_cells").alias("_c")).select("*", "_c.n_team", "_c.k").drop("_c", "_cells")
    w = w.withColumn("time", F.timestamp_micros((F.unix_micros("recorded") + (F.col("t0_s") + X.WINDOW_S) * 1_000_000).cast("bigint"))).drop("recorded")
    p = L.profile_proba(w, grid_models(spark, d), X.COND, D.n_classes, D.max_conditions)
    return R.running_calls(p.withColumnRenamed("cls", "truth"), [*X.COND, "role"], D.n_classes, X.WINDOW_S, time_col="time", delay="1 day")


def saved_stream(spark, d):
    from seriesloom.session import materialize

    return materialize(lambda: R.drain(spark, streamed_calls(spark, d), "stream-calls"), spark, ("streamed", d, str(D)))


@query("stream_running_vote", using("running", "SELECT repeat::INTEGER AS repeat, n_team, k, role, series_id, subject, truth, w::INTEGER AS w, end_s::DOUBLE AS end_s, call FROM running"))
def stream_running_vote(spark, d):
    return saved_stream(spark, d).where("NOT late").drop("last_change_s", "late")


part("finals", ("running",), "SELECT *, last_value(call) OVER (PARTITION BY repeat, n_team, k, series_id ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM running")


@query("stream_time_to_stable", using("finals", """, x AS (SELECT repeat, n_team, k, series_id, final, max(w) FILTER (call <> final) AS lw FROM finals GROUP BY ALL)
  SELECT x.repeat::INTEGER AS repeat, x.n_team, x.k, x.series_id, x.final AS call, min(end_s)::DOUBLE AS stable_s FROM x JOIN finals f ON (f.repeat, f.n_team, f.k, f.series_id) = (x.repeat, x.n_team, x.k, x.series_id)
    AND (lw IS NULL OR f.w > lw) GROUP BY ALL""".replace("\n", " ")))
def stream_time_to_stable(spark, d):
    """Since when the call at the end of each series has not changed."""
    return saved_stream(spark, d).where("NOT late").groupBy(*X.COND, "series_id").agg(F.max_by("call", "w").alias("call"), F.max_by("last_change_s", "w").alias("stable_s"))
