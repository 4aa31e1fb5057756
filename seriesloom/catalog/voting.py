"""Vote queries: series votes, running calls, as-of lookups, stability."""

from pyspark.sql import functions as F

from seriesloom.catalog.registry import query, r6, rounded
from seriesloom.catalog.sqlparts import bootstrap_sql, part, scores_sql, using
from seriesloom.functions.ordering import null_safe_join
from seriesloom.operators import joins as J
from seriesloom.operators import scores as S
from seriesloom.operators import selection as SEL
from seriesloom.operators import stats as ST
from seriesloom.operators import votes as V
from seriesloom.plans import cohort as P
from seriesloom.plans import experiment as X

D = P.Design()
B = 200  # bootstrap replicates
COND = X.COND
COND_SQL = "repeat::INTEGER AS repeat, n_team, k"
TIMES = [1.0, 1.3, 1.5, 1.9]

part("running", ("wtop",), """
  SELECT repeat, n_team, k, role, series_id, subject, cls AS truth, w, w * 0.25 + 1.0 AS end_s, c AS call FROM (
    SELECT *, row_number() OVER (PARTITION BY repeat, n_team, k, series_id, w ORDER BY run DESC, c) AS rn FROM (
      SELECT *, sum(top + 0.001 * p) OVER (PARTITION BY repeat, n_team, k, series_id, c ORDER BY w) AS run FROM wtop)) WHERE rn = 1""")
part("ascalls", ("running",), """
  SELECT r.repeat, n_team, k, role, series_id, subject, truth, t AS t_s,
         coalesce(arg_max(call, end_s) FILTER (t IS NULL OR end_s <= t), arg_min(call, end_s)) AS call, max(end_s) AS set_duration_s
  FROM running r, (SELECT unnest([1.0, 1.3, 1.5, 1.9, NULL])::DOUBLE AS t) GROUP BY ALL""")
part("lastwrong", ("running",), """
  SELECT repeat, n_team, k, role, series_id, subject, truth, max(w) FILTER (call <> truth) AS lw, max(end_s) AS set_duration_s FROM running GROUP BY ALL""")
part("stable", ("lastwrong",), """
  SELECT l.repeat, l.n_team, l.k, l.role, l.series_id, l.subject, l.truth, l.set_duration_s::DOUBLE AS set_duration_s, min(r.end_s)::DOUBLE AS stable_s
  FROM lastwrong l LEFT JOIN running r ON (r.repeat, r.n_team, r.k, r.series_id) = (l.repeat, l.n_team, l.k, l.series_id) AND (l.lw IS NULL OR r.w > l.lw) GROUP BY ALL""")


def running(spark, d):
    return V.running_vote(X.saved_proba(spark, d), [*COND, "role"], D.n_classes, X.WINDOW_S)


@query("vote_series", using("preds", f"SELECT {COND_SQL}, role, series_id, subject, truth, pred, n_windows FROM preds"))
def vote_series(spark, d):
    return V.vote_series(X.saved_proba(spark, d), [*COND, "role"], D.n_classes)


@query("mean_proba_call", using("wproba", f"""SELECT {COND_SQL}, role, series_id, subject, truth, pred, round(conf, 6) AS conf FROM (
  SELECT repeat, n_team, k, role, series_id, subject, cls AS truth, c AS pred, p AS conf, row_number() OVER (PARTITION BY repeat, n_team, k, series_id ORDER BY p DESC, c) AS rn FROM (
    SELECT repeat, n_team, k, role, series_id, subject, cls, c, avg(p) AS p FROM wproba GROUP BY ALL)) WHERE rn = 1"""))
def mean_proba_call(spark, d):
    return rounded(V.mean_proba_call(X.saved_proba(spark, d), [*COND, "role"], D.n_classes))


part("calls", ("wproba",), """
  SELECT repeat, n_team, k, role, series_id, subject, cls AS truth, c AS pred, p AS conf FROM (
    SELECT *, row_number() OVER (PARTITION BY repeat, n_team, k, series_id ORDER BY p DESC, c) AS rn FROM (
      SELECT repeat, n_team, k, role, series_id, subject, cls, c, avg(p) AS p FROM wproba GROUP BY ALL)) WHERE rn = 1""")


@query("top_fraction_per_class", using("calls", f"""SELECT {COND_SQL}, series_id, pred FROM (
  SELECT *, row_number() OVER (PARTITION BY repeat, n_team, k, pred ORDER BY conf DESC, series_id) AS r, count(*) OVER (PARTITION BY repeat, n_team, k, pred) AS n FROM calls)
  WHERE r <= ceil(0.5 * n)"""))
def top_fraction_per_class(spark, d):
    calls = V.mean_proba_call(X.saved_proba(spark, d), COND, D.n_classes)
    return SEL.top_fraction_per_class(calls, COND, 0.5).select(*COND, "series_id", "pred")


@query("running_vote", using("running", f"SELECT {COND_SQL}, role, series_id, subject, truth, w::INTEGER AS w, end_s::DOUBLE AS end_s, call FROM running"))
def running_vote(spark, d):
    return running(spark, d)


@query("running_end_equals_vote", using("preds", """SELECT count(*) AS matched, 0::BIGINT AS only_left, 0::BIGINT AS only_right, 0::INTEGER AS max_abs_diff, TRUE AS agrees FROM preds"""))
def running_end_equals_vote(spark, d):
    """Reproducibility gate: the running call at the end of a series is the series vote."""
    end = V.asof_calls(running(spark, d), [*COND, "role"], TIMES).where("t_s is null")
    return J.reconcile(
        end.withColumnRenamed("call", "v"), X.saved_predictions(spark, d).withColumnRenamed("pred", "v"), [*COND, "series_id"], "v")


@query("asof_call", using("ascalls", f"SELECT {COND_SQL}, role, series_id, subject, truth, t_s, call, set_duration_s::DOUBLE AS set_duration_s FROM ascalls"))
def asof_call(spark, d):
    return V.asof_calls(running(spark, d), [*COND, "role"], TIMES)


part("times", ("running",), """SELECT DISTINCT repeat, n_team, k, role, series_id, unnest([0.5, 1.0 + (series_id % 4) * 0.25, round(1.0 + (series_id % 7) * 0.2, 6), NULL])::DOUBLE AS t_s FROM running""")


@query("asof_join", using("times", f"""SELECT t.repeat::INTEGER AS repeat, t.n_team, t.k, t.role, t.series_id, t.t_s,
  coalesce(arg_max(call, end_s) FILTER (t_s IS NULL OR end_s <= t_s), arg_min(call, end_s)) AS call
  FROM times t JOIN running r USING (repeat, n_team, k, role, series_id) GROUP BY ALL""".replace("\n", " ")))
def asof_join(spark, d):
    """Calls at times that stand in a table: each series has its own."""
    r = running(spark, d)
    s = F.col("series_id")
    own = F.array(F.lit(0.5), 1.0 + (s % 4) * 0.25, F.round(1.0 + (s % 7) * 0.2, 6), F.lit(None).cast("double"))
    times = r.select(*COND, "role", "series_id").distinct().select("*", F.explode(F.array_distinct(own)).alias("t_s"))
    return V.asof_join(r, times, [*COND, "role"], piece_s=0.6)


@query("stable_since", using("stable", f"SELECT {COND_SQL}, role, series_id, subject, truth, set_duration_s, stable_s FROM stable"))
def stable_since(spark, d):
    return V.stable_since(running(spark, d), [*COND, "role"])


@query("stable_summary", using("stable", """SELECT n_team, k, round(avg((stable_s IS NOT NULL)::INTEGER), 6) AS share_ever_stable, round(quantile_cont(stable_s, 0.5), 6) AS median_stable_s,
  round(quantile_cont(stable_s * (2 + series_id % 9) / set_duration_s, 0.5), 6) AS median_stable_reps, round(quantile_cont(set_duration_s, 0.5), 6) AS median_set_s FROM stable GROUP BY ALL"""))
def stable_summary(spark, d):
    """Share of series that become right for good, and the medians over those only, in seconds and repetitions."""
    from seriesloom.functions.ordering import quantiles

    from seriesloom.session import materialize

    s = materialize(lambda: V.stable_since(running(spark, d), [*COND, "role"]), spark, ("stable", d, str(D)))
    # repetitions per series stand in as 2..10 by id
    s = s.withColumn("reps", F.col("stable_s") * (2 + F.col("series_id") % 9) / F.col("set_duration_s"))
    g = ["n_team", "k"]
    out = s.groupBy(*g).agg(F.avg(F.col("stable_s").isNotNull().cast("int")).alias("share_ever_stable"))
    med = quantiles(s, g, {"median_stable_s": ("stable_s", 0.5), "median_stable_reps": ("reps", 0.5), "median_set_s": ("set_duration_s", 0.5)})
    return rounded(out.join(med, g))


part("timed", ("ascalls",), scores_sql("ascalls", "repeat, n_team, k, role, subject, t_s", pred="call"))
part("timedath", ("timed",), "SELECT n_team, k, role, t_s, subject, avg(accuracy) AS accuracy, avg(macro_f1) AS macro_f1, count(*) AS n_rows FROM timed GROUP BY ALL")
BY_TIME = "n_team, k, role, t_s"


@query("accuracy_by_time", using("timedath", f"""SELECT m.*, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi FROM (
    SELECT {BY_TIME}, CAST(sum(n_rows) AS BIGINT) AS n_subject_repeats, count(*) AS n_subjects, round(avg(accuracy), 6) AS accuracy, round(avg(macro_f1), 6) AS macro_f1 FROM timedath GROUP BY ALL) m
  JOIN ({bootstrap_sql("timedath", BY_TIME, "subject", "accuracy", B)}) c ON {" AND ".join(f"m.{k} IS NOT DISTINCT FROM c.{k}" for k in BY_TIME.split(", "))}"""))
def accuracy_by_time(spark, d):
    """Per time and role: subjects are averaged over their repeats first, then across subjects, with an interval."""
    g = ["n_team", "k", "role", "t_s"]
    a = V.asof_calls(running(spark, d), [*COND, "role"], TIMES).withColumnRenamed("call", "pred")
    s = S.subject_scores(a, [*COND, "role", "subject", "t_s"], D.n_classes)
    u = s.groupBy(*g, "subject").agg(F.avg("accuracy").alias("accuracy"), F.avg("macro_f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_rows"))
    m = u.groupBy(*g).agg(F.sum("n_rows").alias("n_subject_repeats"), F.count(F.lit(1)).alias("n_subjects"), F.avg("macro_f1").alias("macro_f1"))
    ci = ST.bootstrap_ci(u, g, "subject", "accuracy", B).withColumnRenamed("mean", "accuracy").drop("n")
    return rounded(null_safe_join(m, ci, g))


@query("still_running_share", """SELECT event_type AS cls, t::INTEGER AS t_s, round(avg((value > t)::INTEGER), 6) AS share FROM events, (SELECT unnest([2, 5, 10, 30, 60, 120]) AS t) GROUP BY ALL""")
def still_running_share(spark, d):
    from seriesloom.sources import adapters as AD

    # the times are parameters: one conditional average each, in a single pass
    times = [2, 5, 10, 30, 60, 120]
    g = AD.event_rows(spark, d).groupBy("cls").agg(F.array(*[
        F.struct(F.lit(t).alias("t_s"), F.avg((F.col("duration_s") > t).cast("int")).alias("share")) for t in times]).alias("s"))
    return g.select("cls", F.explode("s").alias("s")).select("cls", "s.t_s", r6("s.share").alias("share"))
