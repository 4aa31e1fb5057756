"""Statistics queries: bootstrap, paired tests, curves, regressions, variance shares."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.catalog.registry import query, r6, rounded
from seriesloom.catalog.scoring import FAM, battery_rows, extra_scores, period_rows
from seriesloom.catalog.sqlparts import bootstrap_sql, paired_sql, part, rank_test_sql, scores_sql, using
from seriesloom.functions import vocabulary as V
from seriesloom.functions.ordering import mid_ranks
from seriesloom.operators import joins as J
from seriesloom.operators import scores as S
from seriesloom.operators import stats as ST
from seriesloom.plans import cohort as P
from seriesloom.plans import experiment as X
from seriesloom.plans import variants as VA
from seriesloom.session import table
from seriesloom.sources import adapters as AD

D = P.Design()
B = 100  # replicates where the SQL twin draws every one of them by a join
B_WHOLE = 2000  # of the whole-table form
PAIRED = ["diff", "ci_lo", "ci_hi", "n", "n_positive", "mean_a", "mean_b", "n_used", "w_plus", "w_minus", "w", "z", "p_normal"]


def paired(a, b, keys, value="macro_f1", **kw):
    out = ST.paired_compare(a, b, keys, value, B, exact=False, **kw)
    return rounded(out.select(*keys, *PAIRED[:7], F.col("n_used").cast("bigint").alias("n_used"), *PAIRED[8:]))


def subject_f1(spark, d):
    """Macro-F1 per condition and subject, averaged over repeats."""
    return ST.subject_means(X.grid_scores(spark, d), ["n_team", "k", "role"], "macro_f1")


# --- whole-table forms: customers as subjects -------------------------------------------------------

part("spend", (), "SELECT o_custkey AS subject, avg(o_totalprice) AS price, count(*) AS n_rows FROM orders GROUP BY ALL")
part("sides", (), """
  SELECT c_mktsegment, c_nationkey, o_custkey AS subject, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS va, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS vb
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
part("sided", ("sides",), "SELECT *, va - vb AS d FROM sides WHERE va - vb IS NOT NULL")


def spend(spark, d):
    return AD.order_bouts(spark, d).groupBy("subject").agg(F.avg("duration_s").alias("price"))


def sides(spark, d):
    """Mean price per customer in two order states, with segment and nation."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), "c_mktsegment", "c_nationkey")
    side = lambda s: F.avg(F.when(F.col("status") == s, F.col("duration_s")))
    o = AD.order_bouts(spark, d).groupBy("subject").agg(side("F").alias("va"), side("O").alias("vb"))
    return o.join(c, "subject")


@query("bootstrap_ci", using("spend", f"SELECT round(m, 4) AS mean, round(ci_lo, 4) AS ci_lo, round(ci_hi, 4) AS ci_hi, n FROM (SELECT avg(price) AS m, count(*) AS n FROM spend), ({bootstrap_sql('spend', '', 'subject', 'price', B)})"))
def bootstrap_ci(spark, d):
    ci = ST.bootstrap_ci(spend(spark, d), [], "subject", "price", B)
    return ci.select(*[F.round(c, 4).alias(c) for c in ("mean", "ci_lo", "ci_hi")], "n")


def _poisson_sql() -> str:
    import math

    cum = [sum(math.exp(-1.0) / math.factorial(i) for i in range(n + 1)) for n in range(9)]
    w = " + ".join(f"(u >= {c!r}::DOUBLE)::INTEGER" for c in cum)
    return f"""SELECT round(any_value(mean), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS ci_lo, round(quantile_cont(m, 0.975), 4) AS ci_hi, any_value(n) AS n FROM (
      SELECT rep, sum(w * price) / nullif(sum(w), 0) AS m FROM (SELECT rep, price, {w} AS w FROM (
        SELECT rep, price, ('0x' || substr(md5('0|' || rep || '|' || subject), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM spend, (SELECT unnest(range(1, {B_WHOLE + 1})) AS rep))) GROUP BY ALL),
      (SELECT avg(price) AS mean, count(*) AS n FROM spend)"""


@query("bootstrap_poisson", using("spend", _poisson_sql()))
def bootstrap_poisson(spark, d):
    """All replicates over the whole table: sums travel, not replicates of rows."""
    ci = ST.bootstrap_ci(spend(spark, d), [], "subject", "price", B_WHOLE, method="poisson")
    return ci.select(*[F.round(c, 4).alias(c) for c in ("mean", "ci_lo", "ci_hi")], "n")


@query("paired_compare", using("sided", paired_sql("sided", "c_mktsegment", B)))
def paired_compare(spark, d):
    s = sides(spark, d)
    return paired(s.select("c_mktsegment", "subject", F.col("va").alias("price")), s.select("c_mktsegment", "subject", F.col("vb").alias("price")),
                  ["c_mktsegment"], "price")


@query("signed_rank", using("sided", f"SELECT c_nationkey, n_used, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round(w, 6) AS w, round(z, 6) AS z, round(p_normal, 6) AS p_normal FROM ({rank_test_sql('sided', 'c_nationkey')})"))
def signed_rank(spark, d):
    s = sides(spark, d).withColumn("d", F.col("va") - F.col("vb")).where("d is not null")
    r = ST.signed_rank(s, ["c_nationkey"], exact=False)
    return rounded(r.select("c_nationkey", F.coalesce("n_used", F.lit(0)).cast("bigint").alias("n_used"),
                            *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("w_plus", "w_minus", "w")], "z", "p_normal"))


part("kd", ("ath",), "SELECT a.n_team, a.role, subject, a.macro_f1 AS va, b.macro_f1 AS vb, a.macro_f1 - b.macro_f1 AS d FROM (SELECT * FROM ath WHERE k = 2) a JOIN (SELECT * FROM ath WHERE k = 1) b USING (n_team, role, subject)")


@query("signed_rank_exact", using("kd", f""", t AS ({rank_test_sql('kd', 'n_team, role')}),
  e AS (SELECT n_team, role, count(*) FILTER (s <= w) * 2.0 / count(*) AS p FROM (
    SELECT t.n_team, t.role, t.w, list_sum(list_transform(range(0, t.n_used), lambda i: CASE WHEN (b >> i) % 2 = 1 THEN i + 1 ELSE 0 END)) AS s
    FROM t, LATERAL (SELECT unnest(range(0, CAST(power(2, t.n_used) AS BIGINT))) AS b)) GROUP BY ALL),
  z AS (SELECT n_team, role, count(*) FILTER (round(d, 12) = 0) AS zeros FROM kd GROUP BY ALL)
  SELECT n_team, role, n_used, round(w, 6) AS w, CASE WHEN ties = 0 AND zeros = 0 THEN 'exact' ELSE 'normal' END AS method,
    round(CASE WHEN ties = 0 AND zeros = 0 THEN least(1.0, p) ELSE p_normal END, 6)::DOUBLE AS p FROM t JOIN e USING (n_team, role) JOIN z USING (n_team, role)""".replace("\n", " ")))
def signed_rank_exact(spark, d):
    a = subject_f1(spark, d)
    out = ST.paired_compare(a.where("k = 2").drop("k"), a.where("k = 1").drop("k"), ["n_team", "role"], "macro_f1", B)
    return rounded(out.select("n_team", "role", F.col("n_used").cast("bigint").alias("n_used"), "w", "method", "p"))


@query("depth_effect", using("kd", """, kn AS (SELECT * FROM kd WHERE role = 'new') """ + paired_sql("kn", "n_team", B)))
def depth_effect(spark, d):
    a = subject_f1(spark, d).where("role = 'new'")
    return paired(a.where("k = 2"), a.where("k = 1"), ["n_team"])


part("eq", ("ath",), """SELECT 2 * b.n_team AS budget, subject, a.macro_f1 AS va, b.macro_f1 AS vb, a.macro_f1 - b.macro_f1 AS d
  FROM (SELECT * FROM ath WHERE role = 'new' AND k = 1) a JOIN (SELECT * FROM ath WHERE role = 'new' AND k = 2) b ON a.subject = b.subject AND a.n_team = 2 * b.n_team""".replace("budget, subject", "budget, a.subject"))


@query("equal_budget", using("eq", paired_sql("eq", "budget", B)))
def equal_budget(spark, d):
    """2N subjects x 1 set against N subjects x 2 sets."""
    a = subject_f1(spark, d).where("role = 'new'")
    broad = a.where("k = 1").withColumn("budget", F.col("n_team"))
    deep = a.where("k = 2").withColumn("budget", 2 * F.col("n_team"))
    return paired(broad, deep, ["budget"])


part("rg", ("ath",), """SELECT a.n_team, a.k, subject, a.macro_f1 AS va, b.macro_f1 AS vb, a.macro_f1 - b.macro_f1 AS d
  FROM (SELECT * FROM ath WHERE role = 'recorded') a JOIN (SELECT * FROM ath WHERE role = 'new') b USING (n_team, k, subject)""")


@query("role_gap", using("rg", paired_sql("rg", "n_team, k", B)))
def role_gap(spark, d):
    a = subject_f1(spark, d)
    return paired(a.where("role = 'recorded'"), a.where("role = 'new'"), ["n_team", "k"])


part("spreds", ("sdist",), "SELECT repeat, n_team, k, role, series_id, subject, cls AS truth, arg_min(c, (d, c)) AS pred FROM sdist GROUP BY ALL")
part("sscores", ("spreds",), scores_sql("spreds", "repeat, n_team, k, role, subject"))
part("sath", ("sscores",), "SELECT n_team, k, role, subject, avg(macro_f1) AS macro_f1 FROM sscores GROUP BY ALL")
part("mc", ("ath", "sath"), "SELECT n_team, k, role, subject, a.macro_f1 AS va, b.macro_f1 AS vb, a.macro_f1 - b.macro_f1 AS d FROM ath a JOIN sath b USING (n_team, k, role, subject)")


def set_level_predictions(spark, d):
    """Second model: the profile learner on whole-set measures, saved once."""
    from seriesloom.catalog.scoring import nearest_profile
    from seriesloom.session import materialize

    return materialize(lambda: nearest_profile(spark, d), spark, ("setlevel", d, str(D)))


@query("model_compare", using("mc", paired_sql("mc", "n_team, k, role", B)))
def model_compare(spark, d):
    a = subject_f1(spark, d)
    b = S.subject_scores(set_level_predictions(spark, d), [*X.COND, "role", "subject"], D.n_classes)
    return paired(a, ST.subject_means(b, ["n_team", "k", "role"], "macro_f1"), ["n_team", "k", "role"])


part("gains", ("ath",), """SELECT k, prev_n AS from_n, n_team AS to_n, subject, macro_f1 AS va, prev AS vb, macro_f1 - prev AS d FROM (
  SELECT *, lag(macro_f1) OVER w AS prev, lag(n_team) OVER w AS prev_n FROM ath WHERE role = 'new' WINDOW w AS (PARTITION BY k, subject ORDER BY n_team)) WHERE prev IS NOT NULL""")


@query("marginal_gain", using("gains", "SELECT *, round(diff / (to_n - from_n), 6) AS gain_per_subject FROM (" + paired_sql("gains", "k, from_n, to_n", B) + ")"))
def marginal_gain(spark, d):
    """Gain between neighbouring grid points per subject; a subject's curve has one row per grid point."""
    w = Window.partitionBy("k", "subject").orderBy("n_team")
    a = subject_f1(spark, d).where("role = 'new'").withColumns({"_b": F.lag("macro_f1").over(w), "from_n": F.lag("n_team").over(w)})
    rows = a.where("_b is not null").select("k", "from_n", F.col("n_team").alias("to_n"), "subject", F.col("macro_f1").alias("_a"), "_b",
                                            (F.col("macro_f1") - F.col("_b")).alias("d"))
    out = ST.paired_differences(rows, ["k", "from_n", "to_n"], B, exact=False)
    out = out.withColumn("gain_per_subject", F.round("diff", 6) / (F.col("to_n") - F.col("from_n")))
    return rounded(out.select("k", "from_n", "to_n", *PAIRED[:7], F.col("n_used").cast("bigint").alias("n_used"), *PAIRED[8:], "gain_per_subject"))


@query("reconcile", using("preds spreds", """SELECT count(*) AS matched, 0::BIGINT AS only_left, 0::BIGINT AS only_right, max(abs(a.pred - b.pred))::INTEGER AS max_abs_diff,
  max(abs(a.pred - b.pred)) < 1e-9 AS agrees FROM preds a JOIN spreds b USING (repeat, n_team, k, series_id)"""))
def reconcile(spark, d):
    """Window vote against the set-level calls: same keys, how far apart the calls are."""
    return J.reconcile(X.saved_predictions(spark, d), set_level_predictions(spark, d), [*X.COND, "series_id"], "pred")


@query("budget_minutes_score", using("train scores", """SELECT t.repeat::INTEGER AS repeat, t.n_team, t.k, round(t.minutes, 6) AS minutes, round(f1, 6) AS f1 FROM (
  SELECT repeat, n_team, k, count(*) * 16 / 8.0::DOUBLE / 60 AS minutes FROM train GROUP BY ALL) t JOIN (
  SELECT repeat, n_team, k, avg(macro_f1) AS f1 FROM scores WHERE role = 'new' GROUP BY ALL) s USING (repeat, n_team, k)"""))
def budget_minutes_score(spark, d):
    """Minutes of training signal per repeat and condition, beside the mean score of the new subjects."""
    bouts = AD.vector_bouts(spark, d)
    train = P.train_sets(P.nested_set_order(bouts, X.saved_roles(spark, d, D), D), D)
    m = train.groupBy(*X.COND).agg((F.count(F.lit(1)) * 16 / F.lit(AD.FS) / 60).alias("minutes"))
    s = X.grid_scores(spark, d).where("role = 'new'").groupBy(*X.COND).agg(F.avg("macro_f1").alias("f1"))
    return rounded(m.join(s, X.COND))


# --- curves ----------------------------------------------------------------------------------------

part("curve", ("ath",), "SELECT k, role, n_team, avg(macro_f1) AS y FROM ath GROUP BY ALL")


def threshold_sql(curve: str, keys: str, frac: str = "0.9") -> str:
    return f"""SELECT {keys}, arg_min(xat, i) FILTER (i >= 2 AND f >= {frac}) AS n_needed FROM (
      SELECT *, CASE WHEN f > fp THEN xp + ({frac} - fp) * (n_team - xp) / (f - fp) ELSE n_team::DOUBLE END AS xat FROM (
        SELECT *, lag(f) OVER w AS fp, lag(n_team) OVER w AS xp, row_number() OVER w AS i FROM (
          SELECT *, (y - y0) / CASE WHEN y1 > y0 THEN y1 - y0 END AS f FROM (
            SELECT *, first_value(y) OVER u AS y0, last_value(y) OVER u AS y1 FROM {curve}
            WINDOW u AS (PARTITION BY {keys} ORDER BY n_team ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))
        WINDOW w AS (PARTITION BY {keys} ORDER BY n_team))) GROUP BY ALL"""


def curve(spark, d):
    return subject_f1(spark, d).groupBy("k", "role", "n_team").agg(F.avg("macro_f1").alias("y"))


@query("n_threshold", using("curve", "SELECT k, role, round(n_needed, 6) AS n_needed FROM (" + threshold_sql("curve", "k, role") + ")"))
def n_threshold(spark, d):
    return rounded(ST.n_threshold(curve(spark, d), ["k", "role"], "n_team", "y", 0.9))


part("complete", ("ath",), """SELECT k, role, subject, max(macro_f1) FILTER (n_team = 2) AS y2, max(macro_f1) FILTER (n_team = 4) AS y4, max(macro_f1) FILTER (n_team = 6) AS y6
  FROM ath GROUP BY ALL HAVING count(*) = 3""")
part("numbered", ("complete",), "SELECT *, row_number() OVER (PARTITION BY k, role ORDER BY md5('0|' || subject), subject) AS j, count(*) OVER (PARTITION BY k, role) AS n FROM complete")
part("draws", ("numbered",), f"""SELECT a.k, a.role, rep, avg(b.y2) AS y2, avg(b.y4) AS y4, avg(b.y6) AS y6 FROM (
  SELECT k, role, rep, 1 + ('0x' || substr(md5('0|' || rep || '|' || j), 1, 8))::BIGINT % n AS idx FROM numbered, (SELECT unnest(range(1, {B + 1})) AS rep)) a
  JOIN numbered b ON (b.k, b.role, b.j) = (a.k, a.role, a.idx) GROUP BY ALL""")
part("bcurves", ("draws",), "SELECT k, role, rep, n_team, y FROM draws, LATERAL (SELECT unnest([2, 4, 6]) AS n_team, unnest([y2, y4, y6]) AS y)")


@query("n_threshold_interval", using("bcurves", f"SELECT k, role, round(quantile_cont(n_needed, 0.025), 6) AS ci_lo, round(quantile_cont(n_needed, 0.975), 6) AS ci_hi, count(n_needed) AS n_reached FROM ({threshold_sql('bcurves', 'k, role, rep')}) GROUP BY ALL"))
def n_threshold_interval(spark, d):
    """Interval of the threshold over bootstrapped subjects (complete cases); replicates are an extra key."""
    at = {f"y{n}": F.max(F.when(F.col("n_team") == n, F.col("macro_f1"))) for n in D.sizes}
    full = subject_f1(spark, d).groupBy("k", "role", "subject").agg(F.count(F.lit(1)).alias("_n"), *[v.alias(c) for c, v in at.items()])
    reps = ST.resamples(full.where(F.col("_n") == len(D.sizes)), ["k", "role"], "subject", list(at), B, 0)
    pts = F.array(*[F.struct(F.lit(n).alias("n_team"), F.col(f"y{n}").alias("y")) for n in D.sizes])
    curves = reps.select("k", "role", "rep", F.explode(pts).alias("p")).select("k", "role", "rep", "p.*")
    t = ST.n_threshold(curves, ["k", "role", "rep"], "n_team", "y", 0.9)
    return rounded(t.groupBy("k", "role").agg(F.percentile("n_needed", 0.025).alias("ci_lo"), F.percentile("n_needed", 0.975).alias("ci_hi"),
                                              F.count("n_needed").alias("n_reached")))


@query("monotone_curve", "SELECT l_returnflag, l_linenumber, round(max(m) OVER (PARTITION BY l_returnflag ORDER BY l_linenumber), 4) AS peak FROM (SELECT l_returnflag, l_linenumber, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL)")
def monotone_curve(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_extendedprice").alias("m"))
    w = Window.partitionBy("l_returnflag").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    return c.select("l_returnflag", "l_linenumber", F.round(F.max("m").over(w), 4).alias("peak"))


@query("equivalent_n", using("ath escores", """, mono AS (SELECT n_team, max(y) OVER (ORDER BY n_team) AS f FROM (SELECT n_team, avg(macro_f1) AS y FROM ath WHERE k = 1 AND role = 'new' GROUP BY ALL)),
  s AS (SELECT condition, subject, avg(macro_f1) AS v FROM escores GROUP BY ALL),
  seg AS (SELECT n_team AS x0, f AS f0, lead(n_team) OVER (ORDER BY n_team) AS x1, lead(f) OVER (ORDER BY n_team) AS f1 FROM mono)
  SELECT condition, subject, round(v, 6) AS score, round(CASE WHEN v >= (SELECT min(f) FROM mono) AND v <= (SELECT max(f) FROM mono) THEN
    (SELECT CASE WHEN x1 IS NULL THEN x0::DOUBLE ELSE x0 + (v - f0) / (f1 - f0) * (x1 - x0) END FROM seg WHERE f0 <= v ORDER BY x0 DESC LIMIT 1) END, 6) AS equivalent_x FROM s""".replace("\n", " ")))
def equivalent_n(spark, d):
    c = curve(spark, d).where("k = 1 and role = 'new'").select("n_team", "y")
    s = ST.subject_means(extra_scores(spark, d), ["condition"], "macro_f1").select("condition", "subject", F.col("macro_f1").alias("score"))
    return rounded(ST.equivalent_x(s, c, [], "n_team", "y", "score").select("condition", "subject", "score", "equivalent_x"))


@query("group_by_threshold", using("preds spreds", """, m AS (SELECT 'vote' AS model, * EXCLUDE (n_windows) FROM preds UNION ALL SELECT 'set', * FROM spreds),
  r AS (SELECT model, truth AS cls, n_team, avg(r) AS recall FROM (SELECT model, truth, n_team, subject, avg((truth = pred)::INTEGER) AS r FROM m WHERE role = 'new' AND k = 1 GROUP BY ALL) GROUP BY ALL),
  g AS (SELECT model, cls, max(recall) FILTER (n_team = 4) AS r4, max(recall) FILTER (n_team = 6) AS r6 FROM r GROUP BY ALL),
  h AS (SELECT *, CASE WHEN r4 >= 0.2 THEN 'easy' WHEN r6 < 0.1 THEN 'stuck' ELSE 'more' END AS grp FROM g)
  SELECT cls, max(grp) FILTER (model = 'vote') AS vote_group, max(grp) FILTER (model = 'set') AS set_group, count(DISTINCT grp) = 1 AS agree FROM h GROUP BY ALL""".replace("\n", " ")))
def group_by_threshold(spark, d):
    """Classes sorted into easy / stuck / more by recall at two team sizes, and whether the two models agree."""
    cols = ["n_team", "k", "role", "subject", "truth", "pred"]
    p = X.saved_predictions(spark, d).select(*cols, F.lit("vote").alias("model")).unionByName(
        set_level_predictions(spark, d).select(*cols, F.lit("set").alias("model"))).where("role = 'new' and k = 1")
    r = S.two_level_mean(p, ["model", "truth", "n_team"], "subject", (F.col("truth") == F.col("pred")).cast("int"), "recall")
    g = r.groupBy("model", F.col("truth").alias("cls")).pivot("n_team", [4, 6]).agg(F.max("recall"))
    g = g.withColumn("grp", F.when(F.col("4") >= 0.2, "easy").when(F.col("6") < 0.1, "stuck").otherwise("more"))
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("grp")))
    return g.groupBy("cls").agg(pick("vote").alias("vote_group"), pick("set").alias("set_group"), (F.countDistinct("grp") == 1).alias("agree"))


# --- transfer --------------------------------------------------------------------------------------

_FB = FAM.format(c="classes[1]"), FAM.format(c="classes[2]"), FAM.format(c="truth")
part("tr", ("bpairsj", "pairs"), f"""
  SELECT subject, (pred = truth)::INTEGER - (pred_none = truth)::INTEGER AS change, list_has_any({_FB[2]}, {_FB[0]}) OR list_has_any({_FB[2]}, {_FB[1]}) AS same_family,
    EXISTS (FROM pairs q WHERE q.balanced_acc < 0.5 AND q.class_a = least(truth, classes[1]) AND q.class_b = greatest(truth, classes[1]))
    OR EXISTS (FROM pairs q WHERE q.balanced_acc < 0.5 AND q.class_a = least(truth, classes[2]) AND q.class_b = greatest(truth, classes[2])) AS confusable
  FROM bpairsj WHERE NOT list_contains(classes, truth)""")
part("trd", ("tr",), """
  SELECT tag, subject, avg(change) FILTER (flag) AS va, avg(change) FILTER (NOT flag) AS vb, avg(change) FILTER (flag) - avg(change) FILTER (NOT flag) AS d FROM (
    SELECT 'same_family' AS tag, subject, same_family AS flag, change FROM tr UNION ALL SELECT 'confusable', subject, confusable, change FROM tr) GROUP BY ALL
  HAVING avg(change) FILTER (flag) - avg(change) FILTER (NOT flag) IS NOT NULL""")


@query("transfer_effect", using("trd", paired_sql("trd", "tag", B)))
def transfer_effect(spark, d):
    """Change in correctness against no battery, for classes similar to a battery class and for the others."""
    b = battery_rows(spark, d).where(~F.array_contains("classes", F.col("truth")))
    conf = VA.saved_pair_screen(spark, d).where("balanced_acc < 0.5").select(F.concat_ws("-", "class_a", "class_b").alias("key"))
    # the confusable pairs as one array: at most one entry per class pair
    keys = conf.agg(F.collect_set("key")).scalar()
    pair = F.transform("classes", lambda c: F.concat_ws("-", F.least(c, F.col("truth")), F.greatest(c, F.col("truth"))))
    b = b.withColumns({"_conf": keys, "change": (F.col("pred") == F.col("truth")).cast("int") - (F.col("pred_none") == F.col("truth")).cast("int"),
                       "same_family": F.exists("classes", lambda c: F.arrays_overlap(V.families(c), V.families("truth")))})
    b = b.withColumn("confusable", F.arrays_overlap(pair, F.col("_conf")))
    tags = F.array(F.struct(F.lit("same_family").alias("tag"), F.col("same_family").alias("flag")), F.struct(F.lit("confusable").alias("tag"), F.col("confusable").alias("flag")))
    r = b.select("subject", "change", F.explode(tags).alias("t")).select("subject", "change", "t.*")
    u = r.groupBy("tag", "subject").agg(F.avg(F.when(F.col("flag"), F.col("change"))).alias("_a"), F.avg(F.when(~F.col("flag"), F.col("change"))).alias("_b"))
    rows = u.withColumn("d", F.col("_a") - F.col("_b")).where("d is not null")
    out = ST.paired_differences(rows, ["tag"], B, exact=False)
    return rounded(out.select("tag", *PAIRED[:7], F.col("n_used").cast("bigint").alias("n_used"), *PAIRED[8:]))


# --- regressions and variance ----------------------------------------------------------------------

@query("fixed_effects_slopes", """WITH d AS (SELECT l_returnflag, l_suppkey, l_extendedprice / 1000 AS y, log2(l_quantity) AS a, log2(l_linenumber) AS b FROM lineitem),
  g AS (SELECT l_returnflag, y - avg(y) OVER w AS y, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM d WINDOW w AS (PARTITION BY l_returnflag, l_suppkey)),
  s AS (SELECT l_returnflag, count(*) AS n_rows, sum(y * y) AS yy, sum(y * a) AS ya, sum(y * b) AS yb, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM g GROUP BY ALL),
  t AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS s1, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS s2 FROM s)
  SELECT l_returnflag, n_rows, round(s1, 6) AS slope_1, round(s2, 6) AS slope_2, round(s1 / s2, 4) AS ratio, round((s1 * ya + s2 * yb) / yy, 6) AS within_r2 FROM t""")
def fixed_effects_slopes(spark, d):
    li = table(spark, d, "lineitem")
    out = ST.within_slopes(li, ["l_returnflag"], "l_suppkey", F.col("l_extendedprice") / 1000, F.log2("l_quantity"), F.log2("l_linenumber"))
    return rounded(out.withColumn("ratio", F.round("ratio", 4)))


part("fe", ("scores",), "SELECT subject, n_team, k, avg(macro_f1) AS y FROM scores WHERE role = 'new' GROUP BY ALL")
part("fed", ("fe",), "SELECT subject, y - avg(y) OVER w AS y, log2(n_team) - avg(log2(n_team)) OVER w AS a, log2(k) - avg(log2(k)) OVER w AS b FROM fe WINDOW w AS (PARTITION BY subject)")
part("fes", ("fed",), "SELECT subject, sum(y * a) AS ya, sum(y * b) AS yb, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM fed GROUP BY ALL")
part("fen", ("fes",), "SELECT *, row_number() OVER (ORDER BY md5('0|' || subject), subject) AS j, count(*) OVER () AS n FROM fes")


@query("slopes_interval", using("fen", f"""SELECT round(quantile_cont(s1, 0.025), 6) AS slope_1_lo, round(quantile_cont(s1, 0.975), 6) AS slope_1_hi, round(quantile_cont(s2, 0.025), 6) AS slope_2_lo,
  round(quantile_cont(s2, 0.975), 6) AS slope_2_hi, round(quantile_cont(s1 - s2, 0.025), 6) AS shift_lo, round(quantile_cont(s1 - s2, 0.975), 6) AS shift_hi FROM (
    SELECT rep, (avg(ya) * avg(bb) - avg(yb) * avg(ab)) / (avg(aa) * avg(bb) - avg(ab) * avg(ab)) AS s1, (avg(yb) * avg(aa) - avg(ya) * avg(ab)) / (avg(aa) * avg(bb) - avg(ab) * avg(ab)) AS s2 FROM (
      SELECT rep, b.* FROM (SELECT rep, 1 + ('0x' || substr(md5('0|' || rep || '|' || j), 1, 8))::BIGINT % n AS idx FROM fen, (SELECT unnest(range(1, {B + 1})) AS rep)) a JOIN fen b ON b.j = a.idx) GROUP BY ALL)"""))
def slopes_interval(spark, d):
    """Cluster bootstrap: subjects carry their own sums of products, so replicates resample those sums."""
    u = X.grid_scores(spark, d).where("role = 'new'").groupBy("subject", "n_team", "k").agg(F.avg("macro_f1").alias("y"))
    u = u.withColumns({"a": F.log2("n_team"), "b": F.log2("k")})
    pairs = ["ya", "yb", "aa", "ab", "bb"]
    s = u.groupBy("subject").agg(*[(F.covar_pop(p[0], p[1]) * F.count(F.lit(1))).alias(p) for p in pairs])
    r = ST.resamples(s, [], "subject", pairs, B, 0)
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    r = r.withColumns({"s1": (F.col("ya") * F.col("bb") - F.col("yb") * F.col("ab")) / det, "s2": (F.col("yb") * F.col("aa") - F.col("ya") * F.col("ab")) / det})
    r = r.withColumn("shift", F.col("s1") - F.col("s2"))
    return rounded(r.agg(*[F.percentile(c, p).alias(f"{n}_{e}") for c, n in (("s1", "slope_1"), ("s2", "slope_2"), ("shift", "shift")) for p, e in ((0.025, "lo"), (0.975, "hi"))]))


@query("variance_shares", """WITH d AS (SELECT o_totalprice AS y, avg(o_totalprice) OVER () AS m, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS mc,
  avg(o_totalprice) OVER (PARTITION BY o_orderpriority, o_custkey) AS ms FROM orders)
  SELECT round(sum((mc - m) ** 2) / sum((y - m) ** 2), 6) AS between_class, round(sum((ms - mc) ** 2) / sum((y - m) ** 2), 6) AS between_subject,
  round(sum((y - ms) ** 2) / sum((y - m) ** 2), 6) AS residual FROM d""")
def variance_shares(spark, d):
    return rounded(ST.variance_shares(AD.order_bouts(spark, d), "cls", "subject", "duration_s"))


@query("log2_trend", """SELECT l_returnflag, round(regr_slope(l_extendedprice, log2(l_quantity)), 4) AS slope, round(regr_intercept(l_extendedprice, log2(l_quantity)), 4) AS intercept,
  """ + ", ".join(f"round(regr_intercept(l_extendedprice, log2(l_quantity)) + regr_slope(l_extendedprice, log2(l_quantity)) * log2({x}), 4) AS at_{x}" for x in (5, 20, 40))
       + " FROM lineitem GROUP BY ALL")
def log2_trend(spark, d):
    y, x = F.col("l_extendedprice"), F.log2("l_quantity")
    t = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    import math

    t = t.withColumns({f"at_{v}": F.col("intercept") + F.col("slope") * math.log2(v) for v in (5, 20, 40)})
    return t.select("l_returnflag", *[F.round(c, 4).alias(c) for c in t.columns[1:]])


PER_SESSION = """, f AS (SELECT subject, min(period_date) AS b FROM event_rows GROUP BY ALL),
  ps AS (SELECT subject, session_id, CAST(period_date - b AS INTEGER) AS days_since, avg((rep_count % 5 = length(cls) % 5)::INTEGER) AS accuracy FROM event_rows JOIN f USING (subject) GROUP BY ALL)""".replace("\n", " ")


def sessions(spark, d):
    return period_rows(spark, d).groupBy("subject", "session_id", "days_since").agg(F.avg("ok").alias("accuracy")).withColumn(
        "role", F.when(F.col("subject") % 2 == 0, "recorded").otherwise("new"))


@query("linear_and_rank_trend", using("event_rows", PER_SESSION + """, r AS (SELECT *, CASE WHEN subject % 2 = 0 THEN 'recorded' ELSE 'new' END AS role FROM ps),
  k AS (SELECT *, rank() OVER (PARTITION BY role ORDER BY days_since) + (count(*) OVER (PARTITION BY role, days_since) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY role ORDER BY accuracy) + (count(*) OVER (PARTITION BY role, accuracy) - 1) / 2.0::DOUBLE AS ry FROM r)
  SELECT role, count(*) AS n, round(regr_slope(accuracy, days_since), 6) AS slope, round(corr(rx, ry), 6) AS rho FROM k GROUP BY ALL""".replace("\n", " ")))
def linear_and_rank_trend(spark, d):
    s = sessions(spark, d)
    s = mid_ranks(mid_ranks(s, ["role"], "days_since", "rx"), ["role"], "accuracy", "ry")
    return rounded(s.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("accuracy", "days_since").alias("slope"), ST.correlation("rx", "ry").alias("rho")))


RANKED = 199  # drawn orders


@query("rank_trend", using("event_rows", PER_SESSION + f""", r AS (SELECT *, CASE WHEN subject % 2 = 0 THEN 'recorded' ELSE 'new' END AS role, session_id AS u FROM ps),
  k AS (SELECT *, rank() OVER (PARTITION BY role ORDER BY days_since) + (count(*) OVER (PARTITION BY role, days_since) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY role ORDER BY accuracy) + (count(*) OVER (PARTITION BY role, accuracy) - 1) / 2.0::DOUBLE AS ry,
    row_number() OVER (PARTITION BY role ORDER BY md5('0|id|' || u), u) AS i FROM r),
  o AS (SELECT role, count(*) AS n, corr(rx, ry) AS rho, abs(sum(rx * ry) - count(*) * avg(rx) * avg(rx)) - 1e-9 AS far, avg(rx) AS m FROM k GROUP BY ALL),
  q AS (SELECT role, rep, ry, row_number() OVER (PARTITION BY role, rep ORDER BY md5('0|' || rep || '|' || u), u) AS i FROM k, (SELECT unnest(range(1, {RANKED + 1})) AS rep)),
  t AS (SELECT q.role, rep, sum(rx * q.ry) AS t FROM q JOIN k ON (k.role, k.i) = (q.role, q.i) GROUP BY ALL),
  p AS (SELECT role, (count(*) FILTER (abs(t - n * m * m) >= far) + 1) / {RANKED + 1}.0 AS p FROM t JOIN o USING (role) GROUP BY ALL)
  SELECT role, n, round(rho, 6) AS rho, round(p::DOUBLE, 6) AS p FROM o JOIN p USING (role)""".replace("\n", " ")))
def rank_trend(spark, d):
    """Rank correlation of accuracy with time, and its permutation p, by seeded orders of the sessions."""
    return rounded(ST.rank_trend(sessions(spark, d), ["role"], "session_id", "days_since", "accuracy", RANKED))


@query("first_last_change", using("event_rows", PER_SESSION + """SELECT subject, round(arg_max(a, days_since) - arg_min(a, days_since), 6) AS change FROM (
  SELECT subject, days_since, avg(accuracy) AS a FROM ps GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 2"""))
def first_last_change(spark, d):
    per = sessions(spark, d).groupBy("subject", "days_since").agg(F.avg("accuracy").alias("a"))
    g = per.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), (F.max_by("a", "days_since") - F.min_by("a", "days_since")).alias("change"))
    return rounded(g.where("n >= 2").drop("n"))


@query("group_demean", "SELECT o_orderkey, round(ln(o_totalprice) - avg(ln(o_totalprice)) OVER (PARTITION BY o_custkey), 6) AS demeaned FROM orders")
def group_demean(spark, d):
    # group means by partial sums and a join back: no task sees a whole subject
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.log("o_totalprice").alias("y"))
    m = o.groupBy("o_custkey").agg(F.avg("y").alias("m"))
    return o.join(m, "o_custkey").select("o_orderkey", r6(F.col("y") - F.col("m")).alias("demeaned"))


@query("effect_table", using("kd rg escores", f""", kn AS (SELECT * FROM kd WHERE role = 'new'),
  a AS (SELECT condition, subject, avg(macro_f1) AS f FROM escores GROUP BY ALL),
  ex AS (SELECT x.condition, x.subject, x.f - b.f AS d FROM a x JOIN a b ON b.subject = x.subject AND b.condition = 'base' WHERE x.condition <> 'base'),
  u AS (SELECT 'Second set' AS section, 'N = ' || n_team AS label, subject, d, FALSE AS is_reference FROM kn UNION ALL
        SELECT 'Known subject', 'N = ' || n_team || ', k = ' || k, subject, d, TRUE FROM rg UNION ALL
        SELECT 'Extra sets', condition, subject, d, condition = 'broad' FROM ex)
  SELECT section, label, is_reference, round(avg(d), 6) AS mean, round(max(ci_lo), 6) AS lo, round(max(ci_hi), 6) AS hi FROM u JOIN ({bootstrap_sql('u', 'section, label', 'subject', 'd', B)}) USING (section, label) GROUP BY ALL""".replace("\n", " ")))
def effect_table(spark, d):
    """One table of effects gathered from several comparisons."""
    a = subject_f1(spark, d)

    def diff(x, y, keys):
        return x.select(*keys, "subject", F.col("macro_f1").alias("_a")).join(y.select(*keys, "subject", F.col("macro_f1").alias("_b")), [*keys, "subject"]).withColumn("d", F.col("_a") - F.col("_b"))

    def label(df, section, text, ref):
        return df.select(F.lit(section).alias("section"), text.alias("label"), "subject", "d", ref.alias("is_reference"))

    new = a.where("role = 'new'")
    e = ST.subject_means(extra_scores(spark, d), ["condition"], "macro_f1")
    depth = label(diff(new.where("k = 2"), new.where("k = 1"), ["n_team"]), "Second set", F.concat(F.lit("N = "), F.col("n_team")), F.lit(False))
    known = label(diff(a.where("role = 'recorded'"), new, ["n_team", "k"]), "Known subject", F.concat(F.lit("N = "), F.col("n_team"), F.lit(", k = "), F.col("k")), F.lit(True))
    base = e.where("condition = 'base'").select("subject", F.col("macro_f1").alias("_b"))
    more = e.where("condition <> 'base'").join(base, "subject").withColumn("d", F.col("macro_f1") - F.col("_b"))
    extra = label(more, "Extra sets", F.col("condition"), F.col("condition") == "broad")
    u = depth.unionByName(known).unionByName(extra)
    ci = ST.bootstrap_ci(u, ["section", "label", "is_reference"], "subject", "d", B)
    return rounded(ci.select("section", "label", "is_reference", "mean", F.col("ci_lo").alias("lo"), F.col("ci_hi").alias("hi")))
