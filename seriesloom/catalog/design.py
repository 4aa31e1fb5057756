"""Design queries: plans, splits, selections, set operations, joins."""

from pyspark.sql import functions as F

from seriesloom.catalog.registry import query, r6
from seriesloom.catalog.sqlparts import using
from seriesloom.operators import joins as J
from seriesloom.operators import selection as SEL
from seriesloom.plans import cohort as P
from seriesloom.plans import experiment as X
from seriesloom.session import table
from seriesloom.sources import adapters as AD

D = P.Design()


def plan(spark, d):
    bouts = AD.vector_bouts(spark, d)
    roles = X.saved_roles(spark, d, D)
    order = P.nested_set_order(bouts, roles, D)
    return bouts, roles, order, P.train_sets(order, D), P.test_sets(bouts, roles, D)


@query("nested_rank", """SELECT repeat, subject, row_number() OVER (PARTITION BY repeat ORDER BY md5('7|' || repeat || '|' || subject), subject) AS rank
  FROM (SELECT DISTINCT o_custkey AS subject FROM orders), (SELECT unnest(range(1, 4))::INTEGER AS repeat)""")
def nested_rank(spark, d):
    return P.rank_subjects(AD.order_bouts(spark, d), D.repeats, D.seed)


@query("make_plan", using("pool", "SELECT repeat::INTEGER AS repeat, subject, role, rank FROM pool"))
def make_plan(spark, d):
    return P.make_roles(AD.vector_bouts(spark, d), D)


@query("topk_per_group", using("set_order", "SELECT repeat::INTEGER AS repeat, subject, cls, series_id, set_rank FROM set_order"))
def topk_per_group(spark, d):
    return plan(spark, d)[2].select("repeat", "subject", "cls", "series_id", "set_rank")


@query("topk_guard", using("train", """SELECT repeat::INTEGER AS repeat, n_team, k, subject, CAST(10 - count(*) FILTER (n >= k) AS BIGINT) AS short_classes FROM (
  SELECT repeat, n_team, k, subject, cls, count(*) AS n FROM train GROUP BY ALL) GROUP BY ALL"""))
def topk_guard(spark, d):
    return P.missing_sets(plan(spark, d)[3], D)


@query("topk_extra", using("set_order", """SELECT repeat::INTEGER AS repeat, subject, cls, series_id FROM set_order
  WHERE team_rank <= 4 AND set_rank <= CASE WHEN cls IN (0, 1, 2) THEN 2 ELSE 1 END"""))
def topk_extra(spark, d):
    return P.extra_sets(plan(spark, d)[2], 4, [0, 1, 2]).select("repeat", "subject", "cls", "series_id")


@query("topk_depth", using("roles", """SELECT repeat::INTEGER AS repeat, subject, cls, series_id, period_order, set_rank FROM (
  SELECT repeat, subject, cls, series_id, period_order, row_number() OVER (PARTITION BY repeat, subject, cls ORDER BY period_order > 1,
    CASE WHEN period_order = 1 THEN md5('7|' || repeat || '|' || series_id) END NULLS FIRST, series_id) AS set_rank
  FROM vbouts JOIN roles r USING (subject) WHERE role = 'candidate' AND r.rank <= 4) WHERE set_rank <= 4"""))
def topk_depth(spark, d):
    bouts, roles = plan(spark, d)[:2]
    return P.depth_sets(bouts, roles, D, 4, 4, ["series_id"])


@query("train_test", using("train test", """SELECT repeat::INTEGER AS repeat, n_team, k, part, count(*) AS n_series, count(DISTINCT subject) AS n_subjects FROM (
  SELECT repeat, n_team, k, 'train' AS part, subject FROM train UNION ALL SELECT repeat, n_team, k, role AS part, subject FROM test) GROUP BY ALL"""))
def train_test(spark, d):
    *_, train, test = plan(spark, d)
    both = train.select("repeat", "n_team", "k", F.lit("train").alias("part"), "subject").unionByName(
        test.select("repeat", "n_team", "k", F.col("role").alias("part"), "subject"))
    return both.groupBy("repeat", "n_team", "k", "part").agg(F.count(F.lit(1)).alias("n_series"), F.countDistinct("subject").alias("n_subjects"))


@query("subject_split", """SELECT subject, CASE WHEN rank <= greatest(1, round_even(n * 0.3, 0)) THEN 'test' ELSE 'train' END AS part FROM (
  SELECT subject, row_number() OVER (ORDER BY md5('5|1|' || subject), subject) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey AS subject FROM orders))""")
def subject_split(spark, d):
    return P.subject_split(AD.order_bouts(spark, d), 0.3, 5)


@query("group_kfold", """SELECT subject, n_rows, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INTEGER) AS fold FROM (
  SELECT *, row_number() OVER (ORDER BY n_rows DESC, md5('0|' || subject), subject) - 1 AS r FROM (SELECT o_custkey AS subject, count(*) AS n_rows FROM orders GROUP BY ALL))""")
def group_kfold(spark, d):
    return P.group_kfold(AD.order_bouts(spark, d), 5)


@query("assert_no_leak", "SELECT unnest(['series in train and test', 'period rule', 'new subject in train']) AS \"check\", 0::BIGINT AS n_violations")
def assert_no_leak(spark, d):
    bouts, roles, _, train, test = plan(spark, d)
    return P.leak_violations(train, test, bouts, roles)


@query("budget_equality", using("train", """SELECT CAST(budget AS INTEGER) AS budget, count(*) AS n_conditions, min(n) AS sets_min, max(n) AS sets_max, min(n) = max(n) AS equal FROM (
  SELECT n_team * k AS budget, repeat, n_team, k, count(*) AS n FROM train GROUP BY ALL) GROUP BY ALL"""))
def budget_equality(spark, d):
    n = plan(spark, d)[3].groupBy((F.col("n_team") * F.col("k")).alias("budget"), "repeat", "n_team", "k").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("budget").agg(F.count(F.lit(1)).alias("n_conditions"), F.min("n").alias("sets_min"), F.max("n").alias("sets_max")).withColumn(
        "equal", F.col("sets_min") == F.col("sets_max"))


@query("semi_select", """SELECT o_orderkey AS series_id FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderpriority) = 5)""")
def semi_select(spark, d):
    o = AD.order_bouts(spark, d)
    chosen = o.groupBy("subject").agg(F.countDistinct("cls").alias("k")).where("k = 5").select("subject")
    return o.join(chosen, "subject", "left_semi").select("series_id")


@query("anti_exclude", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_exclude(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("lookup_map", """SELECT event_id, round(value - m, 6) AS above_class_mean FROM events JOIN (SELECT event_type, avg(value) AS m FROM events GROUP BY ALL) USING (event_type)""")
def lookup_map(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    m = e.groupBy("event_type").agg(F.avg("value").alias("m"))
    return e.join(m, "event_type").select("event_id", r6(F.col("value") - F.col("m")).alias("above_class_mean"))


@query("condition_grid", using("train", """SELECT g.repeat::INTEGER AS repeat, g.n_team, g.k, g.model, g.n_team <= c.n - 2 AS feasible, count(t.series_id) AS n_train FROM (
  SELECT * FROM (SELECT unnest(range(1, 4)) AS repeat), (SELECT unnest([2, 4, 6, 1000]) AS n_team), (SELECT unnest([1, 2]) AS k), (SELECT unnest(['profile', 'forest']) AS model)) g,
  (SELECT count(DISTINCT subject) AS n FROM vbouts) c LEFT JOIN train t ON (t.repeat, t.n_team, t.k) = (g.repeat, g.n_team, g.k) GROUP BY ALL"""))
def condition_grid(spark, d):
    bouts, *_, train, _ = plan(spark, d)
    n = bouts.agg(F.countDistinct("subject").alias("n")).scalar()
    g = J.condition_grid(spark, {"repeat": [1, 2, 3], "n_team": [2, 4, 6, 1000], "k": [1, 2], "model": ["profile", "forest"]})
    g = g.withColumn("feasible", F.col("n_team") <= n - D.n_new)
    sizes = train.groupBy("repeat", "n_team", "k").agg(F.count(F.lit(1)).alias("n_train"))
    return g.join(sizes, ["repeat", "n_team", "k"], "left").withColumn("n_train", F.coalesce("n_train", F.lit(0)))


@query("class_pairs", using("vbouts", """, c AS (SELECT cls, count(DISTINCT subject) AS n FROM vbouts GROUP BY ALL HAVING count(DISTINCT subject) >= 3)
  SELECT a.cls AS class_a, b.cls AS class_b, a.n AS n_subjects_a, b.n AS n_subjects_b FROM c a JOIN c b ON a.cls < b.cls""".replace("\n", " ")))
def class_pairs(spark, d):
    return J.class_pairs(AD.vector_bouts(spark, d), 3)


@query("complement_classes", "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def complement_classes(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id"))


@query("battery_complement", """SELECT battery, list_sort(list_filter(range(0, 10), lambda c: NOT list_contains(list_transform(string_split(battery, ','), lambda s: s::INTEGER), c)))::INTEGER[] AS others, n FROM (
  SELECT (l_suppkey % 10) || ',' || (l_partkey % 10) AS battery, count(*) AS n FROM lineitem GROUP BY ALL)""")
def battery_complement(spark, d):
    from seriesloom.catalog.audit import batteries
    from seriesloom.functions.columns import class_list

    b = batteries(spark, d).groupBy("battery").agg(F.count(F.lit(1)).alias("n"))
    return b.withColumn("others", F.array_sort(F.array_except(F.sequence(F.lit(0), F.lit(9)), class_list("battery"))))


@query("dedupe_sessions", using("event_rows", """SELECT session_id, subject, series_id, cls, rep_count FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY started, series_id) AS rn FROM event_rows) WHERE rn = 1"""))
def dedupe_sessions(spark, d):
    return SEL.first_per_group(AD.event_rows(spark, d), "session_id", ["started", "series_id"], ["subject", "series_id", "cls", "rep_count"])


@query("session_order", using("periods", "SELECT subject, period_date, session_order FROM periods"))
def session_order(spark, d):
    return AD.periods(AD.event_rows(spark, d)).select("subject", "period_date", F.col("session_order").cast("bigint").alias("session_order"))


@query("period_order", using("periods", "SELECT subject, period_date, week, period_order FROM periods"))
def period_order(spark, d):
    return AD.periods(AD.event_rows(spark, d)).select("subject", "period_date", "week", F.col("period_order").cast("bigint").alias("period_order"))


@query("attach_session_order", using("bouts", "SELECT series_id, subject, session_id, session_order, period_order FROM bouts"))
def attach_session_order(spark, d):
    return AD.bouts(spark, d).select("series_id", "subject", "session_id", F.col("session_order").cast("bigint").alias("session_order"),
                                     F.col("period_order").cast("bigint").alias("period_order"))


@query("union_runs", """SELECT 'events' AS run, event_type AS cls, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS reps FROM events GROUP BY ALL
  UNION ALL SELECT 'orders', o_orderpriority, count(*), NULL FROM orders GROUP BY ALL""")
def union_runs(spark, d):
    e = AD.event_rows(spark, d).groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("rep_count").alias("reps"))
    o = AD.order_bouts(spark, d).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    return SEL.union_runs({"events": e, "orders": o}, "run")


@query("budget_minutes", """WITH o AS (SELECT o_custkey AS subject, o_totalprice AS duration_s, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('7|1|' || o_orderkey), o_orderkey) AS set_rank FROM orders)
  SELECT k::INTEGER AS k, count(*) AS n_series, count(DISTINCT subject) AS n_subjects, round(sum(duration_s) / 60, 4) AS minutes FROM o, (SELECT unnest([1, 2, 4]) AS k) WHERE set_rank <= k GROUP BY ALL""")
def budget_minutes(spark, d):
    """Minutes of recording that a design with 1, 2 or 4 seeded sets per subject costs."""
    from seriesloom.functions.hashing import draw_key
    from seriesloom.functions.ordering import first_k

    o = AD.order_bouts(spark, d).select("subject", "series_id", "duration_s", draw_key(7, F.lit(1), "series_id").alias("_o"))
    top = first_k(o, ["subject"], [F.col("_o"), F.col("series_id")], 4, "set_rank")
    each = top.select("*", F.explode(F.filter(F.array(F.lit(1), F.lit(2), F.lit(4)), lambda k: k >= F.col("set_rank"))).alias("k"))
    return each.groupBy("k").agg(F.count(F.lit(1)).alias("n_series"), F.countDistinct("subject").alias("n_subjects"),
                                 F.round(F.sum("duration_s") / 60, 4).alias("minutes"))


@query("shared_subjects", using("train test", """SELECT role, count(DISTINCT subject) FILTER (subject IN (SELECT subject FROM train t WHERE (t.repeat, t.n_team, t.k) = (1, 4, 1))) AS n_shared
  FROM test WHERE repeat = 1 AND n_team = 4 AND k = 1 GROUP BY ALL""".replace("\n", " ")))
def shared_subjects(spark, d):
    """Subjects that training and test tables of a cell share: all recorded ones, no new one."""
    bouts, roles = AD.vector_bouts(spark, d), X.saved_roles(spark, d, D)
    cell = "repeat = 1 and n_team = 4 and k = 1"
    train, test = P.train_sets(P.nested_set_order(bouts, roles, D), D).where(cell), P.test_sets(bouts, roles, D).where(cell)
    P.refuse_shared(train, test.where("role = 'new'"))
    out = None
    for role in ("recorded", "new"):
        one = P.shared_values(test.where(F.col("role") == role), train).agg(F.count(F.lit(1)).alias("n_shared")).select(F.lit(role).alias("role"), "n_shared")
        out = one if out is None else out.unionByName(one)
    return out


@query("subject_demographics", """SELECT o_custkey AS subject, arg_min(p, (o_orderdate, o_orderkey)) FILTER (p IS NOT NULL) AS priority, arg_min(s, (o_orderdate, o_orderkey)) FILTER (s IS NOT NULL) AS status
  FROM (SELECT *, CASE WHEN o_totalprice > 100000 THEN o_orderpriority END AS p, nullif(o_orderstatus, 'P') AS s FROM orders) GROUP BY ALL""".replace("\n", " "))
def subject_demographics(spark, d):
    """What each customer stated first of several things that are not always stated."""
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("subject"), "o_orderdate", "o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    return SEL.first_known(o, ["subject"], ["o_orderdate", "o_orderkey"], ["priority", "status"])
