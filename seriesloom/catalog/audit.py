"""Audit queries: parsing, quality, coverage, eligibility, duplicates, simple projections."""

import functools

from pyspark.sql import functions as F

from seriesloom.catalog.registry import query, r6, rounded
from seriesloom.catalog.sqlparts import category_sql, families_sql, using
from seriesloom.functions import columns as C
from seriesloom.functions import vocabulary as V
from seriesloom.functions.ordering import null_safe_join, split_quantiles
from seriesloom.operators import audit as A
from seriesloom.session import table
from seriesloom.sources import adapters as AD
from seriesloom.sources import files as FI

TYPES = ["click", "error", "purchase", "signup", "view"]
def piece():
    """Stretches of 65,536 consecutive ids: the order-keeping split of long series."""
    return F.floor(F.col("i") / 65536)


NAMES_SQL = """SELECT event_id, 'u' || user_id || '_' || strftime(ts, '%Y_%m%d_%H%M%S') || '_segment' || lpad((event_id % 100)::VARCHAR, 2, '0') || '_'
  || CASE WHEN event_type = 'error' THEN 'rest' ELSE lpad(length(event_type)::VARCHAR, 2, '0') END AS name FROM events"""


def names(spark, d):
    """Recording names spelled from the events; errors stand for rest recordings."""
    kind = F.when(F.col("event_type") == "error", "rest").otherwise(F.lpad(F.length("event_type").cast("string"), 2, "0"))
    return table(spark, d, "events").select("event_id", F.concat(
        F.lit("u"), F.col("user_id"), F.lit("_"), F.date_format("ts", "yyyy_MMdd_HHmmss"), F.lit("_segment"),
        F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"), F.lit("_"), kind).alias("name"))


@query("parse_series_name", f"""SELECT event_id, split_part(name, '_', 1) AS nick, substr(name, 1, length(name) - 13) AS session_id,
  strptime(split_part(name, '_', 2) || split_part(name, '_', 3), '%Y%m%d')::DATE AS period_date, split_part(name, '_', 4) AS session_time,
  substr(name, length(name) - 4, 2)::INTEGER AS set_order, substr(name, length(name) - 1)::INTEGER AS cls
  FROM ({NAMES_SQL}) WHERE name NOT LIKE '%rest'""")
def parse_series_name(spark, d):
    return A.parse_series_name(names(spark, d)).where("matched").drop("matched", "name")


@query("unmatched_names", f"""SELECT name NOT LIKE '%rest' AS matched, count(*) AS n FROM ({NAMES_SQL}) GROUP BY ALL""")
def unmatched_names(spark, d):
    return A.parse_series_name(names(spark, d)).groupBy("matched").agg(F.count(F.lit(1)).alias("n"))


@query("flag_exclusions", """SELECT event_id, exclude_reason, exclude_reason = '' AS include FROM (
  SELECT event_id, CASE WHEN event_type = 'error' THEN 'recorder error' WHEN CAST(json_extract(props, '$.k') AS INTEGER) <= 1 THEN 'rep_count<=1'
    ELSE '' END AS exclude_reason FROM events)""")
def flag_exclusions(spark, d):
    rows = AD.event_rows(spark, d).withColumn("error", F.when(F.col("cls") == "error", "recorder error").otherwise(""))
    return A.flag_exclusions(rows).select(F.col("series_id").alias("event_id"), "exclude_reason", "include")


QUALITY_SQL = using("samples", """SELECT series_id, n_samples, duration_s, round(frac_shared_ts, 6) AS frac_shared_ts, max_gap_ms,
  round(CASE WHEN duration_s > 0 THEN (n_samples - 1) / duration_s END, 6) AS rate_hz,
  concat_ws('; ', CASE WHEN other THEN 'non-sensor rows' END, CASE WHEN back THEN 'timestamps go backwards' END,
            CASE WHEN NOT duration_s > 0 THEN 'zero duration' END) AS error FROM (
  SELECT series_id, count(*) AS n_samples, (arg_max(t_ms, i) - arg_min(t_ms, i)) / 1000.0::DOUBLE AS duration_s, avg((dt = 0)::INTEGER) AS frac_shared_ts,
         coalesce(max(dt), 0) AS max_gap_ms, bool_or(row <> 1) AS other, bool_or(dt < 0) AS back FROM (
    SELECT s.*, CASE WHEN x < 0.5 THEN 2 ELSE 1 END AS row, t_ms - lag(t_ms) OVER (PARTITION BY series_id ORDER BY i) AS dt FROM samples s) GROUP BY ALL)""")


@query("series_quality", QUALITY_SQL)
def series_quality(spark, d):
    s = AD.samples(spark, d).withColumn("row", F.when(F.col("x") < 0.5, 2).otherwise(1))
    return rounded(A.series_quality(s, ["i"], piece()))


@query("derive_rates", """SELECT event_id, round(CAST(json_extract(props, '$.k') AS INTEGER) / nullif(value, 0), 6) AS rep_rate_hz FROM events""")
def derive_rates(spark, d):
    return A.derive_rates(AD.event_rows(spark, d)).select(F.col("series_id").alias("event_id"), r6("rep_rate_hz").alias("rep_rate_hz"))


@query("vector_magnitude", using("samples", """SELECT series_id, round(quantile_cont(sqrt(x * x + y * y + z * z), 0.5), 6) AS mag_median,
  round(max(greatest(abs(x), abs(y), abs(z))), 6) AS abs_max FROM samples GROUP BY ALL"""))
def vector_magnitude(spark, d):
    s = AD.samples(spark, d).withColumn("mag", C.magnitude("x", "y", "z"))
    peak = s.groupBy("series_id").agg(F.max(F.greatest(*[F.abs(c) for c in "xyz"])).alias("abs_max"))
    return rounded(peak.join(split_quantiles(s, ["series_id"], "mag", {"mag_median": 0.5}), "series_id"))


@query("recode_condition", """SELECT CASE WHEN starts_with(source, 'src1') THEN 'src 1x' ELSE source END AS source, count(*) AS n FROM documents GROUP BY ALL""")
def recode_condition(spark, d):
    return table(spark, d, "documents").groupBy(C.recode_prefix("source", "src1", "src 1x").alias("source")).agg(F.count(F.lit(1)).alias("n"))


REGION_SQL, PATTERN_SQL, PUSHPULL_SQL = (category_sql(m) for m in (V.REGION, V.PATTERN, V.PUSHPULL))


@query("map_categories", f"""SELECT {PUSHPULL_SQL.format(c='l_linenumber')} AS truth, coalesce({PUSHPULL_SQL.format(c='l_quantity % 15')}, 'other') AS call,
  count(*) AS n FROM lineitem WHERE {PUSHPULL_SQL.format(c='l_linenumber')} IS NOT NULL GROUP BY ALL""")
def map_categories(spark, d):
    li = table(spark, d, "lineitem")
    call = F.coalesce(V.category(F.col("l_quantity") % 15, V.PUSHPULL), F.lit(V.OTHER))
    return (li.select(V.category("l_linenumber", V.PUSHPULL).alias("truth"), call.alias("call")).where("truth is not null")
            .groupBy("truth", "call").agg(F.count(F.lit(1)).alias("n")))


@query("pretty_label", """SELECT array_to_string(list_transform(string_split(replace(name, '_', ' '), ' '),
  lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label, count(*) AS n FROM (SELECT upper(replace(p_type || '_' || p_name, ' ', '_')) AS name FROM part) GROUP BY ALL""")
def pretty_label(spark, d):
    p = table(spark, d, "part").select(F.upper(F.replace(F.concat_ws("_", "p_type", "p_name"), F.lit(" "), F.lit("_"))).alias("name"))
    return p.groupBy(C.pretty_label("name", exceptions=V.LABEL_EXCEPTIONS).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def batteries(spark, d):
    """Each line carries a two-class list spelled as text, and a true class."""
    return table(spark, d, "lineitem").select(
        F.concat_ws(",", F.col("l_suppkey") % 10, F.col("l_partkey") % 10).alias("battery"), (F.col("l_orderkey") % 10).cast("int").alias("truth"))


@query("split_class_list", """SELECT battery, truth, count(*) AS n FROM (SELECT (l_suppkey % 10) || ',' || (l_partkey % 10) AS battery, CAST(l_orderkey % 10 AS INTEGER) AS truth
  FROM lineitem) WHERE NOT list_contains(list_transform(string_split(battery, ','), lambda s: s::INTEGER), truth) GROUP BY ALL""")
def split_class_list(spark, d):
    b = batteries(spark, d).withColumn("classes", C.class_list("battery"))
    return b.where(~F.array_contains("classes", F.col("truth"))).groupBy("battery", "truth").agg(F.count(F.lit(1)).alias("n"))


FAM_SQL = families_sql()


@query("families_overlap", f"""SELECT truth, battery, n, list_has_any({FAM_SQL.format(c='truth')}, {FAM_SQL.format(c='a')})
  OR list_has_any({FAM_SQL.format(c='truth')}, {FAM_SQL.format(c='b')}) AS similar FROM (
  SELECT l_suppkey % 10 AS a, l_partkey % 10 AS b, (l_suppkey % 10) || ',' || (l_partkey % 10) AS battery, CAST(l_orderkey % 10 AS INTEGER) AS truth, count(*) AS n
  FROM lineitem GROUP BY ALL)""")
def families_overlap(spark, d):
    b = batteries(spark, d).groupBy("battery", "truth").agg(F.count(F.lit(1)).alias("n"))
    b = b.withColumns({"_own": V.families("truth"), "_all": F.transform(C.class_list("battery"), lambda c: V.families(c))})
    return b.select("truth", "battery", "n", C.overlaps_any("_own", "_all").alias("similar"))


@query("unordered_pair_key", """WITH pairs AS (SELECT least(l_suppkey % 10, l_partkey % 10) AS lo, greatest(l_suppkey % 10, l_partkey % 10) AS hi, l_discount, l_quantity FROM lineitem),
  keep AS (SELECT lo, hi FROM pairs WHERE lo <> hi GROUP BY ALL HAVING avg(l_discount) < 0.05)
  SELECT lo, hi, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM pairs SEMI JOIN keep USING (lo, hi) GROUP BY ALL""")
def unordered_pair_key(spark, d):
    li = table(spark, d, "lineitem").withColumns({"a": F.col("l_suppkey") % 10, "b": F.col("l_partkey") % 10})
    p = li.select(C.pair_low("a", "b").alias("lo"), C.pair_high("a", "b").alias("hi"), "l_discount", "l_quantity")
    keep = p.where("lo <> hi").groupBy("lo", "hi").agg(F.avg("l_discount").alias("m")).where("m < 0.05").drop("m")
    return p.join(keep, ["lo", "hi"], "left_semi").groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("l_quantity")).alias("quantity"))


@query("days_since", """SELECT o_orderkey AS series_id, CAST(o_orderdate::DATE - min(o_orderdate::DATE) OVER (PARTITION BY o_custkey) AS INTEGER) AS days_since FROM orders""")
def days_since(spark, d):
    return A.days_since(AD.order_bouts(spark, d)).select("series_id", "days_since")


@query("compact_distribution", """SELECT l_returnflag, string_agg(v || ': ' || n, ', ' ORDER BY v) AS distribution FROM (
  SELECT l_returnflag, l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def compact_distribution(spark, d):
    return A.compact_distribution(table(spark, d, "lineitem"), ["l_returnflag"], "l_linenumber")


@query("vertical_angle_measures", using("samples", """, u AS (SELECT series_id, x / n AS x, y / n AS y, z / n AS z FROM (
    SELECT *, sqrt(x * x + y * y + z * z) AS n FROM samples) WHERE n > 0),
  m AS (SELECT series_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM u GROUP BY ALL)
  SELECT series_id, round(avg(x), 6) AS direction, round(stddev_pop(degrees(acos(greatest(-1.0, least(1.0,
    (x * mx + y * my + z * mz) / sqrt(mx * mx + my * my + mz * mz)))))), 6) AS turning_deg FROM u JOIN m USING (series_id) GROUP BY ALL""".replace("\n", " ")))
def vertical_angle_measures(spark, d):
    return rounded(A.angle_measures(AD.samples(spark, d)))


@query("totals", """SELECT figure, found, declared, found = declared AS agrees FROM (
  SELECT unnest(['subjects', 'sessions', 'classes', 'bouts', 'reps']) AS figure, unnest([a, b, c, e, r]) AS found,
         unnest([NULL, NULL, 5, 10000, NULL])::BIGINT AS declared FROM (
    SELECT count(DISTINCT user_id) AS a, count(DISTINCT (user_id, ts::DATE)) AS b, count(DISTINCT event_type) AS c, count(*) AS e,
           CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS r FROM events))""")
def totals(spark, d):
    return A.totals(AD.event_rows(spark, d), {"classes": 5, "bouts": 10000})


@query("subject_coverage", using("event_rows", """SELECT subject, count(DISTINCT session_id) AS sessions, count(DISTINCT period_date) AS days,
  count(*) AS bouts, count(DISTINCT cls) AS classes, CAST(sum(rep_count) AS BIGINT) AS reps, arg_min(cls, (started, series_id)) AS first_cls,
  round(quantile_cont(rep_count / nullif(duration_s, 0), 0.5), 6) AS median_rate FROM event_rows GROUP BY ALL"""))
def subject_coverage(spark, d):
    return rounded(A.subject_coverage(AD.event_rows(spark, d)))


@query("coverage_matrix", using("bouts", "SELECT subject, " + ", ".join(f"count(*) FILTER (cls = '{t}') AS {t}" for t in TYPES)
                                + " FROM bouts WHERE period_order = 1 GROUP BY ALL"))
def coverage_matrix(spark, d):
    return A.coverage_matrix(AD.bouts(spark, d), TYPES)


@query("eligibility", using("bouts", """SELECT *, periods >= 2 AS eligible, periods >= 2 AND first_classes_ge1 = 5 AND later_classes = 5 AS eligible_k1,
  periods >= 2 AND first_classes_ge1 = 5 AND later_classes = 5 AND first_classes_ge2 = 5 AS eligible_k2,
  periods >= 2 AND first_classes_ge1 = 5 AND later_classes = 5 AND first_classes_ge2 = 5 AS in_pool FROM (
  SELECT subject, CAST(max(p) AS BIGINT) AS periods, count(*) FILTER (f >= 1) AS first_classes_ge1, count(*) FILTER (f >= 2) AS first_classes_ge2,
         CAST(sum(l) AS BIGINT) AS later_bouts, count(*) FILTER (l >= 1) AS later_classes, count(*) FILTER (f >= 1 AND l >= 1) AS recurring
  FROM (SELECT subject, cls, max(period_order) AS p, count(*) FILTER (period_order = 1) AS f, count(*) FILTER (period_order > 1) AS l FROM bouts GROUP BY ALL)
  GROUP BY ALL)"""))
def eligibility(spark, d):
    return A.eligibility(AD.bouts(spark, d), len(TYPES))


@query("class_audit", using("event_rows", """, per AS (SELECT cls, subject, count(*) AS sets FROM event_rows GROUP BY ALL),
  c AS (SELECT cls, count(*) AS bouts, CAST(sum(rep_count) AS BIGINT) AS reps, count(DISTINCT subject) AS subjects, count(DISTINCT session_id) AS sessions,
          round(sum(duration_s) / 60, 6) AS minutes, round(quantile_cont(duration_s, 0.5), 6) AS median_duration_s,
          round(quantile_cont(rep_count / nullif(duration_s, 0), 0.5), 6) AS median_rep_rate_hz FROM event_rows GROUP BY ALL),
  s AS (SELECT cls, min(sets) AS sets_min, max(sets) AS sets_max, quantile_cont(sets, 0.5)::DOUBLE AS sets_median FROM per GROUP BY ALL)
  SELECT c.*, sets_min, sets_max, sets_median, round(max(bouts) OVER () / bouts, 6) AS imbalance FROM c JOIN s USING (cls)""".replace("\n", " ")))
def class_audit(spark, d):
    return rounded(A.class_audit(AD.event_rows(spark, d)))


PCT = (1, 5, 25, 50, 75, 95, 99)


@query("describe_percentiles", "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std, "
       "min(l_extendedprice) AS min, max(l_extendedprice) AS max, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 6) AS p{p}" for p in PCT)
       + " FROM lineitem GROUP BY ALL")
def describe_percentiles(spark, d):
    return rounded(A.describe(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", PCT))


@query("describe_sketch", "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std, "
       "min(l_extendedprice) AS min, max(l_extendedprice) AS max, TRUE AS ranks_hold FROM lineitem GROUP BY ALL")
def describe_sketch(spark, d):
    """Percentiles off one sketch per group, and whether the exact rank of each is within its stated error."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    s = A.describe(rows, ["l_returnflag"], "l_extendedprice", PCT, approximate=True)
    share = lambda p: (F.avg((F.col("l_extendedprice") <= F.col(f"p{p}")).cast("double")), F.avg((F.col("l_extendedprice") < F.col(f"p{p}")).cast("double")))
    near = [(share(p)[0] >= p / 100 - 0.02) & (share(p)[1] <= p / 100 + 0.02) for p in PCT]
    held = null_safe_join(rows, s.select("l_returnflag", *[f"p{p}" for p in PCT]), ["l_returnflag"]).groupBy("l_returnflag").agg(functools.reduce(lambda a, b: a & b, near).alias("ranks_hold"))
    return rounded(null_safe_join(s.drop(*[f"p{p}" for p in PCT]), held, ["l_returnflag"]))


@query("period_sketches", """SELECT c_mktsegment, count(*) AS n_rows, TRUE AS orders_hold, TRUE AS customers_hold, TRUE AS median_holds
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""".replace("\n", " "))
def period_sketches(spark, d):
    """Sketches kept by month and segment and merged over all months: distinct counts and medians against exact ones."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    kept = A.period_sketches(o.withColumn("month", F.date_trunc("month", "o_orderdate")), ["c_mktsegment", "month"], "o_totalprice", ["o_orderkey", "o_custkey"])
    path = FI.fresh_path(spark, "sketches")
    kept.write.parquet(path)
    m = A.merged_sketches(spark.read.parquet(path), ["c_mktsegment"], (50,), ["o_orderkey", "o_custkey"])
    exact = o.groupBy("c_mktsegment").agg(F.countDistinct("o_orderkey").alias("e1"), F.countDistinct("o_custkey").alias("e2"))
    j = null_safe_join(m, exact, ["c_mktsegment"])
    r = null_safe_join(o, m.select("c_mktsegment", "p50"), ["c_mktsegment"]).groupBy("c_mktsegment").agg(F.avg((F.col("o_totalprice") <= F.col("p50")).cast("double")).alias("at"))
    near = lambda n, e: F.abs(F.col(n) - F.col(e)) <= 0.05 * F.col(e)
    return null_safe_join(j, r, ["c_mktsegment"]).select(
        "c_mktsegment", "n_rows", near("n_o_orderkey", "e1").alias("orders_hold"), near("n_o_custkey", "e2").alias("customers_hold"), F.col("at").between(0.48, 0.52).alias("median_holds"))


@query("duplicate_scan", """SELECT hash, CAST(sum(n) AS BIGINT) AS copies, count(*) AS owners, min(f) AS first_item FROM (
  SELECT md5(text) AS hash, source, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL) GROUP BY hash HAVING sum(n) > 1""")
def duplicate_scan(spark, d):
    return A.duplicate_scan(table(spark, d, "documents"), F.md5("text"), "source", "doc_id")


@query("shared_demographics", """SELECT c_nationkey, c_mktsegment, CAST(floor(c_acctbal / 10) AS BIGINT) AS balance_band, count(*) AS n_subjects, min(c_custkey) AS first_subject
  FROM customer GROUP BY ALL HAVING count(*) > 1""")
def shared_demographics(spark, d):
    c = table(spark, d, "customer").withColumn("balance_band", F.floor(F.col("c_acctbal") / 10))
    g = c.groupBy("c_nationkey", "c_mktsegment", "balance_band").agg(F.count(F.lit(1)).alias("n_subjects"), F.min("c_custkey").alias("first_subject"))
    return g.where("n_subjects > 1")


@query("scan_table", """SELECT o_orderkey, o_custkey, o_orderdate::DATE AS period_date, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000""")
def scan_table(spark, d):
    o = FI.scan_table(spark, f"{d}/orders.parquet", columns=["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"],
                      where="o_orderstatus = 'F' and o_totalprice > 1000", fmt="parquet")
    return o.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("period_date"), "o_totalprice")


@query("with_run_info", """SELECT o_orderpriority AS cls, count(*) AS n, 7 AS seed, 'r1' AS revision, 30.0::DOUBLE AS fs, 2.0::DOUBLE AS window_s, 0.5::DOUBLE AS overlap FROM orders GROUP BY ALL""")
def with_run_info(spark, d):
    g = AD.order_bouts(spark, d).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    return FI.with_run_info(g, seed=7, revision="r1", fs=30.0, window_s=2.0, overlap=0.5)


@query("write_result", """SELECT o_orderpriority AS cls, o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price FROM orders GROUP BY ALL""")
def write_result(spark, d):
    g = AD.order_bouts(spark, d).groupBy("cls", "status").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("duration_s")).alias("mean_price"))
    path = FI.write_result(g, FI.fresh_path(spark, "result"), fmt="csv.gz")
    return FI.scan_table(spark, path, schema="cls string, status string, n bigint, mean_price double", fmt="csv")


SCAN_SQL = using("samples", """SELECT 'u' || ((epoch_us(ts) // 1000) // 86400000) || '_2024_' || strftime(ts, '%m%d') || '_000000_segment01_' || lpad(length(event_type)::VARCHAR, 2, '0') AS stem,
  count(*) AS n_samples, min((epoch_us(ts) // 1000)) AS t_first, max((epoch_us(ts) // 1000)) AS t_last, round(sum(value), 6) AS sum_x FROM events WHERE value >= 0.5 GROUP BY ALL""")


def sample_files(spark, d):
    """Write the events as header-less sample files, one folder per day and class, with side files."""
    e = table(spark, d, "events").withColumn("t_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    stem = F.concat(F.lit("u"), F.floor(F.col("t_ms") / 86400000).cast("string"), F.lit("_2024_"), F.date_format("ts", "MMdd"),
                    F.lit("_000000_segment01_"), F.lpad(F.length("event_type").cast("string"), 2, "0"))
    rows = e.select(stem.alias("stem"), F.when(F.col("value") < 0.5, 2).otherwise(1).alias("row"), "t_ms", F.col("value").alias("x"),
                    F.get_json_object("props", "$.k").cast("double").alias("y"), F.hour("ts").cast("double").alias("z"))
    path = FI.fresh_path(spark, "samples")
    FI.write_samples(rows, path)
    return path, rows


@query("scan_samples", SCAN_SQL)
def scan_samples(spark, d):
    path, _ = sample_files(spark, d)
    s = FI.scan_samples(spark, path)
    return s.groupBy("stem").agg(F.count(F.lit(1)).alias("n_samples"), F.min("t_ms").alias("t_first"), F.max("t_ms").alias("t_last"),
                                 r6(F.sum("x")).alias("sum_x"))


@query("attach_sidecar", SCAN_SQL.replace("SELECT 'u'", "SELECT *, CASE WHEN n_samples % 2 = 0 THEN n_samples / 2.0::DOUBLE END AS weight_kg, TRUE AS class_agrees, 7 AS reps FROM (SELECT 'u'").replace(
    "GROUP BY ALL", "GROUP BY ALL)"))
def attach_sidecar(spark, d):
    path, rows = sample_files(spark, d)
    per = rows.where("row = 1").groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
    weight = F.when(F.col("n") % 2 == 0, (F.col("n") / 2).cast("string")).otherwise("n/a")
    info = per.select("stem", F.concat(
        F.lit("nick,12,f,1990,"), weight, F.lit(",170\n"), F.substring("stem", -2, 2).cast("int").cast("string"), F.lit(",NAME,7")).alias("value"))
    side = FI.fresh_path(spark, "info")
    FI.write_sidecars(info, side)
    s = FI.scan_samples(spark, path).groupBy("stem").agg(
        F.count(F.lit(1)).alias("n_samples"), F.min("t_ms").alias("t_first"), F.max("t_ms").alias("t_last"), r6(F.sum("x")).alias("sum_x"))
    return FI.attach_sidecar(s, FI.scan_sidecars(spark, side)).select(
        "stem", "n_samples", "t_first", "t_last", "sum_x", "weight_kg", "class_agrees", "reps")


@query("materialize", using("wmeasures", "SELECT mi, count(*) AS n, round(avg(m), 6) AS mean FROM wmeasures GROUP BY ALL"))
def materialize(spark, d):
    from seriesloom.plans.experiment import cohort_windows
    from seriesloom.session import materialize as keep

    w = keep(lambda: cohort_windows(spark, d), spark, ("windows", d, 1.0, 0.75))
    return rounded(w.select(F.posexplode("m").alias("mi", "m")).groupBy("mi").agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean")))
