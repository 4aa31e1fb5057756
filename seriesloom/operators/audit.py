"""Recording quality, coverage and eligibility of a cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import vocabulary as V
from seriesloom.functions.columns import exclude_reason
from seriesloom.functions.ordering import null_safe_join, quantiles, split_enumerate, split_quantiles


def parse_series_name(df: DataFrame, name: str = "name") -> DataFrame:
    """Split '<nick>_<yyyy>_<mmdd>_<hhmmss>_segment<NN>_<class>' into columns; ``matched`` is false for other names."""
    part = [F.regexp_extract(name, V.SERIES_NAME, i) for i in range(1, 7)]
    ok = F.col(name).rlike(V.SERIES_NAME)
    day = F.concat_ws("-", part[1], F.substring(part[2], 1, 2), F.substring(part[2], 3, 2))
    fields = {"nick": part[0], "session_id": F.concat_ws("_", *part[:4]), "period_date": day.try_cast("date"),
              "session_time": part[3], "set_order": part[4].try_cast("int"), "cls": part[5].try_cast("int")}
    return df.withColumn("matched", ok).withColumns({k: F.when(ok, v) for k, v in fields.items()})


def flag_exclusions(df: DataFrame, rep_count: str = "rep_count", error: str = "error") -> DataFrame:
    d = df.withColumn("exclude_reason", exclude_reason(rep_count, error))
    return d.withColumn("include", F.col("exclude_reason") == "")


def series_quality(samples: DataFrame, order: Sequence[str], piece: Column) -> DataFrame:
    """Per series: size, duration, rate, share of repeated stamps, largest gap and the list of problems.

    ``samples`` has (series_id, row, t_ms, x, y, z) and the order columns.
    """
    d = split_enumerate(samples, ["series_id"], order, piece, ["t_ms"], "t_ms")
    dt = F.col("t_ms") - F.col("prev_t_ms")
    missing = F.col("t_ms").isNull() | F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()
    q = d.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_samples"), F.max("first_t_ms").alias("_t0"), F.max("last_t_ms").alias("_t1"),
        F.avg((dt == 0).cast("double")).alias("frac_shared_ts"), F.coalesce(F.max(dt), F.lit(0)).alias("max_gap_ms"),
        F.max(missing).alias("_missing"), F.max(F.col("row") != 1).alias("_other"), F.max(dt < 0).alias("_back"))
    dur = (F.col("_t1") - F.col("_t0")) / F.lit(1000.0)
    q = q.withColumn("duration_s", dur)
    problems = F.concat_ws("; ", F.when(F.col("_missing"), "missing values"), F.when(F.col("_other"), "non-sensor rows"),
                           F.when(F.col("_back"), "timestamps go backwards"),
                           F.when(~(F.col("duration_s") > 0), "zero duration"))
    rate = F.when(F.col("duration_s") > 0, (F.col("n_samples") - 1) / F.col("duration_s"))
    return q.withColumns({"rate_hz": rate, "error": problems}).drop("_t0", "_t1", "_missing", "_other", "_back")


def derive_rates(df: DataFrame) -> DataFrame:
    return df.withColumn("rep_rate_hz", F.try_divide(F.col("rep_count"), F.col("duration_s")))


def compact_distribution(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """'value: count, ...' in value order, for a column with few distinct values."""
    n = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(col).alias("v"), "n")))
    return n.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: F.format_string("%s: %d", p["v"].cast("string"), p["n"])), ", ").alias("distribution"))


def totals(bouts: DataFrame, declared: dict[str, int]) -> DataFrame:
    """Found totals against declared ones, one row per figure."""
    one = bouts.agg(F.countDistinct("subject").alias("subjects"), F.countDistinct("session_id").alias("sessions"),
                    F.countDistinct("cls").alias("classes"), F.count(F.lit(1)).alias("bouts"), F.sum("rep_count").alias("reps"))
    names = ["subjects", "sessions", "classes", "bouts", "reps"]
    rows = F.array(*[F.struct(F.lit(n).alias("figure"), F.col(n).cast("bigint").alias("found"),
                              F.lit(declared.get(n)).cast("bigint").alias("declared")) for n in names])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("agrees", F.col("found") == F.col("declared"))


def subject_coverage(bouts: DataFrame) -> DataFrame:
    """Per subject: sessions, periods, bouts, classes, reps, first class recorded, median repetition rate."""
    c = bouts.groupBy("subject").agg(
        F.countDistinct("session_id").alias("sessions"), F.countDistinct("period_date").alias("days"),
        F.count(F.lit(1)).alias("bouts"), F.countDistinct("cls").alias("classes"), F.sum("rep_count").alias("reps"),
        F.min_by("cls", F.struct("started", "series_id")).alias("first_cls"))
    med = split_quantiles(derive_rates(bouts), ["subject"], "rep_rate_hz", {"median_rate": 0.5})
    return null_safe_join(c, med, ["subject"], "left")


def coverage_matrix(bouts: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Subject x class counts of first-period series, complete columns, zeros filled."""
    return (bouts.where("period_order = 1").groupBy("subject").pivot("cls", list(classes))
            .agg(F.count(F.lit(1))).na.fill(0))


def eligibility(bouts: DataFrame, n_classes: int) -> DataFrame:
    """Who can enter the pool: periods, classes on the first one and later, classes that recur, pool flags.

    The first aggregation has one row per subject and class; everything else works on those.
    """
    per = bouts.groupBy("subject", "cls").agg(
        F.sum((F.col("period_order") == 1).cast("int")).alias("first"), F.sum((F.col("period_order") > 1).cast("int")).alias("later"),
        F.max("period_order").alias("p"))
    n = lambda cond: F.sum(cond.cast("int")).cast("bigint")
    e = per.groupBy("subject").agg(
        F.max("p").cast("bigint").alias("periods"), n(F.col("first") >= 1).alias("first_classes_ge1"),
        n(F.col("first") >= 2).alias("first_classes_ge2"), F.sum("later").alias("later_bouts"), n(F.col("later") >= 1).alias("later_classes"),
        n((F.col("first") >= 1) & (F.col("later") >= 1)).alias("recurring"))
    full = F.lit(n_classes)
    e = e.withColumn("eligible", F.col("periods") >= 2)
    e = e.withColumn("eligible_k1", F.col("eligible") & (F.col("first_classes_ge1") == full) & (F.col("later_classes") == full))
    return e.withColumn("eligible_k2", F.col("eligible_k1") & (F.col("first_classes_ge2") == full)).withColumn("in_pool", F.col("eligible_k2"))


def class_audit(bouts: DataFrame) -> DataFrame:
    """Per class, NULL included: size, subjects, sessions, minutes, medians, spread of sets per subject, imbalance."""
    c = bouts.groupBy("cls").agg(
        F.count(F.lit(1)).alias("bouts"), F.sum("rep_count").alias("reps"), F.countDistinct("subject").alias("subjects"),
        F.countDistinct("session_id").alias("sessions"), (F.sum("duration_s") / 60).alias("minutes"))
    per = bouts.groupBy("cls", "subject").agg(F.count(F.lit(1)).alias("sets"))
    spread = per.groupBy("cls").agg(F.min("sets").alias("sets_min"), F.max("sets").alias("sets_max"))
    med = quantiles(derive_rates(bouts), ["cls"], {"median_duration_s": ("duration_s", 0.5), "median_rep_rate_hz": ("rep_rate_hz", 0.5)})
    spread = null_safe_join(null_safe_join(spread, med, ["cls"]), split_quantiles(per, ["cls"], "sets", {"sets_median": 0.5}), ["cls"])
    most = Window.partitionBy(F.lit(0))  # one row per class at this point
    return null_safe_join(c, spread, ["cls"]).withColumn("imbalance", F.max("bouts").over(most) / F.col("bouts"))


def describe(df: DataFrame, keys: Sequence[str], value: str,
             percents: Sequence[int] = (1, 5, 25, 50, 75, 95, 99), approximate: bool = False) -> DataFrame:
    """count, mean, sample SD, min, max and percentiles per group, NULL keys a group; exact unless asked otherwise.

    The approximate form reads all percentiles off one mergeable sketch per group.
    """
    aggs = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]
    if approximate:
        sketched = df.groupBy(*keys).agg(*aggs, F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_K).alias("_q"))
        return sketched.select(*keys, "n", "mean", "std", "min", "max", *percentiles_of("_q", percents))
    m, q = df.groupBy(*keys).agg(*aggs), split_quantiles(df, keys, value, {f"p{p}": p / 100 for p in percents})
    return null_safe_join(m, q, keys) if keys else m.withColumns({f"p{p}": q.select(f"p{p}").scalar() for p in percents})


#: Sizes of the sketches: ranks within about 0.7 % at k = 400, distinct counts within about 2.3 % (one SD 1.6 % at 12 bits).
SKETCH_K, SKETCH_BITS = 400, 12


def percentiles_of(sketch: str, percents: Sequence[int]) -> list[Column]:
    """Columns p<percent> read off a quantile sketch; NULL where it holds no value."""
    some = F.kll_sketch_get_n_double(sketch) > 0
    return [F.when(some, F.kll_sketch_get_quantile_double(sketch, F.lit(p / 100))).alias(f"p{p}") for p in percents]


def period_sketches(df: DataFrame, keys: Sequence[str], value: str | None = None, distinct: Sequence[str] = ()) -> DataFrame:
    """One row per key (a period, say): rows, a quantile sketch of ``value``, and a distinct-count sketch of each of ``distinct``.

    Kept as a table, the rows of any range of keys merge into its summary without another look at the data.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if value:
        aggs.append(F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_K).alias("quantiles"))
    return df.groupBy(*keys).agg(*aggs, *[F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_BITS).alias(f"distinct_{c}") for c in distinct])


def merged_sketches(sketches: DataFrame, keys: Sequence[str] = (), percents: Sequence[int] = (), distinct: Sequence[str] = ()) -> DataFrame:
    """Rows of ``period_sketches`` merged by ``keys``: n_rows, percentiles, and n_<column> distinct values."""
    aggs = [F.sum("n_rows").alias("n_rows")] + ([F.kll_merge_agg_double("quantiles").alias("_q")] if percents else [])
    d = sketches.groupBy(*keys).agg(*aggs, *[F.hll_union_agg(f"distinct_{c}").alias(f"_d_{c}") for c in distinct])
    return d.select(*keys, "n_rows", *percentiles_of("_q", percents), *[F.hll_sketch_estimate(f"_d_{c}").alias(f"n_{c}") for c in distinct])


def duplicate_scan(df: DataFrame, content: Column, owner: str, item: str) -> DataFrame:
    """Contents that occur more than once: copies, owners and the first item, never the list of copies.

    Copies collapse map-side by (hash, owner), so a content that makes up much of the table stays small.
    """
    per = df.select(content.alias("hash"), owner, item).groupBy("hash", owner).agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first_item"))
    return (per.groupBy("hash").agg(F.sum("n").alias("copies"), F.count(F.lit(1)).alias("owners"), F.min("first_item").alias("first_item"))
            .where("copies > 1"))


def days_since(rows: DataFrame) -> DataFrame:
    """Days from the subject's first date."""
    first = rows.groupBy("subject").agg(F.min("period_date").alias("baseline"))
    return rows.join(first, "subject").withColumn("days_since", F.datediff("period_date", "baseline"))


def angle_measures(samples: DataFrame) -> DataFrame:
    """Mean of the unit vector's x component, and SD in degrees of the angle to the mean direction.

    Two aggregations per series: the mean direction first, the angles against it second.
    """
    norm = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    u = samples.withColumn("_n", norm).where("_n > 0").select("series_id", *[(F.col(c) / F.col("_n")).alias(c) for c in "xyz"])
    m = u.groupBy("series_id").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    m = m.withColumn("_l", F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz")))
    d = u.join(m, "series_id")
    cos = F.try_divide(F.col("x") * F.col("mx") + F.col("y") * F.col("my") + F.col("z") * F.col("mz"), F.col("_l"))
    angle = F.degrees(F.acos(F.when(cos.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))
    return d.groupBy("series_id").agg(F.avg("x").alias("direction"), F.stddev_pop(angle).alias("turning_deg"))
