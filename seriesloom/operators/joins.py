"""Join patterns: completeness-checked lookups, reconciliation, grids, class pairs, score bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.hashing import draw_bucket, draw_key
from seriesloom.functions.ordering import null_safe_join, split_rank, value_ranks


def join_baseline(rows: DataFrame, baseline: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Left join of a baseline value; rows without one keep NULL so that the caller can count them."""
    return rows.join(baseline.select(*keys, F.col(value).alias(name)), list(keys), "left")


def completeness(rows: DataFrame, name: str) -> DataFrame:
    """How many rows found their baseline."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count(name).alias("n_matched"), (F.count(F.lit(1)) - F.count(name)).alias("n_missing"))


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Full-outer comparison: matched and one-sided rows, largest absolute difference, verdict; NULL keys match each other."""
    left, right = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_ina")), b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_inb"))
    j = null_safe_join(left, right, keys, "full")
    one = j.agg(F.count(F.when(F.col("_ina").isNotNull() & F.col("_inb").isNotNull(), 1)).alias("matched"),
                F.count(F.when(F.col("_inb").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("_ina").isNull(), 1)).alias("only_right"),
                F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_diff"))
    same = (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.coalesce("max_abs_diff", F.lit(0.0)) < tolerance)
    return one.withColumn("agrees", same)


def condition_grid(spark: SparkSession, axes: dict[str, Sequence], feasible: Column | None = None) -> DataFrame:
    """All combinations of parameter values (literal arrays, exploded); infeasible ones stay, flagged."""
    d = spark.range(1)
    for name, values in axes.items():
        d = d.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    d = d.drop("id")
    return d.withColumn("feasible", feasible if feasible is not None else F.lit(True))


def class_pairs(rows: DataFrame, min_subjects: int) -> DataFrame:
    """Unordered pairs a < b of classes that have enough subjects, for any number of classes.

    The class table (one row per class) is numbered; each class emits the numbers below its own, and these
    are joined back.
    """
    c = rows.groupBy("cls").agg(F.countDistinct("subject").alias("n")).where((F.col("n") >= min_subjects) & F.col("cls").isNotNull())
    c = c.withColumns({"_all": F.lit(0), "_o": draw_key(0, "cls")})
    c = split_rank(c, ["_all"], [F.col("_o"), F.col("cls")], draw_bucket(F.col("_o"), 2), "_j").select("cls", "n", "_j")
    other = c.select(F.col("_j").alias("_i"), F.struct("cls", "n").alias("_p"))
    pair = c.where("_j > 1").select(F.struct("cls", "n").alias("_q"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_j") - 1)).alias("_i"))
    both = pair.join(other, "_i").select(F.least("_p", "_q").alias("a"), F.greatest("_p", "_q").alias("b"))
    return both.select(F.col("a.cls").alias("class_a"), F.col("b.cls").alias("class_b"), F.col("a.n").alias("n_subjects_a"), F.col("b.n").alias("n_subjects_b"))


def band_join(rows: DataFrame, score: str, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Half-open score bands [lo, hi) attached to each row (a parameter list, exploded where it fits)."""
    table = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for n, (lo, hi) in bands.items()])
    fits = F.filter(table, lambda b: (F.col(score) >= b["lo"]) & (F.col(score) < b["hi"]))
    return rows.select("*", F.explode(fits).alias("_b")).select("*", "_b.band", "_b.lo", "_b.hi").drop("_b")


def interval_join(rows: DataFrame, value: str, bands: DataFrame, lo: str, hi: str, keys: Sequence[str] = (), width: Column | float | None = None,
                  crowd: int = 100_000, how: str = "inner") -> DataFrame:
    """Rows with all half-open intervals [lo, hi) of a table that hold ``value``, among those of equal ``keys`` (NULL equals NULL).

    The line is cut into bins of ``width`` (the mean length of the intervals, unless given). An interval stands in
    every bin that it covers, a row in one, and pairs of a bin are checked exactly: an equi-join whose size follows
    the result. Bins with more than ``crowd`` rows are dealt into parts by a hash of the row, and the intervals there
    go to all of them. Intervals may overlap. NULL or empty intervals hold nothing, NULL values lie in none; with
    ``how="left"`` their rows stay.
    """
    if width is None:
        width = bands.agg(F.avg(F.when(F.col(hi) > F.col(lo), (F.col(hi) - F.col(lo)).cast("double"))).alias("w")).scalar()
    width = F.coalesce(F.lit(width) if isinstance(width, (int, float)) else width, F.lit(1.0))
    bin_of = lambda c: F.floor(F.col(c).cast("double") / width)
    b = bands.where(F.col(hi) > F.col(lo)).withColumn("_bin", F.explode(F.sequence(bin_of(lo), bin_of(hi))))
    d = rows.withColumn("_bin", bin_of(value))
    at = [*keys, "_bin"]
    crowded = d.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).select(*at, F.ceil(F.col("_n") / crowd).cast("int").alias("_parts"))
    parts = lambda df: null_safe_join(df, crowded, at, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    d = parts(d).withColumn("_part", F.pmod(F.xxhash64(*rows.columns, F.monotonically_increasing_id()), "_parts").cast("int")).drop("_parts")
    b = parts(b).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    names = {c: f"_k_{c}" for c in (*keys, "_bin", "_part")}
    b = b.withColumnsRenamed(names)
    on = (F.col(value) >= F.col(lo)) & (F.col(value) < F.col(hi))
    for c, n in names.items():
        on = on & F.col(c).eqNullSafe(F.col(n))
    return d.join(b, on, how).drop(*names.values(), "_bin", "_part")


#: Values are added up as decimals of this type, so a difference of two running totals is exact, whatever lies before the interval.
EXACT = "decimal(28,8)"


def interval_sums(rows: DataFrame, value: str, bands: DataFrame, lo: str, hi: str, sums: dict[str, str], keys: Sequence[str] = (),
                  count: str = "n_rows") -> DataFrame:
    """Intervals [lo, hi) that hold rows, with the number of these and the sums of columns (name -> column) over them.

    What ``interval_join`` and a grouping by interval return, without its pairs: rows and ends of intervals are ordered
    once, in pieces, and an interval takes the difference of the totals before its two ends. Work and exchange follow rows
    plus intervals, however many rows an interval holds. NULL values do not count, NULL or empty intervals hold nothing,
    NULL keys match each other. Sums are taken over ``EXACT`` decimals (a value beyond them is an error) and returned as doubles,
    NULL without a value.
    """
    types = {dict(rows.dtypes)[value], dict(bands.dtypes)[lo], dict(bands.dtypes)[hi]}
    kind = types.pop() if len(types) == 1 else "double"
    rows = rows.where(~F.isnan(F.col(value).cast("double")))  # NaN lies below no end
    held = {name: F.col(c).cast(EXACT) for name, c in sums.items()}
    points = rows.select(*keys, F.col(value).cast(kind).alias("_v"), F.lit(1).alias("_n"), F.lit(0).alias("_end"),
                         *[x for n, c in held.items() for x in (c.alias(f"_s_{n}"), c.isNotNull().cast("int").alias(f"_c_{n}"))])
    valid = bands.where(F.col(hi) > F.col(lo))
    ends = valid.select(*keys, F.explode(F.array(F.col(lo).cast(kind), F.col(hi).cast(kind))).alias("_v"), F.lit(0).alias("_n"), F.lit(1).alias("_end"),
                        *[x for n in sums for x in (F.lit(0).cast(EXACT).alias(f"_s_{n}"), F.lit(0).alias(f"_c_{n}"))])
    totals = ["_n", *[f"_{t}_{n}" for n in sums for t in "sc"]]
    extra = {f"_t{c}": F.coalesce(F.sum(c), F.lit(0)) for c in totals} | {"_met": F.max("_end")}
    ranked = value_ranks(points.unionByName(ends), keys, "_v", extra, running=[f"_t{c}" for c in totals]).where("_met = 1")
    before = ranked.select(*keys, "_v", F.struct(*[F.col(f"_t{c}_before").alias(c) for c in totals]).alias("_b"))
    d = valid
    for end, name in ((lo, "_from"), (hi, "_to")):
        d = null_safe_join(d.withColumn("_v", F.col(end).cast(kind)), before.withColumnRenamed("_b", name), [*keys, "_v"]).drop("_v")
    part = lambda c: F.col("_to")[c] - F.col("_from")[c]
    each = {count: part("_n")} | {n: F.when(part(f"_c_{n}") > 0, part(f"_s_{n}").cast("double")) for n in sums}
    return d.withColumns(each).where(F.col(count) > 0).drop("_from", "_to")
