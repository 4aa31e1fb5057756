"""Top-k style selections and set operations."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from seriesloom.functions.ordering import null_safe_join, split_rank, value_ranks
from seriesloom.session import local_table

STEPS, FETCHED = 128, 100_000  # of ``nth_values``: parts of a range, and distinct values that end the search


def top_fraction_per_class(calls: DataFrame, keys: Sequence[str], fraction: float) -> DataFrame:
    """ceil(fraction * n) most confident rows per predicted class, ties by series id.

    Distinct confidences are ranked first, then the rows of an equal confidence by stretches of ids, so a
    class or a single confidence may hold any share of the rows.
    """
    g = [*keys, "pred"]
    d = calls.withColumn("_low", -F.col("conf"))
    r = value_ranks(d, g, "_low").select(*g, "_low", "n_before", "n_total")
    need = F.ceil(F.lit(float(fraction)) * F.col("n_total"))
    d = null_safe_join(d, r, [*g, "_low"]).where(F.col("n_before") < need)
    d = split_rank(d, [*g, "_low"], [F.col("series_id")], _id_piece(calls), "_tie")
    return d.where(F.col("n_before") + F.col("_tie") <= need).drop("_low", "n_before", "n_total", "_tie")


def _id_piece(rows: DataFrame) -> Column:
    """Stretch of ids, numbers or not."""
    number = dict(rows.dtypes)["series_id"] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    return F.floor(F.col("series_id") / 100_000) if number else F.substring(F.col("series_id").cast("string"), 1, 6)


def top_fraction_of_table(calls: DataFrame, keys: Sequence[str], fraction: float) -> DataFrame:
    """``top_fraction_per_class`` of a written table with few groups: the last confidence taken is found by ``nth_values``.

    Rows above it are taken where they are; only those that equal it are ranked.
    """
    g = [*keys, "pred"]
    need = lambda n: math.ceil(float(fraction) * n)
    d = calls.withColumn("_low", -F.col("conf").cast("double"))
    last = nth_values(d, g, "_low", {"cut": lambda n: min(need(n), n) - 1})
    rows = [(*k, f["cut"], need(f["n"]) - f["cut_before"]) for k, f in last.items() if f["cut"] is not None]
    cuts = local_table(calls.sparkSession, rows, StructType([*[calls.schema[c] for c in g], StructField("_cut", DoubleType()), StructField("_room", LongType())]))
    d = null_safe_join(d, F.broadcast(cuts), g)  # a row for each group
    edge = split_rank(d.where("_low = _cut"), g, [F.col("series_id")], _id_piece(calls), "_tie").where("_tie <= _room")
    return d.where("_low < _cut").select(*calls.columns).unionByName(edge.select(*calls.columns))


def nth_values(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, Callable[[int], int]], extra: dict[str, Column] | None = None,
               steps: int = STEPS, fetched: int = FETCHED) -> dict[tuple, dict]:
    """Per group the values at 0-based places of the rising order (NULLs left out), exact, without sorting or moving rows.

    ``df`` is a table, as it is read a few times, with few groups (the design bounds them): each has some numbers on the
    driver. ``wanted`` gives each name's place from the number ``n`` of values. A job counts the rows in ``steps`` equal
    steps of the range that holds a place, and the step that holds it is the next range, until at most ``fetched`` distinct
    values can be left in all. A range's ends are steps of their own, so that any values, NaN (the largest) and infinite ones too,
    come to an end. Returns by key ``n``, each name's value and ``<name>_before`` (smaller values), both None
    where there is no such place, and the aggregates ``extra``.
    """
    v = F.col("_v")
    d = df.withColumn("_v", F.col(value).cast("double"))
    ends = d.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), *[c.alias(k) for k, c in (extra or {}).items()]).collect()
    found = {tuple(r[k] for k in keys): {"n": r["n"], **{c: None for name in wanted for c in (name, f"{name}_before")}, **{k: r[k] for k in extra or {}}} for r in ends}
    # the places of a range: (group, least, largest, smaller values, values) -> (name, place)
    ranges: dict[tuple, list] = {}
    for r in ends:
        key = tuple(r[k] for k in keys)
        for name, place in wanted.items():
            if 0 <= place(r["n"]) < r["n"]:
                ranges.setdefault((key, r["_lo"], r["_hi"], 0, r["n"]), []).append((name, place(r["n"])))
    types = StructType([*[df.schema[k] for k in keys], StructField("_id", LongType()), StructField("_lo", DoubleType()), StructField("_hi", DoubleType())])
    while True:
        for at in [at for at in ranges if at[1] == at[2] or at[1] != at[1]]:  # a single value
            for name, _ in ranges.pop(at):
                found[at[0]] |= {name: at[1], f"{name}_before": at[3]}
        if not ranges:
            return found
        order = list(ranges)
        table = local_table(df.sparkSession, [(*key, i, lo, hi) for i, (key, lo, hi, _, _) in enumerate(order)], types)
        near = null_safe_join(d.select(*keys, "_v").where("_v is not null"), F.broadcast(table), keys).where((v >= F.col("_lo")) & (v <= F.col("_hi")))
        if sum(at[4] for at in order) <= fetched:
            parts = near.groupBy("_id", "_v").agg(F.count(F.lit(1)).alias("k")).select("_id", "k", v.alias("lo"), v.alias("hi")).collect()
        else:
            width = F.col("_hi") - F.col("_lo")
            step = F.when((width > 0) & (width < float("inf")), F.least(F.floor(F.try_divide(v - F.col("_lo"), width) * steps), F.lit(steps - 1))).otherwise(F.lit(0))
            step = F.when(v == F.col("_lo"), F.lit(-1)).when(v == F.col("_hi"), F.lit(steps)).otherwise(step)
            parts = near.groupBy("_id", step.alias("_step")).agg(F.count(F.lit(1)).alias("k"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect()
        by_range: dict[int, list] = {}
        for r in sorted(parts, key=lambda r: (r["lo"] != r["lo"], r["lo"])):
            by_range.setdefault(r["_id"], []).append((r["lo"], r["hi"], r["k"]))
        narrower: dict[tuple, list] = {}
        for i, at in enumerate(order):
            to = list(accumulate(k for _, _, k in by_range[i]))
            for name, place in ranges[at]:
                j = bisect_right(to, place - at[3])
                lo, hi, k = by_range[i][j]
                narrower.setdefault((at[0], lo, hi, at[3] + to[j] - k, k), []).append((name, place))
        ranges = narrower


def select_pairs(pairs: DataFrame, bands: dict[str, tuple[float, float]], score: str = "balanced_acc", picks: int = 3) -> DataFrame:
    """Per band: same-family first, then closest to the centre, then more data; short bands are filled from outside.

    The pair table has one row per class pair, so its per-band ranking is small by construction.
    """
    d = pairs.withColumn("min_n", F.least("n_a", "n_b"))
    edges = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for b, (lo, hi) in bands.items()])
    d = d.select("*", F.explode(edges).alias("_b")).select("*", "_b.band", "_b.lo", "_b.hi").drop("_b")
    s = F.col(score)
    d = d.withColumns({"in_band": (s >= F.col("lo")) & (s < F.col("hi")),
                       "dist": F.abs(s - (F.col("lo") + F.least(F.col("hi"), F.lit(1.0))) / 2),
                       "_near": F.least(F.abs(s - F.col("lo")), F.abs(s - F.col("hi")))})
    order = [F.col("in_band").desc(), F.when(F.col("in_band"), F.col("same_family")).desc(), F.when(F.col("in_band"), F.col("dist")),
             F.when(F.col("in_band"), F.col("min_n")).desc(), F.when(~F.col("in_band"), F.col("_near")), F.col("class_a"), F.col("class_b")]
    r = d.withColumn("pick", F.row_number().over(Window.partitionBy("band").orderBy(*order))).where(F.col("pick") <= picks)
    return r.select("band", "pick", "class_a", "class_b", score, "in_band", "same_family", "min_n")


def first_per_group(rows: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """First row of each group in a fixed order, by an aggregate with map-side partials (no sort)."""
    first = F.min_by(F.struct(*cols), F.struct(*order))
    return rows.groupBy(key).agg(first.alias("_f")).select(key, "_f.*")


def first_known(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The first value of each column that is not NULL, per group in a fixed order: what a subject stated first."""
    return rows.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in cols])


def union_runs(runs: dict[str, DataFrame], label: str) -> DataFrame:
    """Stack result tables by column name, missing columns as NULL, with the run's name."""
    out = None
    for name, d in runs.items():
        d = d.withColumn(label, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def worst_subject(scores: DataFrame, keys: Sequence[str], value: str, threshold: float) -> DataFrame:
    """Subject with the lowest score per condition, and how many lie below a threshold."""
    low = F.min(F.struct(F.col(value).alias("v"), F.col("subject").alias("s")))
    return scores.groupBy(*keys).agg(low.alias("_l"), F.count_if(F.col(value) < threshold).alias("n_below"), F.count(F.lit(1)).alias("n")).select(
        *keys, F.col("_l.s").alias("worst_subject"), F.col("_l.v").alias("worst_score"), "n_below", "n")
