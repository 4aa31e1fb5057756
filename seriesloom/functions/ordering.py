"""Ordered operators that never need a large group in one task.

A group (series, subject, class) may hold a large share of all rows, so a plain
``Window.partitionBy(group)`` would put it in one task. Each function here splits groups into pieces that
keep the order (a stretch of time, leading digits of a hash, a range of values), works inside the pieces,
and carries only one summary row per piece across their edges. There is one form for every size, and it
treats NULL keys, pieces and values like a plain window does. Nothing runs while a plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE_ROWS = 100_000  # distinct values of a group that share a piece, about
MAX_PIECES = 256


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys``, NULL being equal to NULL; the keys come from ``left``."""
    r = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = same if on is None else on & same
    return left.join(r, on, how).drop(*[f"_k_{k}" for k in keys])


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per group with their rank; Spark keeps k rows per group map-side (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def split_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], piece: Column, name: str = "rank") -> DataFrame:
    """1-based row number per group; ``piece`` must be non-decreasing along ``order``."""
    parts = [*keys, "_piece"]
    d = df.withColumn("_piece", piece)
    sizes = d.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*parts).orderBy(*order)))
    out = null_safe_join(local, offsets, parts).withColumn(name, (F.col("_rn") + F.col("_off")).cast("bigint"))
    return out.drop("_piece", "_rn", "_off")


def split_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: Column, cols: Sequence[str],
              prefix: str = "prev_") -> DataFrame:
    """Previous row's values per group, also across the edges of the pieces."""
    parts = [*keys, "_piece"]
    d = df.withColumn("_piece", piece).withColumn("_v", F.struct(*cols))
    here = Window.partitionBy(*parts).orderBy(*order)
    local = d.withColumns({"_p": F.lag("_v").over(here), "_end": F.lead(F.lit(1)).over(here).isNull()})
    # the last row of each piece, off the same shuffle
    edges = local.where("_end").select(*parts, F.lag("_v").over(Window.partitionBy(*keys).orderBy("_piece")).alias("_edge"))
    out = null_safe_join(local, edges, parts).withColumn("_p", F.coalesce("_p", "_edge"))
    return (out.withColumns({prefix + c: F.col("_p")[c] for c in cols})
            .drop("_piece", "_v", "_p", "_edge", "_end"))


def split_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], piece: Column, col: str, name: str) -> DataFrame:
    """The last value of ``col`` that is not NULL, up to and including the row, per group and also across the pieces.

    ``piece`` must be non-decreasing along ``order``; one row per piece is carried on.
    """
    parts = [*keys, "_piece"]
    here = Window.partitionBy(*parts).orderBy(*order)
    local = df.withColumn("_piece", piece).withColumns({
        "_l": F.last(col, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)), "_end": F.lead(F.lit(1)).over(here).isNull()})
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    edges = local.where("_end").select(*parts, F.last("_l", ignorenulls=True).over(before).alias("_edge"))
    return null_safe_join(local, edges, parts).withColumn(name, F.coalesce("_l", "_edge")).drop("_piece", "_l", "_end", "_edge")


def split_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: Column,
                      cols: Sequence[str], prefix: str = "run_") -> DataFrame:
    """Running totals per group, carried over the pieces."""
    parts = [*keys, "_piece"]
    d = df.withColumn("_piece", piece)
    sums = d.groupBy(*parts).agg(*[F.sum(c).alias(f"_s_{c}") for c in cols])
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*parts, *[F.sum(f"_s_{c}").over(before).alias(f"_c_{c}") for c in cols])
    here = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumns({f"_r_{c}": F.sum(c).over(here) for c in cols})
    # a total is NULL only as long as no value has come
    both = {prefix + c: F.coalesce(F.col(f"_c_{c}") + F.col(f"_r_{c}"), f"_c_{c}", f"_r_{c}") for c in cols}
    return null_safe_join(local, carried, parts).withColumns(both).drop("_piece", *[f"_r_{c}" for c in cols], *[f"_c_{c}" for c in cols])


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, extra: dict[str, Column] | None = None,
                keep_null: bool = False, piece_rows: int = PIECE_ROWS, running: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct value: ``n`` rows with it, ``n_before`` smaller ones, ``n_total`` in the group.

    Equal values are counted map-side first. A group is cut at approximate quantiles into pieces of about
    ``piece_rows`` distinct values, at most ``MAX_PIECES``; this only steers the split, the ranks are exact.
    ``extra`` adds aggregates per distinct value; of those named in ``running``, counts as well, the sum over smaller
    values (``<name>_before``) and over the group (``<name>_total``) come along. NULL values are left out, or kept as values that count 0 rows.
    """
    d = df if keep_null else df.where(F.col(value).isNotNull())
    d = d.groupBy(*keys, value).agg(F.count(value).alias("n"), *[c.alias(k) for k, c in (extra or {}).items()])
    probs = F.array(*[F.lit(i / MAX_PIECES) for i in range(1, MAX_PIECES)])
    steps = F.least(F.lit(MAX_PIECES), F.ceil(F.col("_k") / piece_rows).cast("int"))
    cut = F.when(steps > 1, F.transform(F.sequence(F.lit(1), steps - 1), lambda i: F.get("_q", F.floor(i * MAX_PIECES / steps).cast("int") - 1)))
    cuts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), F.percentile_approx(value, probs, 1000).alias("_q")).select(*keys, cut.alias("_cuts"))
    d = null_safe_join(d, cuts, keys) if keys else d.withColumn("_cuts", cuts.scalar())
    passed = F.size(F.filter("_cuts", lambda c: c <= F.col(value)))
    d = d.withColumn("_piece", F.when(F.col("_cuts").isNull(), 0).otherwise(passed)).drop("_cuts")
    parts = [*keys, "_piece"]
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = ["n", *running]
    order = Window.partitionBy(*parts).orderBy(value)
    here = order.rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumns({**{f"_in_{c}": F.coalesce(F.sum(c).over(here), F.lit(0)) for c in counts}, "_end": F.lead(F.lit(1)).over(order).isNull()})
    # the last row of each piece holds its sums, off the same shuffle
    sums = local.where("_end").select(*parts, *[(F.col(f"_in_{c}") + F.col(c)).alias(f"_s_{c}") for c in counts])
    offsets = sums.select(*parts, *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in counts],
                          *[F.sum(f"_s_{c}").over(whole).alias(f"{c}_total") for c in counts])
    out = null_safe_join(local, offsets, parts).withColumns({f"{c}_before": F.col(f"_off_{c}") + F.col(f"_in_{c}") for c in counts})
    return out.select(*keys, value, "n", "n_before", "n_total", *(extra or {}), *[f"{c}_{end}" for c in running for end in ("before", "total")])


def quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Exact linear-interpolation quantiles per group: column name -> (value column, probability).

    All value columns are ranked together in one pass; NULL values do not count, and a group without any gets NULL.
    """
    cols = list(dict.fromkeys(c for c, _ in wanted.values()))
    each = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)])
    long = df.select(*keys, F.explode(each).alias("_e")).select(*keys, "_e._c", "_e._v")
    r = value_ranks(long, [*keys, "_c"], "_v", keep_null=True, piece_rows=piece_rows)
    n0, n, total = F.col("n_before"), F.col("n"), F.col("n_total")
    aggs = []
    for name, (col, p) in wanted.items():
        mine, pos = F.col("_c") == cols.index(col), F.lit(float(p)) * (total - 1)
        for end, index in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when(mine & (n0 <= index) & (index < n0 + n), F.col("_v"))).alias(f"_{end}_{name}"))
        aggs.append(F.max(F.when(mine, pos - F.floor(pos))).alias(f"_fr_{name}"))
    between = {q: F.col(f"_lo_{q}") + F.col(f"_fr_{q}") * (F.col(f"_hi_{q}") - F.col(f"_lo_{q}")) for q in wanted}
    return r.groupBy(*keys).agg(*aggs).select(*keys, *[c.alias(q) for q, c in between.items()])


def split_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``quantiles`` of a single value column."""
    return quantiles(df, keys, {n: (value, p) for n, p in probs.items()}, piece_rows)


def mid_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Attach the average rank of ``value`` within its group (ties share the mean rank); NULL for a NULL value."""
    r = value_ranks(df, keys, value, piece_rows=piece_rows).select(
        *keys, value, (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias(name))
    return null_safe_join(df, r, [*keys, value], "left")


def split_enumerate(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: Column, cols: Sequence[str],
                    ends: str) -> DataFrame:
    """0-based position ``idx``, group size ``n_total``, previous values and the group's first and last ``ends``.

    Everything that crosses pieces comes from one summary row per piece.
    """
    parts = [*keys, "_piece"]
    here = Window.partitionBy(*parts).orderBy(*order)
    d = df.withColumn("_piece", piece).withColumn("_v", F.struct(*cols))
    local = d.withColumns({"_rn": F.row_number().over(here), "_p": F.lag("_v").over(here), "_end": F.lead(F.lit(1)).over(here).isNull(),
                           "_e0": F.first(ends).over(here.rowsBetween(Window.unboundedPreceding, 0))})
    # the last row of each piece holds its size, its last values and its first end, off the same shuffle
    s = local.where("_end").select(*parts, F.col("_rn").alias("_n"), F.col("_v").alias("_last"), "_e0", F.col(ends).alias("_e1"))
    up = Window.partitionBy(*keys).orderBy("_piece")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(*parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(whole).alias("n_total"),
                 F.lag("_last").over(up).alias("_edge"), F.first("_e0").over(whole).alias(f"first_{ends}"),
                 F.last("_e1").over(whole).alias(f"last_{ends}"))
    out = null_safe_join(local.drop("_e0"), s, parts)
    out = out.withColumns({"idx": F.col("_off") + F.col("_rn") - 1, "_p": F.coalesce("_p", "_edge")})
    return out.withColumns({f"prev_{c}": F.col("_p")[c] for c in cols}).drop("_piece", "_v", "_rn", "_p", "_off", "_edge", "_end")
