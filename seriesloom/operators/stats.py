"""Statistics with the subject as the unit: bootstrap intervals, paired tests, curves, regressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.columns import normal_two_sided
from seriesloom.functions.hashing import draw_bucket, draw_int, draw_key, leading_digits
from seriesloom.functions.ordering import mid_ranks, null_safe_join, split_quantiles, split_rank, value_ranks
from seriesloom.operators.joins import interval_join
from seriesloom.session import fresh_path


def resamples(rows: DataFrame, keys: Sequence[str], unit: str, values: Sequence[str], b: int, seed: int) -> DataFrame:
    """Bootstrap means: one row per key and replicate, units drawn with replacement.

    Units are numbered by the digest of their id; replicate r, slot j takes unit 1 + draw(seed|r|j) mod n.
    """
    num = rows.select(*keys, unit, *values).withColumn("_o", draw_key(0, unit))
    num = split_rank(num, keys, [F.col("_o"), F.col(unit)], draw_bucket(F.col("_o"), 2), "j").drop("_o", unit)
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    slots = num.select(*keys, "j")
    slots = null_safe_join(slots, n, keys) if keys else slots.withColumn("_n", n.scalar())
    slots = slots.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(b))))
    drawn = slots.select(*keys, "rep", (1 + draw_int(seed, "rep", "j") % F.col("_n")).alias("j"))
    return null_safe_join(drawn, num, [*keys, "j"]).groupBy(*keys, "rep").agg(*[F.avg(v).alias(v) for v in values])


def poisson_resamples(rows: DataFrame, keys: Sequence[str], unit: str, values: Sequence[str], b: int, seed: int) -> DataFrame:
    """Bootstrap means with Poisson(1) weights: no numbering and no join, for very many units.

    A task adds up, for each key, ``b`` weighted sums and ``b`` weights of every value in one vector, so a row per task
    and key is exchanged and nothing is multiplied by ``b`` before it. NULL values do not count.
    """
    types = dict(rows.dtypes)
    names = [f"_s{i}" for i in range(len(values))] + [f"_w{i}" for i in range(len(values))]
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"{n} array<double>" for n in names])
    chosen = rows.select(*keys, F.col(unit).cast("string").alias("_u"), *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    # few bytes are much work here, so the rows are dealt to all cores, however small the table
    chosen = chosen.repartition(TASKS_OF_A_CORE * rows.sparkSession.sparkContext.defaultParallelism, *keys, "_u")
    starts = [f"{seed}|{r}".encode() for r in range(1, b + 1)]

    def put(sums: dict, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = [pa.array([k[i] for k in sums], batch.schema.field(i).type) for i in range(len(keys))]
        stack = np.array(list(sums.values()))
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * b), pa.array(stack[:, i].ravel())) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays([*columns, *lists], [*keys, *names])

    def weighed(batches):
        sums, last = {}, None
        for batch in batches:
            last = batch
            own = list(zip(*(c.to_pylist() for c in batch.columns[: len(keys)]), strict=True)) or [()] * batch.num_rows
            v = np.stack([batch.column(f"_v{i}").to_numpy(zero_copy_only=False) for i in range(len(values))], axis=1)
            both = np.hstack([np.nan_to_num(v, nan=0.0, posinf=np.inf, neginf=-np.inf), ~np.isnan(v)])
            tails = [b"" if u is None else b"|" + u.encode() for u in batch.column("_u").to_pylist()]
            members: dict = {}
            for i, key in enumerate(own):
                members.setdefault(key, []).append(i)
            for key, mine in members.items():
                total = sums.setdefault(key, np.zeros((len(names), b)))
                for reps, units, drawn in leading_digits(starts, [tails[i] for i in mine]):
                    total[:, reps] += (poisson_weights(drawn) @ both[np.take(mine, units)]).T
                if len(sums) * len(names) * b > HELD_NUMBERS:
                    yield from put(sums, batch)
                    sums = {}
        if sums:
            yield from put(sums, last)

    def summed(batches):
        key, total, last = None, None, None
        for batch in batches:
            own = list(zip(*(c.to_pylist() for c in batch.columns[: len(keys)]), strict=True)) or [()] * batch.num_rows
            parts = np.stack([batch.column(n).flatten().to_numpy().reshape(batch.num_rows, b) for n in names], axis=1)
            for k, part in zip(own, parts, strict=True):
                if total is not None and k != key:
                    yield from put({key: total}, batch)
                    total = None
                key, total, last = k, part if total is None else total + part, batch
        if total is not None:
            yield from put({key: total}, last)

    partial = chosen.mapInArrow(weighed, schema)
    met = partial.repartition(*keys).sortWithinPartitions(*keys) if keys else partial.repartition(1)  # coalesce() would weigh in one task
    each = met.mapInArrow(summed, schema).select(*keys, F.posexplode(F.arrays_zip(*names)).alias("_r", "_x"))
    means = [F.try_divide(F.col("_x")[f"_s{i}"], F.col("_x")[f"_w{i}"]).alias(v) for i, v in enumerate(values)]
    return each.select(*keys, (F.col("_r") + 1).alias("rep"), *means)


#: Numbers that a task of the bootstrap holds before it sends its sums on.
HELD_NUMBERS = 1 << 23
#: Tasks for each core where the work is in the draws and not in the bytes of the table.
TASKS_OF_A_CORE = 4
#: Cumulative Poisson(1) probabilities up to 8; what is beyond (1.2e-6) counts 9.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 9)]))


def poisson_weights(drawn: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of unsigned 32-bit draws."""
    counts = np.zeros(drawn.shape, np.uint8)
    for cut in np.ceil(POISSON * 2.0**32):
        counts += drawn >= np.uint32(cut)
    return counts.astype(float)


def interval(rows: DataFrame, keys: Sequence[str], unit: str, value: str, b: int, seed: int, alpha: float = 0.05,
             method: str = "multinomial") -> DataFrame:
    """(keys, ci_lo, ci_hi): percentile interval of the mean over units."""
    draw = {"multinomial": resamples, "poisson": poisson_resamples}[method]
    reps = draw(rows, keys, unit, [value], b, seed)
    ci = reps.groupBy(*keys).agg(F.percentile(value, [alpha / 2, 1 - alpha / 2]).alias("_q"))
    return ci.select(*keys, F.get("_q", F.lit(0)).alias("ci_lo"), F.get("_q", F.lit(1)).alias("ci_hi"))


def bootstrap_ci(rows: DataFrame, keys: Sequence[str], unit: str, value: str, b: int = 2000, seed: int = 0,
                 alpha: float = 0.05, method: str = "multinomial") -> DataFrame:
    """Mean over units with its percentile interval; linear quantiles over the replicates.

    ``multinomial`` draws units with replacement by a join on their number, for tables of subjects; ``poisson`` weighs
    every unit in every replicate and needs only sums, for very many units. NULL values do not count, NULL keys are a group.
    """
    ci = interval(rows, keys, unit, value, b, seed, alpha, method)
    m = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    if not keys:
        return m.withColumns({c: ci.select(c).scalar() for c in ("ci_lo", "ci_hi")})
    return null_safe_join(m, ci, keys)


def subject_means(scores: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Average each subject over the repeats in which it appears."""
    return scores.groupBy(*keys, "subject").agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n_rows"))


def summarize(scores: DataFrame, keys: Sequence[str], value: str, b: int = 2000, seed: int = 0) -> DataFrame:
    """Per condition: mean and interval over subject means, median, number of subjects and of rows."""
    ath = subject_means(scores, keys, value)
    ci = bootstrap_ci(ath, keys, "subject", value, b, seed)
    med = split_quantiles(ath, keys, value, {"median": 0.5})
    tot = ath.groupBy(*keys).agg(F.sum("n_rows").alias("n_subject_repeats"))
    return null_safe_join(null_safe_join(ci, med, keys), tot, keys).withColumnRenamed("n", "n_subjects")


EXACT_PAIRS = 50  # most pairs for which the exact distribution is used, a rule of the test


def _exact_tail(n: int, w: float) -> float:
    """Two-sided exact p of the signed-rank statistic without ties."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r].copy()
    return float(min(1.0, 2.0 * ways[: int(round(w)) + 1].sum() / 2.0 ** n))


def _with_p(s: DataFrame, exact: bool) -> DataFrame:
    """Add W, z and p to rank sums (w_plus, w_minus, _ties, n_used, _zeros)."""
    n = F.col("n_used").cast("double")
    w = F.least("w_plus", "w_minus")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    s = s.withColumns({"w": w, "z": F.try_divide(w - n * (n + 1) / 4, F.sqrt(var))})
    s = s.withColumn("p_normal", F.coalesce(normal_two_sided(F.col("z")), F.lit(1.0)))
    if exact:
        @F.pandas_udf("double")
        def exact_p(n: pd.Series, w: pd.Series) -> pd.Series:
            memo: dict[tuple, float] = {}
            return pd.Series([memo.setdefault((i, j), _exact_tail(int(i), j)) if i > 0 else 1.0 for i, j in zip(n, w)])

        use = (F.col("n_used") <= EXACT_PAIRS) & (F.col("_ties") == 0) & (F.col("_zeros") == 0)
        s = s.withColumns({"p": F.when(use, exact_p(F.when(use, F.col("n_used")).otherwise(0), F.when(use, w).otherwise(0.0)))
                           .otherwise(F.col("p_normal")), "method": F.when(use, "exact").otherwise("normal")})
    return s.drop("_ties", "_zeros")


def rank_sums(diffs: DataFrame, keys: Sequence[str], d: str = "d") -> DataFrame:
    """Sums of the mid-ranks of |d| by sign, tie term and number of differences that are not zero.

    Differences are compared after rounding to 12 decimals.
    """
    a = F.round(F.col(d), 12)
    r = value_ranks(diffs.select(*keys, a.alias("_d"), F.abs(a).alias("_a")).where("_d <> 0"), keys, "_a", extra={
        "_pos": F.sum((F.col("_d") > 0).cast("int")), "_neg": F.sum((F.col("_d") < 0).cast("int"))})
    mid = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    t = F.col("n").cast("double")
    return r.groupBy(*keys).agg(F.sum(mid * F.col("_pos")).alias("w_plus"), F.sum(mid * F.col("_neg")).alias("w_minus"),
                                F.sum(t * t * t - t).alias("_ties"), F.sum("n").alias("n_used"))


def _zeros(d: str = "d") -> Column:
    return F.sum((F.round(F.col(d), 12) == 0).cast("int")).alias("_zeros")


def _ranked(groups: DataFrame, sums: DataFrame, keys: Sequence[str], exact: bool) -> DataFrame:
    """Rank sums and p for every group (with ``_zeros``), also for those without any difference."""
    s = null_safe_join(groups, sums, keys, "left").withColumn("n_used", F.coalesce("n_used", F.lit(0)))
    return _with_p(s.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("w_plus", "w_minus", "_ties")}), exact)


def signed_rank(diffs: DataFrame, keys: Sequence[str], d: str = "d", exact: bool = True) -> DataFrame:
    """Wilcoxon signed-rank: zeros dropped, mid-ranks of |d|, W = smaller rank sum, normal z with tie term.

    Where at most EXACT_PAIRS pairs remain without ties and zeros, ``p`` is exact and ``method`` says so.
    """
    return _ranked(diffs.groupBy(*keys).agg(_zeros(d)), rank_sums(diffs, keys, d), keys, exact)


def paired_compare(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, boot: int = 2000, seed: int = 0,
                   exact: bool = True) -> DataFrame:
    """Paired by subject within ``keys``: mean difference a - b with interval, signed-rank p, counts, both means."""
    d = null_safe_join(a.select(*keys, "subject", F.col(value).alias("_a")), b.select(*keys, "subject", F.col(value).alias("_b")), [*keys, "subject"])
    return paired_differences(d.withColumn("d", F.col("_a") - F.col("_b")).where("d is not null"), keys, boot, seed, exact)


def paired_differences(d: DataFrame, keys: Sequence[str], boot: int = 2000, seed: int = 0, exact: bool = True) -> DataFrame:
    """Paired statistics of rows (keys, subject, _a, _b, d = _a - _b).

    The differences, one row per subject, are written once; counts and means, draws and ranks read that table.
    """
    path = fresh_path(d.sparkSession, "differences")
    d.select(*keys, "subject", "_a", "_b", "d").write.parquet(path)
    d = d.sparkSession.read.parquet(path)
    m = d.groupBy(*keys).agg(
        F.avg("d").alias("diff"), F.count(F.lit(1)).alias("n"), F.sum((F.col("d") > 0).cast("int")).cast("bigint").alias("n_positive"),
        F.avg("_a").alias("mean_a"), F.avg("_b").alias("mean_b"), _zeros())
    out = null_safe_join(m, interval(d, keys, "subject", "d", boot, seed), keys)
    return _ranked(out, rank_sums(d, keys), keys, exact)


def n_threshold(curves: DataFrame, keys: Sequence[str], x: str, y: str, frac: float, name: str = "n_needed") -> DataFrame:
    """Smallest x at which a curve has made ``frac`` of its gain from the first to the last point.

    Piecewise linear between grid points; NULL without a gain. A curve has one row per grid point.
    """
    w = Window.partitionBy(*keys).orderBy(x)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = curves.withColumns({"_y0": F.first(y).over(whole), "_y1": F.last(y).over(whole)})
    d = d.withColumn("_f", (F.col(y) - F.col("_y0")) / F.when(F.col("_y1") > F.col("_y0"), F.col("_y1") - F.col("_y0")))
    d = d.withColumns({"_fp": F.lag("_f").over(w), "_xp": F.lag(x).over(w), "_i": F.row_number().over(w)})
    at = F.when(F.col("_f") > F.col("_fp"), F.col("_xp") + (F.lit(frac) - F.col("_fp")) * (F.col(x) - F.col("_xp"))
                / (F.col("_f") - F.col("_fp"))).otherwise(F.col(x).cast("double"))
    hit = F.when((F.col("_i") >= 2) & (F.col("_f") >= frac), F.col("_i"))
    return d.withColumn("_at", at).groupBy(*keys).agg(F.min_by("_at", hit).alias(name))


def equivalent_x(scores: DataFrame, curves: DataFrame, keys: Sequence[str], x: str, y: str, value: str) -> DataFrame:
    """x at which the running maximum of the curve reaches a score; NULL outside the curve.

    The segments of the curve are intervals of scores, joined as such, so a curve may have any number of points.
    """
    up = Window.partitionBy(*keys).orderBy(x)
    points = curves.select(*keys, F.col(x).cast("double").alias("_x0"), F.max(y).over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("_f0"))
    after = Window.partitionBy(*keys).orderBy("_x0")
    segments = points.withColumns({"_x1": F.lead("_x0").over(after), "_f1": F.lead("_f0").over(after)})
    # the last point is an interval of its own, of which only its beginning counts
    segments = segments.withColumn("_to", F.coalesce("_f1", F.col("_f0") + 1))
    d = interval_join(scores, value, segments, "_f0", "_to", keys, how="left")
    v, x0, f0 = F.col(value), F.col("_x0"), F.col("_f0")
    at = F.when(F.col("_x1").isNotNull(), x0 + (v - f0) / (F.col("_f1") - f0) * (F.col("_x1") - x0)).when(v == f0, x0)
    return d.withColumn("equivalent_x", at).drop("_x0", "_f0", "_x1", "_f1", "_to")


def correlation(x: str, y: str) -> Column:
    """Correlation as an aggregate; NULL where x or y does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


#: Groups up to this size are enumerated, 7! orders; larger ones are drawn.
ENUMERATED = 7


#: Ranks, of all drawn orders, that are sorted together, and that a task holds before it sends them on.
PART_CELLS, SENT_CELLS = 1 << 20, 1 << 22
#: Ranks of x that travel together.
BLOCK = 4096


def _bytes_column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value for each stretch of ``data`` that ends before ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _lists(table: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list for each row of a table."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]), pa.array(table.ravel(), kind))


def permuted_sums(ranked: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(_g, _r, _t): the sum of x ranks times y ranks in each drawn order of each group.

    ``ranked`` has (_g, _parts, _u, _rx, _ry, _i); order r takes the units by digest of (seed, r, unit). Each unit's digests are
    made in one task and go, with its y rank and as arrays of many units, to the part of the digests that they fall into: 12 bytes
    a unit and order. A part holds about PART_CELLS of them, sorts those of each order, and as the orders' counts before it differ
    little, one stretch of x ranks serves them all. Of the digest its first 64 bits count; of units equal in them the smaller y comes first.
    """
    spark, last = ranked.sparkSession, replicates + 1
    heads = [f"{seed}|{r}".encode() for r in range(1, last)]
    tall = max(1, SENT_CELLS // replicates)

    def deal(g: np.ndarray, parts: np.ndarray, y: np.ndarray, tails: list[bytes]) -> pa.RecordBatch:
        digits = np.empty((replicates, len(tails)), np.uint64)
        for reps, units, cells in leading_digits(heads, tails, True):
            digits[np.ix_(reps, units)] = cells
        known, first, code = np.unique(g, return_index=True, return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(parts[first])])
        small = np.uint16 if begin[-1] <= 1 << 16 else np.int64  # 16 bits are sorted by counting
        at = (((digits >> np.uint64(32)) * parts.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + begin[code]
        counts = np.stack([np.bincount(row, minlength=begin[-1]) for row in at], axis=1)
        order = np.argsort(at.ravel().astype(small), kind="stable")
        sizes = counts.sum(1)
        met = np.flatnonzero(sizes)
        ends, group = np.cumsum(sizes[met]), np.searchsorted(begin, met, side="right") - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(known[group]), pa.array(met - begin[group]), _lists(counts[met], pa.int32()), _bytes_column(digits.ravel()[order], ends),
             _bytes_column(y[order % len(y)], ends)], ["_g", "_part", "_n", "_d", "_y"])

    def dealt(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, tall):
                b = batch.slice(start, tall)
                g, parts, y = (b.column(c).to_numpy() for c in ("_g", "_parts", "_y"))
                yield deal(g, parts, y.astype(np.uint32), [b"" if u is None else b"|" + u.encode() for u in b.column("_u").to_pylist()])

    def met(key: tuple, pieces: list) -> pa.RecordBatch:
        rep = np.concatenate([np.repeat(np.arange(replicates), n) for n, _, _ in pieces])
        d, y = (np.concatenate([p[i] for p in pieces]) for i in (1, 2))
        order = np.argsort(rep.astype(np.uint16) if replicates <= 1 << 16 else rep, kind="stable")
        d, y = d[order], y[order]
        total = np.sum([p[0] for p in pieces], axis=0)
        ends = np.cumsum(total)
        for start, end in zip(ends - total, ends, strict=True):
            own = np.argsort(d[start:end])
            if np.any(np.diff(d[start:end][own]) == 0):
                own = np.lexsort((y[start:end], d[start:end]))
            y[start:end] = y[start:end][own]
        columns = [pa.array([key[0]]), pa.array([key[1]]), _lists(total[None].astype(np.int32), pa.int32()), _bytes_column(y, ends[-1:])]
        return pa.RecordBatch.from_arrays(columns, ["_g", "_part", "_n", "_y"])

    def sort(batches):
        key, pieces = None, []
        for batch in batches:
            for g, part, n, d, y in zip(*batch.columns, strict=True):
                at = g.as_py(), part.as_py()
                if pieces and at != key:
                    yield met(key, pieces)
                    pieces = []
                key = at
                pieces.append((n.values.to_numpy(), np.frombuffer(d.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint32)))
        if pieces:
            yield met(key, pieces)

    def multiply(batches):
        for batch in batches:
            found = np.empty((batch.num_rows, replicates))
            for i, (n, y, before, xs, lo) in enumerate(zip(*(batch.column(c) for c in ("_n", "_y", "_before", "_xs", "_lo")), strict=True)):
                n, x, y = n.values.to_numpy(), xs.values.to_numpy(), np.frombuffer(y.as_buffer(), np.uint32) / 2.0
                starts, ends = before.values.to_numpy() - lo.as_py(), np.cumsum(n)
                found[i] = [x[s : s + k] @ y[e - k : e] for s, k, e in zip(starts, n, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_g"), _lists(found, pa.float64())], ["_g", "_t"])

    # few bytes are much work here, so the rows are dealt to all cores; twice a mean rank is a whole number
    units = ranked.select("_g", "_parts", F.col("_u").cast("string").alias("_u"), (F.col("_ry") * 2).cast("bigint").alias("_y"))
    units = units.repartition(TASKS_OF_A_CORE * spark.sparkContext.defaultParallelism, "_g", "_u")
    sent = units.mapInArrow(dealt, "_g bigint, _part bigint, _n array<int>, _d binary, _y binary")
    path, at = fresh_path(spark, "orders"), ["_g", "_part"]
    sent.repartition(*at).sortWithinPartitions(*at).mapInArrow(sort, "_g bigint, _part bigint, _n array<int>, _y binary").write.parquet(path)
    pieces = spark.read.parquet(path)

    before = F.coalesce(F.sum("_k").over(Window.partitionBy("_g", "_r").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = pieces.select(*at, F.posexplode("_n").alias("_r", "_k")).withColumn("_b", before).groupBy(*at).agg(
        F.floor(F.min("_b") / BLOCK).alias("_first"), F.floor((F.max(F.col("_b") + F.col("_k")) - 1) / BLOCK).alias("_last"),
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "_b"))), lambda p: p["_b"]).alias("_before"))
    blocks = ranked.select("_g", F.floor((F.col("_i") - 1) / BLOCK).alias("_block"), "_i", "_rx").groupBy("_g", "_block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_rx"))), lambda p: p["_rx"]).alias("_x"))
    stretch = places.select(*at, F.explode(F.sequence("_first", "_last")).alias("_block")).join(blocks, ["_g", "_block"]).groupBy(*at).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_x"))), lambda p: p["_x"])).alias("_xs"))
    whole = pieces.join(places.select(*at, "_before", (F.col("_first") * BLOCK).alias("_lo")), at).join(stretch, at)
    each = whole.select("_g", "_n", "_y", "_before", "_xs", "_lo").mapInArrow(multiply, "_g bigint, _t array<double>")
    return each.select("_g", F.posexplode("_t").alias("_r", "_t")).groupBy("_g", "_r").agg(F.sum("_t").alias("_t"))


def rank_trend(rows: DataFrame, keys: Sequence[str], unit: str, x: str, y: str, replicates: int = 999, seed: int = 0) -> DataFrame:
    """(keys, n, rho, p): rank correlation of x and y with its two-sided permutation p.

    Replicate r sets the y of the unit that comes i-th by digest of (seed, r, unit) against the x of the i-th unit by
    id; p counts the orders whose rho is at least as far from 0, the observed one included. Groups of up to ENUMERATED
    rows are enumerated and exact. Rows with a NULL x or y do not count; rho and p are NULL where x or y does not vary.
    Orders are sorted in pieces of the digest, so a group is never in one task, but for the enumerated ones.
    """
    d = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(unit).alias("_u"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    d = mid_ranks(mid_ranks(d, keys, "_x", "_rx"), keys, "_y", "_ry").select(*keys, "_u", "_rx", "_ry")
    d = split_rank(d.withColumn("_o", draw_key(seed, F.lit("id"), "_u")), keys, [F.col("_o"), F.col("_u")], draw_bucket(F.col("_o"), 2), "_i").drop("_o")
    path = fresh_path(rows.sparkSession, "ranks")
    d.write.parquet(path)
    d = rows.sparkSession.read.parquet(path)
    n = F.count(F.lit(1))
    one = d.groupBy(*keys).agg(n.alias("n"), correlation("_rx", "_ry").alias("rho"), F.sum(F.col("_rx") * F.col("_ry")).alias("_s"), F.avg("_rx").alias("_m"))
    one = one.withColumn("_far", F.abs(F.col("_s") - F.col("n") * F.col("_m") * F.col("_m")) - 1e-9)

    @F.pandas_udf("double")
    def exact(pairs: pd.Series) -> pd.Series:
        def share(own) -> float:
            a, b = np.array([p["_rx"] for p in own]), np.array([p["_ry"] for p in own])
            sums = np.array([list(order) for order in permutations(b)]) @ a - len(a) * a.mean() ** 2
            return float((np.abs(sums) >= abs(a @ b - len(a) * a.mean() ** 2) - 1e-9).mean())

        return pairs.map(share)

    few = null_safe_join(d, one.where(F.col("n") <= ENUMERATED).select(*keys), keys, "left_semi") if keys else d.where(one.select("n").scalar() <= ENUMERATED)
    few = few.groupBy(*keys).agg(F.collect_list(F.struct("_rx", "_ry")).alias("_p"))
    few = few.where(F.size("_p") > 0).select(*keys, exact("_p").alias("_exact"))
    path = fresh_path(rows.sparkSession, "groups")
    one.where(F.col("n") > ENUMERATED).withColumn("_g", F.monotonically_increasing_id()).write.parquet(path)
    groups = rows.sparkSession.read.parquet(path)
    parts = F.ceil(F.col("n") / max(1, PART_CELLS // replicates)).cast("bigint").alias("_parts")
    many = null_safe_join(d, groups.select(*keys, "_g", parts), keys) if keys else d.join(F.broadcast(groups.select("_g", parts)))
    sums = permuted_sums(many.select("_g", "_parts", "_u", "_rx", "_ry", "_i"), replicates, seed).join(groups.select("_g", *keys, "_far", "n", "_m"), "_g")
    share = (F.sum((F.abs(F.col("_t") - F.col("n") * F.col("_m") * F.col("_m")) >= F.col("_far")).cast("int")) + 1) / F.lit(replicates + 1.0)
    far = sums.groupBy(*keys).agg(share.alias("_drawn"))
    if keys:
        one = null_safe_join(null_safe_join(one, few, keys, "left"), far, keys, "left")
    else:
        one = one.withColumns({"_exact": few.select("_exact").scalar(), "_drawn": far.select("_drawn").scalar()})
    return one.select(*keys, "n", "rho", F.when(F.col("rho").isNotNull(), F.coalesce("_exact", "_drawn")).alias("p"))


def within_slopes(rows: DataFrame, keys: Sequence[str], group: str, y: Column, x1: Column, x2: Column) -> DataFrame:
    """Two slopes of y after removing group means, within-R2 and their ratio, from sums only.

    Sums of products per group are combined across groups, so a large group is never gathered.
    """
    d = rows.select(*keys, F.col(group).alias("_g"), y.cast("double").alias("y"), x1.cast("double").alias("a"), x2.cast("double").alias("b"))
    pairs = [("y", "y"), ("y", "a"), ("y", "b"), ("a", "a"), ("a", "b"), ("b", "b")]
    per = d.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in "yab"],
                                     *[F.covar_pop(p, q).alias(f"{p}{q}") for p, q in pairs])
    tot = per.groupBy(*keys).agg(F.sum("n").alias("n_rows"), *[F.sum(F.col("n") * F.col(p + q)).alias(p + q) for p, q in pairs])
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    s1 = (F.col("ya") * F.col("bb") - F.col("yb") * F.col("ab")) / det
    s2 = (F.col("yb") * F.col("aa") - F.col("ya") * F.col("ab")) / det
    out = tot.withColumns({"slope_1": F.when(F.abs(det) > 1e-12, s1), "slope_2": F.when(F.abs(det) > 1e-12, s2)})
    r2 = F.try_divide(F.col("slope_1") * F.col("ya") + F.col("slope_2") * F.col("yb"), F.col("yy"))
    return out.select(*keys, "n_rows", "slope_1", "slope_2", F.try_divide("slope_1", "slope_2").alias("ratio"), r2.alias("within_r2"))


def variance_shares(rows: DataFrame, outer: str, inner: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Shares of the total sum of squares: between classes, between subjects in a class, and the rest."""
    cell = rows.groupBy(*keys, outer, inner).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    cls = cell.groupBy(*keys, outer).agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mc"), F.sum(F.col("n") * F.col("v")).alias("rest"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_q"))
    cls = cls.withColumn("mid", F.col("_q") - F.col("n") * F.col("mc") * F.col("mc"))
    tot = cls.groupBy(*keys).agg(
        (F.sum(F.col("n") * F.col("mc") * F.col("mc")) - F.pow(F.sum(F.col("n") * F.col("mc")), F.lit(2)) / F.sum("n")).alias("top"),
        F.sum("mid").alias("mid"), F.sum("rest").alias("rest"))
    whole = F.col("top") + F.col("mid") + F.col("rest")
    return tot.select(*keys, *[F.try_divide(c, whole).alias(n) for c, n in (
        (F.col("top"), "between_class"), (F.col("mid"), "between_subject"), (F.col("rest"), "residual"))])
