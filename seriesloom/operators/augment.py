"""Seeded training copies of packed signals, as column expressions.

Every random number is the digest of (seed, series, copy, purpose), so a copy does not depend on
partitioning and other engines can state it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.arrays import let
from seriesloom.functions.hashing import draw_unit
from seriesloom.operators.gravity import GRAVITY_HZ, magnitude, with_parts


def between(low: float, high: float, unit: Column) -> Column:
    return F.lit(float(low)) + F.lit(float(high - low)) * unit


def at_place(samples: Column, place: Column) -> Column:
    """Linear interpolation of an array at a fractional 0-based place."""
    left = F.floor(place).cast("int")
    here = F.get(samples, left)
    return here + (place - left) * (F.coalesce(F.get(samples, left + 1), here) - here)


def turned(axes: Column, angle: Column, height: Column, around: Column) -> Column:
    """Three axes turned by ``angle`` about the axis at ``height`` (cosine, -1 to 1) and longitude ``around``, as a quaternion."""
    flat = F.sqrt(1 - height * height) * F.sin(angle / 2)
    w, i, j, k = F.cos(angle / 2), flat * F.cos(around), flat * F.sin(around), height * F.sin(angle / 2)
    rows = (
        (1 - 2 * (j * j + k * k), 2 * (i * j - w * k), 2 * (i * k + w * j)),
        (2 * (i * j + w * k), 1 - 2 * (i * i + k * k), 2 * (j * k - w * i)),
        (2 * (i * k - w * j), 2 * (j * k + w * i), 1 - 2 * (i * i + j * j)),
    )
    parts = F.array(*[F.array(*row) for row in rows])
    x, y, z = (F.get(axes, F.lit(c)) for c in range(3))
    mixed = lambda row: F.zip_with(F.zip_with(x, y, lambda a, b: a * row[0] + b * row[1]), z, lambda s, c: s + c * row[2])
    return F.transform(parts, mixed)


def with_copies(rows: DataFrame, copies: int) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def augment_retime_scale(signals: DataFrame, copies: int, seed: int, fs: float, tempo: tuple[float, float] = (0.8, 1.2),
                         intensity: tuple[float, float] = (0.8, 1.2), max_degrees: float = 0.0, cutoff: float = GRAVITY_HZ) -> DataFrame:
    """Copies that are faster or slower, with larger or smaller motion, optionally turned a little; ids ``<series>#sim<copy>``.

    A copy has n / tempo samples, at least 2, spread evenly over the original ones. The slow part keeps its size.
    """
    unit = lambda tag: draw_unit(seed, "series_id", "copy", F.lit(tag))
    d = with_copies(with_parts(signals, fs, cutoff), copies)
    d = d.withColumns({
        "tempo": between(*tempo, unit("tempo")), "intensity": between(*intensity, unit("intensity")),
        "sim_id": F.concat_ws("#sim", F.col("series_id").cast("string"), F.col("copy").cast("string"))})
    blend = F.zip_with("gravity", "motion", lambda g, m: F.zip_with(g, m, lambda p, q: p + F.col("intensity") * q))
    n = F.size(F.get("gravity", F.lit(0)))
    d = d.withColumns({"_blend": blend, "_last": n - 1, "_steps": F.greatest(F.lit(2), F.bround(n / F.col("tempo")).cast("int")) - 1})
    grid = F.sequence(F.lit(0), F.col("_steps"))
    d = d.withColumn("_axes", F.transform("_blend", lambda a: F.transform(grid, lambda k: at_place(a, k * F.col("_last") / F.col("_steps")))))
    if max_degrees:
        limit = math.radians(max_degrees)
        d = d.withColumn("_axes", turned(F.col("_axes"), between(-limit, limit, unit("angle")), between(-1, 1, unit("height")), between(0, 2 * math.pi, unit("around"))))
    keep = [c for c in signals.columns if c != "ch"]
    return d.select(*keep, "copy", "tempo", "intensity", "sim_id", F.concat("_axes", F.array(magnitude("_axes"))).alias("ch"))


def warped_places(n: Column, unit, knots: int, sigma: float) -> Column:
    """Places on a time axis that runs faster and slower: ``knots`` + 1 stretches with log-normal paces, linear within."""
    pace = lambda k: F.exp(sigma * F.sqrt(-2 * F.log(1 - unit(f"pace{k}"))) * F.cos(2 * math.pi * unit(f"phase{k}")))
    marks, end = [F.lit(0.0)], None
    for k in range(knots + 1):
        end = pace(k) if end is None else end + pace(k)
        marks.append(end)
    stretch = lambda i: i * (knots + 1) / (n - 1)
    # bound once: within the lambda the draws would be made for every place
    return let(F.array(*marks), lambda m: F.transform(F.sequence(F.lit(0), n - 1), lambda i: at_place(m, stretch(i)) / F.get(m, F.lit(knots + 1)) * (n - 1)))


def augment_permute_rotate(windows: DataFrame, copies: int, seed: int, sigma: float = 0.2, knots: int = 4, pieces: int = 4,
                           min_piece: int = 10) -> DataFrame:
    """Copies of windows: time warped axis by axis, ``pieces`` stretches longer than ``min_piece`` shuffled, turned at random.

    Cuts: the samples beyond the least lengths are dealt out between the stretches at random.
    """
    unit = lambda tag: draw_unit(seed, "series_id", "w", "copy", F.lit(tag))
    d = with_copies(windows, copies).withColumn("_n", F.size(F.get("ch", F.lit(0))))
    spare = F.col("_n") - pieces * (min_piece + 1)
    fits = F.when(spare > 0, spare).otherwise(F.raise_error(F.lit(f"a window cannot hold {pieces} pieces longer than {min_piece}")))
    drawn = F.array_sort(F.array(*[F.floor(unit(f"cut{k}") * (fits + 1)).cast("int") for k in range(pieces - 1)]))
    cuts = F.concat(F.array(F.lit(0)), drawn, F.array(spare))
    d = d.withColumn("_cuts", F.transform(cuts, lambda c, k: c + k * (min_piece + 1)))  # starts of the stretches, and the end
    order = F.array_sort(F.array(*[F.struct(unit(f"turn{k}").alias("u"), F.lit(k).alias("k")) for k in range(pieces)]))
    d = d.withColumns({"_order": F.transform(order, lambda o: o["k"]), "_places": F.array(*[
        warped_places(F.col("_n"), lambda tag, c=c: unit(f"{tag} axis {c}"), knots, sigma) for c in range(3)])})
    d = d.withColumn("_warped", F.zip_with(F.slice("ch", 1, 3), "_places", lambda a, p: F.transform(p, lambda t: at_place(a, t))))
    start = lambda k: F.get("_cuts", k)
    d = d.withColumn("_mixed", F.transform("_warped", lambda a: F.flatten(F.transform("_order", lambda k: F.slice(a, start(k) + 1, start(k + 1) - start(k))))))
    out = turned(F.col("_mixed"), between(-math.pi, math.pi, unit("angle")), between(-1, 1, unit("height")), between(0, 2 * math.pi, unit("around")))
    d = d.withColumn("_axes", out)
    keep = [c for c in windows.columns if c != "ch"]
    return d.select(*keep, "copy", F.concat("_axes", F.array(magnitude("_axes"))).alias("ch"))
