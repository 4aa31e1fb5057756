"""Slow and fast parts of packed signals (one row = one recorded set), and what can be measured on them.

The zero-phase filter is a recursion, so it runs over Arrow batches; all else is column expressions.
No operator here shuffles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.arrays import let, total
from seriesloom.operators.signal import zero_phase

VARIANTS = ("full", "gravity", "motion", "magnitude")
GRAVITY_HZ, GRAVITY_POLES = 0.3, 2  # fixed by the domain
G = 9.81
MEASURES = ("forearm_direction", "forearm_turning", "rep_speed_hz", "movement_size_g")  # fixed names


def with_lowpass(signals: DataFrame, name: str, order: int, cutoff: float, fs: float, channels: int = 2**31 - 1) -> DataFrame:
    """Add the zero-phase low-pass of the first ``channels`` channels of ``ch``; a cutoff beyond fs / 2 changes nothing."""
    place = signals.columns.index("ch")

    def task(batches):
        known: dict = {}
        for batch in batches:
            rows = batch.column(place)
            signal = rows.flatten()
            per_row = np.diff(rows.offsets.to_numpy())
            within = np.arange(per_row.sum()) - np.repeat(np.cumsum(per_row) - per_row, per_row)
            edges = signal.offsets.to_numpy() - signal.offsets[0].as_py()
            starts, sizes = edges[:-1][within < channels], np.diff(edges)[within < channels]
            values = signal.flatten().to_numpy(zero_copy_only=False).astype(float)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            out = np.empty(ends[-1])
            for n in np.unique(sizes[sizes > 0]):  # channels of one length together, whatever row they belong to
                mine = np.flatnonzero(sizes == n)
                x = values[starts[mine, None] + np.arange(n)]
                y = zero_phase(x.T, order, cutoff, fs, known=known).T if cutoff < fs / 2 else x
                out[ends[mine, None] + np.arange(n)] = y
            inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))
            outer = np.concatenate([[0], np.cumsum(np.minimum(per_row, channels))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(outer, pa.int32()), inner)], [*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in signals.schema.fields)
    return signals.mapInArrow(task, f"{kinds}, `{name}` array<array<double>>")


def lowpass_packed(signals: DataFrame, order: int, cutoff: float, fs: float) -> DataFrame:
    """Zero-phase low-pass of every channel of a packed series."""
    return with_lowpass(signals, "_low", order, cutoff, fs).withColumn("ch", F.col("_low")).drop("_low")


def magnitude(axes: str | Column) -> Column:
    """Length of the three-dimensional vector at every sample."""
    x, y, z = (F.get(axes, F.lit(k)) for k in range(3))
    return F.zip_with(F.zip_with(x, y, lambda a, b: a * a + b * b), z, lambda s, c: F.sqrt(s + c * c))


def with_parts(signals: DataFrame, fs: float, cutoff: float = GRAVITY_HZ) -> DataFrame:
    """Add ``gravity``, the slow part of the three axes, and ``motion``, what is left of them: one pass, no join."""
    d = with_lowpass(signals, "gravity", GRAVITY_POLES, cutoff, fs, 3)
    rest = F.zip_with(F.slice("ch", 1, 3), "gravity", lambda a, g: F.zip_with(a, g, lambda p, q: p - q))
    return d.withColumn("motion", rest)


def split_variant(signals: DataFrame, variant: str, fs: float, cutoff: float = GRAVITY_HZ) -> DataFrame:
    """full, gravity or motion (each with its magnitude as fourth channel), or magnitude only."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    if variant in ("full", "magnitude"):
        axes = F.slice("ch", 1, 3)
        found = F.array(magnitude(axes)) if variant == "magnitude" else F.concat(axes, F.array(magnitude(axes)))
        return signals.withColumn("ch", found)
    d = with_parts(signals, fs, cutoff)
    return d.withColumn("ch", F.concat(F.col(variant), F.array(magnitude(variant)))).drop("gravity", "motion")


def band_peak(fs: float, low: float, high: float):
    """Column function: frequency with the most power in [low, high]; NULL if no bin lies there."""

    @F.pandas_udf("double")
    def peak(values: pd.Series) -> pd.Series:
        out = np.full(len(values), np.nan)
        sizes = values.map(len).to_numpy(int)
        for n in np.unique(sizes[sizes > 0]):
            bins = np.fft.rfftfreq(n, 1 / fs)
            bins_in = np.flatnonzero((bins >= low) & (bins <= high))
            mine = np.flatnonzero(sizes == n)
            if len(bins_in):
                x = np.stack(values.iloc[mine].to_list())
                spectrum = np.fft.rfft(x - x.mean(1, keepdims=True))[:, bins_in]
                out[mine] = bins[bins_in[(spectrum.real**2 + spectrum.imag**2).argmax(1)]]
        return pd.Series(out).where(~np.isnan(out), None)

    return peak


def series_measures(signals: DataFrame, fs: float, band: tuple[float, float] = (0.2, 3.0), cutoff: float = GRAVITY_HZ) -> DataFrame:
    """Set-level direction, turning, dominant rate within the band and size of motion in g.

    Direction: mean of the unit vector of gravity (also for the other axes).  Turning: SD in degrees of its angle
    to the mean direction.  NULL where gravity or the mean direction has no length, or the band holds no bin.
    """
    d = with_parts(signals, fs, cutoff)
    d = d.withColumns({"_len": magnitude("gravity"), "_n": F.size(F.get("gravity", F.lit(0)))})
    unit = F.transform("gravity", lambda axis: F.zip_with(axis, "_len", lambda g, r: F.try_divide(g, r)))
    d = d.withColumn("_unit", unit)
    d = d.withColumn("_mean", F.transform("_unit", lambda axis: total(axis) / F.col("_n")))
    along = let(F.col("_mean"), lambda m: F.zip_with(
        F.zip_with(F.get("_unit", F.lit(0)), F.get("_unit", F.lit(1)), lambda a, b: a * m[0] + b * m[1]), F.get("_unit", F.lit(2)),
        lambda s, c: s + c * m[2]))
    size = F.sqrt(total(F.transform("_mean", lambda m: m * m)))
    d = d.withColumns({"_along": along, "_size": size})
    clipped = let(F.col("_size"), lambda r: F.transform("_along", lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(c, r)))))
    d = d.withColumn("_angle", F.transform(clipped, lambda c: F.degrees(F.acos(c))))
    d = d.withColumn("_angle_mean", total(F.col("_angle")) / F.col("_n"))
    spread = let(F.col("_angle_mean"), lambda m: total(F.transform("_angle", lambda a: (a - m) * (a - m))))
    d = d.withColumn("_move", F.transform(magnitude("motion"), lambda v: v / G))
    known = F.forall("_len", lambda r: r > 0)  # comparisons drop NULL in greatest and least
    values = {
        MEASURES[0]: F.get("_mean", F.lit(0)), MEASURES[1]: F.when(known & (F.col("_size") > 0), F.sqrt(spread / F.col("_n"))),
        MEASURES[2]: band_peak(fs, *band)("_move"), MEASURES[3]: F.sqrt(total(F.transform("_move", lambda v: v * v)) / F.col("_n")),
        "axis_y": F.get("_mean", F.lit(1)), "axis_z": F.get("_mean", F.lit(2)),
    }
    keep = [c for c in signals.columns if c != "ch"]
    return d.select(*keep, *[v.alias(k) for k, v in values.items()])
