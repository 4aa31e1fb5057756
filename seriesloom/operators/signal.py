"""Re-timing, resampling and filtering of long sample tables (one row per sample)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.ordering import split_enumerate, split_quantiles

AXES = ("x", "y", "z")
MIN_SAMPLES = 16  # shorter series are not resampled


def enumerate_samples(samples: DataFrame, order: Sequence[str], piece: Column) -> DataFrame:
    """Position in the series, previous sample, series size and duration."""
    d = split_enumerate(samples, ["series_id"], order, piece, ["t_ms", *AXES], "t_ms")
    return d.withColumn("dur_s", (F.col("last_t_ms") - F.col("first_t_ms")) / F.lit(1000.0))


def retime_even(samples: DataFrame, order: Sequence[str], piece: Column) -> DataFrame:
    """Spread the samples of a series evenly over its duration; repeated stamps stay distinct samples."""
    d = enumerate_samples(samples, order, piece)
    return d.select("series_id", "idx", *AXES, F.try_divide(F.col("idx") * F.col("dur_s"), F.col("n_total") - 1).alias("t_s"))


def resample_linear(samples: DataFrame, order: Sequence[str], piece: Column, fs: float) -> DataFrame:
    """Linear interpolation of the evenly re-timed samples on the grid 0, 1/fs, ...

    Every sample emits the grid points between its predecessor and itself, so there is no grid table, no as-of
    join, and a series is never gathered.
    """
    d = enumerate_samples(samples, order, piece)
    d = d.where((F.col("n_total") >= MIN_SAMPLES) & (F.col("dur_s") > 0) & (F.col("idx") > 0))
    d = d.withColumn("_r", F.lit(float(fs)) * F.col("dur_s") / (F.col("n_total") - 1))  # grid points per source sample
    lo = F.ceil((F.col("idx") - 1) * F.col("_r")).cast("bigint")
    end = F.floor(F.col("dur_s") * F.lit(float(fs)) + 1e-9).cast("bigint")
    hi = F.when(F.col("idx") == F.col("n_total") - 1, end).otherwise(F.ceil(F.col("idx") * F.col("_r")).cast("bigint") - 1)
    d = d.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").withColumn("g", F.explode(F.sequence("_lo", "_hi")))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("g") / F.col("_r") - (F.col("idx") - 1)))
    d = d.withColumn("_f", part)
    return d.select("series_id", "g", (F.col("g") / F.lit(float(fs))).alias("t_s"),
                    *[(F.col(f"prev_{c}") + F.col("_f") * (F.col(c) - F.col(f"prev_{c}"))).alias(c) for c in AXES])


def timing_check(samples: DataFrame, order: Sequence[str], piece: Column) -> DataFrame:
    """Per series: shares of repeated stamps and values, and deviation of arrival from even spacing in ms."""
    d = enumerate_samples(samples, order, piece)
    same_t = F.col("t_ms") == F.col("prev_t_ms")
    same_v = (F.col("x") == F.col("prev_x")) & (F.col("y") == F.col("prev_y")) & (F.col("z") == F.col("prev_z"))
    even = F.col("first_t_ms") + F.col("idx") * F.try_divide(F.col("dur_s") * 1000, F.col("n_total") - 1)
    d = d.withColumn("dev", F.abs(F.col("t_ms") - even))
    share = lambda c: F.avg(c.cast("double"))
    g = d.groupBy("series_id").agg(share(same_t).alias("frac_same_t"), share(same_t & same_v).alias("frac_same_t_and_v"),
                                   share(same_v).alias("frac_same_v"), F.max("dev").alias("dev_ms_max"))
    return g.join(split_quantiles(d, ["series_id"], "dev", {"dev_ms_p95": 0.95}), "series_id", "left")


# --- zero-phase Butterworth low-pass ---------------------------------------------------------------

def pole_decay(cutoff: Column | float, fs: Column | float, order: int) -> Column:
    """ln |z| of the slowest pole of an even-order Butterworth low-pass (bilinear transform)."""
    th = math.pi / (2 * order)
    a = F.tan(F.lit(math.pi) * F.lit(cutoff) / (fs if isinstance(fs, Column) else F.lit(fs)))
    up = (1 - a * math.sin(th)) * (1 - a * math.sin(th)) + (a * math.cos(th)) * (a * math.cos(th))
    down = (1 + a * math.sin(th)) * (1 + a * math.sin(th)) + (a * math.cos(th)) * (a * math.cos(th))
    return F.log(up / down) / 2


def impulse_response(order: int, ratio: float, tail: float = 1e-14) -> np.ndarray:
    """Impulse response of an even-order Butterworth low-pass at cutoff / rate, cut where it has decayed to ``tail``."""
    if order % 2:
        raise ValueError("even orders only")
    a = math.tan(math.pi * ratio)
    h = np.ones(1)
    for i in range(order // 2):
        th = math.pi * (2 * i + 1) / (2 * order)
        s = a * complex(-math.sin(th), math.cos(th))
        p = (1 + s) / (1 - s)
        n = np.arange(max(8, math.ceil(math.log(tail) / math.log(abs(p)))))
        w = np.angle(p)
        section = np.abs(p) ** n * np.sin((n + 1) * w) / np.sin(w)
        gain = abs(1 - p) ** 2 / 4
        h = np.convolve(h, np.convolve(section, gain * np.array([1.0, 2.0, 1.0])))
    return h


#: Numbers that are transformed at a time: a batch of many short channels is far smaller than its padded transform.
TRANSFORMED = 1 << 18


def _pass(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Causal filter along axis 0, started in the steady state of the first value."""
    n = len(h) + len(x)
    size = 1 << (n + len(h) - 1).bit_length()
    response, wide = np.fft.rfft(h, size)[:, None], x.reshape(len(x), -1)
    out, step = np.empty(wide.shape), max(1, TRANSFORMED // size)
    for start in range(0, wide.shape[1], step):
        part = wide[:, start : start + step]
        full = np.concatenate([np.repeat(part[:1], len(h), axis=0), part])
        out[:, start : start + step] = np.fft.irfft(np.fft.rfft(full, size, axis=0) * response, size, axis=0)[len(h) : n]
    return out.reshape(x.shape)


def zero_phase(x: np.ndarray, order: int, cutoff: float, fs: float, mirror: tuple[bool, bool] = (True, True),
               known: dict | None = None) -> np.ndarray:
    """Forward-backward low-pass along axis 0 with point-mirrored ends (``mirror`` per end).

    ``known`` keeps impulse responses of rates seen before.
    """
    known, key = {} if known is None else known, (order, round(cutoff / fs, 12))
    if key not in known:
        known[key] = impulse_response(*key)
    h = known[key]
    m = min(3 * (order + 1), len(x) - 1)
    head = 2 * x[:1] - x[m:0:-1] if mirror[0] else x[:0]
    tail = 2 * x[-1:] - x[-2:-m - 2:-1] if mirror[1] else x[:0]
    y = _pass(_pass(np.concatenate([head, x, tail]), h)[::-1], h)[::-1]
    return y[len(head): len(head) + len(x)]


def lowpass_zero_phase(samples: DataFrame, order: Sequence[str], piece: Column, poles: int = 4, cutoff: float | Column = 12.0,
                       chunk: int = 100_000) -> DataFrame:
    """Zero-phase low-pass at each series' own rate, only where the cutoff lies below half the rate.

    Long series are filtered in chunks that overlap by the filter's memory (its response has fallen by e^-32
    there), so a chunk equals the whole-series result to rounding and no task holds a whole series.
    """
    d = enumerate_samples(samples, order, piece)
    d = d.where((F.col("n_total") >= MIN_SAMPLES) & (F.col("dur_s") > 0))
    d = d.withColumn("fs", (F.col("n_total") - 1) / F.col("dur_s"))
    d = d.withColumn("cutoff", cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff)))
    reach = F.when(F.col("cutoff") < F.col("fs") / 2, F.ceil(F.lit(-32.0) / pole_decay(F.col("cutoff"), F.col("fs"), poles)) + 3 * (poles + 1)).otherwise(0)
    last = F.floor((F.col("n_total") - 1) / chunk)
    d = d.withColumn("_reach", reach.cast("bigint")).withColumn("chunk", F.explode(F.sequence(
        F.greatest(F.lit(0), F.floor((F.col("idx") - F.col("_reach")) / chunk)),
        F.least(last, F.floor((F.col("idx") + F.col("_reach")) / chunk)))))
    # one row per chunk: at most chunk + 2 * reach samples, whatever the length of the series
    packed = d.groupBy("series_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("idx", *AXES))).alias("_s"), F.first("fs").alias("fs"), F.first("cutoff").alias("cutoff"),
        F.first("n_total").alias("n_total"))
    packed = packed.select("series_id", "chunk", "fs", "cutoff", "n_total", *[F.col(f"_s.{c}").alias(c) for c in ("idx", *AXES)])
    series_type = dict(d.dtypes)["series_id"]

    def run(batches):
        known: dict = {}
        for pdf in batches:
            parts = []
            for r in pdf.itertuples(index=False):
                idx, x = np.asarray(r.idx), np.stack([np.asarray(r.x, float), np.asarray(r.y, float), np.asarray(r.z, float)], 1)
                if r.cutoff < r.fs / 2:
                    x = zero_phase(x, poles, r.cutoff, r.fs, (idx[0] == 0, idx[-1] == r.n_total - 1), known)
                own = idx // chunk == r.chunk
                parts.append((np.repeat(r.series_id, own.sum()), idx[own], x[own]))
            if parts:
                out = pd.DataFrame(np.concatenate([p[2] for p in parts]), columns=list(AXES))
                out.insert(0, "idx", np.concatenate([p[1] for p in parts]))
                out.insert(0, "series_id", np.concatenate([p[0] for p in parts]))
                yield out

    return packed.mapInPandas(run, f"series_id {series_type}, idx bigint, x double, y double, z double")
