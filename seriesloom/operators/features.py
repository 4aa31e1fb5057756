"""Sliding windows over packed signals and the per-window feature tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import arrays as A

CHANNELS = ["x", "y", "z", "mag"]
PER_CHANNEL = A.STATS + A.SHAPE + A.SPECTRUM


def window_shape(window_s: float, overlap: float, fs: float) -> tuple[int, int]:
    """Samples per window and between window starts (halves round to even)."""
    length = round(window_s * fs)
    return length, max(1, round(length * (1 - overlap)))


def sliding_windows(signals: DataFrame, window_s: float, overlap: float, fs: float, trim_s: float = 0.0) -> DataFrame:
    """Full windows only, never across series; every window is cut out of its own row, so nothing shuffles."""
    length, step = window_shape(window_s, overlap, fs)
    trim = round(trim_s * fs)
    n = F.size(F.get("ch", F.lit(0)))
    d = edge_trim(signals, trim) if trim else signals
    d = d.where(n >= length).select("*", F.posexplode(F.sequence(F.lit(0), n - length, F.lit(step))).alias("w", "_a"))
    return d.withColumns({"t0_s": F.col("_a") / F.lit(float(fs)),
                          "ch": F.transform("ch", lambda c: F.slice(c, F.col("_a") + 1, F.lit(length)))}).drop("_a")


def short_series(signals: DataFrame, window_s: float, overlap: float, fs: float, trim_s: float = 0.0) -> DataFrame:
    """Series too short for a single window once their ends are trimmed: what ``sliding_windows`` leaves out."""
    length, _ = window_shape(window_s, overlap, fs)
    n = F.coalesce(F.size(F.get("ch", F.lit(0))), F.lit(0))
    return signals.where(n - 2 * round(trim_s * fs) < length).withColumn("n_samples", n).drop("ch")


def edge_trim(signals: DataFrame, trim: int) -> DataFrame:
    """Drop the first and last ``trim`` samples of every packed series."""
    return signals.withColumn("ch", F.transform("ch", lambda c: F.slice(
        c, F.lit(trim + 1), F.greatest(F.size(c) - 2 * trim, F.lit(0)))))


def by_channel(windows: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """One row per window and channel, the samples in column ``a``."""
    names = F.array(*[F.lit(c) for c in channels])
    return windows.select("*", F.posexplode("ch").alias("_ci", "a")).withColumn(
        "channel", F.get(names, F.col("_ci"))).drop("ch", "_ci")


def axis_correlations(windows: DataFrame) -> DataFrame:
    """Correlations xy, xz, yz of each window (0 for a constant axis)."""
    d = windows.withColumns({f"_{c}": F.get("ch", F.lit(i)) for i, c in enumerate("xyz")})
    d = d.withColumns({f"_m{c}": A.total(F.col(f"_{c}")) / F.size(f"_{c}") for c in "xyz"})
    return A.drop_helpers(d.withColumns({
        f"corr_{p}{q}": A.pearson(F.col(f"_{p}"), F.col(f"_{q}"), F.col(f"_m{p}"), F.col(f"_m{q}"))
        for p, q in ("xy", "xz", "yz")}).drop("ch"))


def feature_names(channels: Sequence[str] = CHANNELS) -> list[str]:
    names = [f"{c}_{s}" for c in channels for s in PER_CHANNEL]
    return names + ["corr_xy", "corr_xz", "corr_yz"] if len(channels) >= 3 else names


class _Stack:
    """Windows of one shape, (windows, channels, samples), and what several features share."""

    def __init__(self, x: np.ndarray, fs: float) -> None:
        self.x, self.fs, self.length = x, fs, x.shape[-1]
        self.mean = x.mean(-1)
        self.rest = x - self.mean[..., None]
        self.var = np.square(self.rest).mean(-1)
        #: no variance beyond the rounding of the mean
        self.varies = self.var > (1e-12 * np.maximum(np.abs(self.mean), 1e-30)) ** 2
        spectrum = np.fft.rfft(self.rest, axis=-1)[..., 1:]
        self.power = spectrum.real**2 + spectrum.imag**2
        self.whole = np.maximum(self.power.sum(-1), 1e-12)

    def moment(self, k: int) -> np.ndarray:
        """Standardised central moment, 0 without variance."""
        ratio = np.zeros_like(self.var)
        return np.divide((self.rest**k).mean(-1), self.var ** (k / 2), out=ratio, where=self.varies)

    def entropy(self) -> np.ndarray:
        share = self.power / self.whole[..., None]
        return (share * np.log(1 / np.maximum(share, 1e-12))).sum(-1) / (np.log(self.power.shape[-1]) or 1.0)

    def correlation(self, p: int, q: int) -> np.ndarray:
        scale = np.sqrt(self.length**2 * self.var[:, p] * self.var[:, q])
        return np.divide((self.rest[:, p] * self.rest[:, q]).sum(-1), scale, out=np.zeros_like(scale), where=scale > 0)


#: What the features of ``functions.arrays`` are on a stack. Their names and order are fixed.
ON_STACKS = {
    "mean": lambda s: s.mean, "std": lambda s: np.sqrt(s.var), "min": lambda s: s.x.min(-1), "max": lambda s: s.x.max(-1),
    "range": lambda s: np.ptp(s.x, axis=-1), "iqr": lambda s: np.subtract(*np.quantile(s.x, [0.75, 0.25], axis=-1)),
    "rms": lambda s: np.sqrt(s.var + s.mean**2), "skew": lambda s: s.moment(3), "kurt": lambda s: np.where(s.varies, s.moment(4) - 3, 0.0),
    "zc": lambda s: np.count_nonzero(np.diff(np.less(s.rest, 0), axis=-1), axis=-1) / s.length,
    "jerk": lambda s: np.abs(np.diff(s.x, axis=-1)).mean(-1) * s.fs if s.length > 1 else np.zeros_like(s.mean),
    "domf": lambda s: (s.power.argmax(-1) + 1) * s.fs / s.length, "domp": lambda s: s.power.max(-1) / s.whole, "spent": lambda s: s.entropy(),
}


def _feature_block(x: np.ndarray, fs: float, per_channel: Sequence[str] = PER_CHANNEL, correlations: bool = True) -> np.ndarray:
    """(windows, channels, samples) -> (windows, features) in the order of ``feature_names``."""
    stack = _Stack(x, fs)
    columns = [ON_STACKS[name](stack)[:, c] for c in range(x.shape[1]) for name in per_channel]
    if correlations and x.shape[1] >= 3:
        columns += [stack.correlation(p, q) for p, q in ((0, 1), (0, 2), (1, 2))]
    return np.stack(columns, axis=1)


def spectral_features(windows: DataFrame, fs: float, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Dominant frequency, its share of the power and the normalised spectral entropy, without DC: a row per window and channel.

    The fast transform of ``window_features``, so long windows cost n log n.
    """
    d = window_features(windows, fs, channels, A.SPECTRUM)
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), *[F.col(f"{c}_{s}").alias(s) for s in A.SPECTRUM]) for c in channels])
    keep = [c for c in windows.columns if c != "ch"]
    return d.select(*keep, F.explode(rows).alias("_r")).select(*keep, "_r.*")


def window_features(windows: DataFrame, fs: float, channels: Sequence[str] = CHANNELS, only: Sequence[str] | None = None) -> DataFrame:
    """All features of a window as columns (of those of a channel ``only`` some, and then no correlations), one vectorised pass per Arrow batch and window length (no shuffle).

    Windows without all channels, or with channels of unlike lengths, and empty ones have NULL features.
    """
    names = [f"{c}_{s}" for c in channels for s in only] if only else feature_names(channels)
    keep = [c for c in windows.columns if c != "ch"]
    types = dict(windows.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"`{c}` double" for c in names])
    n, wanted = len(channels), tuple(only or PER_CHANNEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ch = batch.column("ch")
            inner = ch.values
            first, size = ch.offsets.to_numpy()[:-1].astype(int), np.where(ch.is_valid().to_numpy(zero_copy_only=False), np.diff(ch.offsets.to_numpy()), -1)
            edges, values = inner.offsets.to_numpy().astype(int), inner.values.to_numpy(zero_copy_only=False)
            length = np.zeros(batch.num_rows, int)
            whole = np.flatnonzero(size == n)
            spans = np.diff(edges)[first[whole][:, None] + np.arange(n)]
            length[whole] = np.where((spans == spans[:, :1]).all(axis=1), spans[:, 0], 0)
            block = np.full((batch.num_rows, len(names)), np.nan)
            for samples in np.unique(length[length > 0]).tolist():
                rows = np.flatnonzero(length == samples)
                at = edges[first[rows][:, None] + np.arange(n)][:, :, None] + np.arange(samples)
                block[rows] = _feature_block(np.asarray(values, float)[at], fs, wanted, not only)
            missing = length == 0
            columns = [pa.array(block[:, k], mask=missing) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], [*keep, *names])

    return windows.mapInArrow(run, schema)
