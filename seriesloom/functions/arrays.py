"""Per-window features as expressions on one ``array<double>`` column: no explode, no shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ["mean", "std", "min", "max", "range", "iqr", "rms", "skew", "kurt"]
SHAPE = ["zc", "jerk"]
SPECTRUM = ["domf", "domp", "spent"]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def let(value: Column, body) -> Column:
    """Bind a value for use inside lambdas, where the optimizer would otherwise evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_argmax(a: Column) -> Column:
    """0-based position of the largest entry, the first one on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def sorted_quantile(s: Column, n: Column, p: float) -> Column:
    """Linear-interpolation quantile of an already sorted array."""
    pos = F.lit(p) * (n - 1)
    lo, hi = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
    return F.get(s, lo) + (pos - lo) * (F.get(s, hi) - F.get(s, lo))


def centre(df: DataFrame, a: str = "a") -> DataFrame:
    """Add the helper columns shared by the feature groups: length, mean, mean-removed signal."""
    df = df.withColumn("_n", F.size(a))
    df = df.withColumn("_mean", total(F.col(a)) / F.col("_n"))
    return df.withColumn("_c", let(F.col("_mean"), lambda m: F.transform(a, lambda x: x - m)))


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def stats_features(df: DataFrame, a: str = "a") -> DataFrame:
    """Mean, population SD, min, max, range, IQR, RMS, skewness, excess kurtosis (0 without variance)."""
    zero = F.struct(F.lit(0.0).alias("m2"), F.lit(0.0).alias("m3"), F.lit(0.0).alias("m4"), F.lit(0.0).alias("sq"))

    def step(acc, x):
        d = x - F.col("_mean")
        return F.struct((acc["m2"] + d * d).alias("m2"), (acc["m3"] + d * d * d).alias("m3"),
                        (acc["m4"] + d * d * d * d).alias("m4"), (acc["sq"] + x * x).alias("sq"))

    d = df if "_mean" in df.columns else centre(df, a)
    d = d.withColumn("_m", F.aggregate(a, zero, step)).withColumn("_s", F.sort_array(a))
    n, var = F.col("_n"), F.col("_m.m2") / F.col("_n")
    flat = var <= F.pow(F.lit(1e-12) * F.greatest(F.abs("_mean"), F.lit(1e-30)), F.lit(2))
    return d.withColumns({
        "mean": F.col("_mean"), "std": F.sqrt(var), "min": F.get("_s", F.lit(0)), "max": F.get("_s", n - 1),
        "range": F.get("_s", n - 1) - F.get("_s", F.lit(0)),
        "iqr": sorted_quantile(F.col("_s"), n, 0.75) - sorted_quantile(F.col("_s"), n, 0.25),
        "rms": F.sqrt(F.col("_m.sq") / n),
        "skew": F.when(flat, 0.0).otherwise(F.col("_m.m3") / n / F.pow(var, F.lit(1.5))),
        "kurt": F.when(flat, 0.0).otherwise(F.col("_m.m4") / n / (var * var) - 3),
    })


def shape_features(df: DataFrame, fs: float, a: str = "a") -> DataFrame:
    """Sign changes of the mean-removed signal per sample, and mean absolute jerk."""
    d = df if "_c" in df.columns else centre(df, a)
    n = F.col("_n")
    flips = F.zip_with(F.slice("_c", F.lit(1), n - 1), F.slice("_c", F.lit(2), n - 1),
                       lambda p, q: F.when((p < 0) != (q < 0), 1.0).otherwise(0.0))
    steps = F.zip_with(F.slice(a, F.lit(1), n - 1), F.slice(a, F.lit(2), n - 1), lambda p, q: F.abs(q - p))
    return d.withColumns({"zc": total(flips) / n, "jerk": F.coalesce(F.try_divide(total(steps), n - 1), F.lit(0.0)) * F.lit(fs)})


def spectral_features(df: DataFrame, fs: float, a: str = "a") -> DataFrame:
    """Dominant frequency, its share of the power and the normalised spectral entropy, without DC.

    The sums of the discrete Fourier transform are written out, which suits windows of a few samples;
    ``operators.features.spectral_features`` is the form for all lengths, and this one checks it.
    """
    d = df if "_c" in df.columns else centre(df, a)
    n = F.col("_n")

    def power(k):
        def part(f):
            return total(F.zip_with("_c", F.sequence(F.lit(0), n - 1),
                                    lambda v, i: v * f(F.lit(2 * math.pi) * k * i / n)))
        re, im = part(F.cos), part(F.sin)
        return re * re + im * im

    d = d.withColumn("_p", F.transform(F.sequence(F.lit(1), F.floor(n / 2).cast("int")), power))
    d = d.withColumn("_psum", F.greatest(total(F.col("_p")), F.lit(1e-12)))
    ent = F.aggregate("_p", F.lit(0.0),
                      lambda acc, p: acc - p / F.col("_psum") * F.log(F.greatest(p / F.col("_psum"), F.lit(1e-12))))
    return d.withColumns({"domf": (first_argmax(F.col("_p")) + 1) * F.lit(fs) / n,
                          "domp": F.array_max("_p") / F.col("_psum"), "spent": F.coalesce(F.try_divide(ent, F.log(F.size("_p"))), F.lit(0.0))})


def pearson(a: Column, b: Column, mean_a: Column, mean_b: Column) -> Column:
    """Correlation of two equally long arrays; 0 when one of them is constant."""
    zero = F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"))
    sums = F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), zero, lambda acc, r: F.struct(
        (acc["ab"] + (r["a"] - mean_a) * (r["b"] - mean_b)).alias("ab"),
        (acc["aa"] + (r["a"] - mean_a) * (r["a"] - mean_a)).alias("aa"),
        (acc["bb"] + (r["b"] - mean_b) * (r["b"] - mean_b)).alias("bb")),
        lambda s: F.when((s["aa"] > 0) & (s["bb"] > 0), s["ab"] / F.sqrt(s["aa"] * s["bb"])).otherwise(0.0))
    return sums
