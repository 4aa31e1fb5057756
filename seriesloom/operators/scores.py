"""Per-subject metrics and the summary views built on series predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_counts(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tp, support and number of calls per group and class, only for classes that occur.

    Each prediction is seen once as truth and once as call; both sides sum map-side.
    """
    sides = F.array(
        F.struct(F.col("truth").alias("c"), F.lit(1).alias("s"), F.lit(0).alias("p"), (F.col("truth") == F.col("pred")).cast("int").alias("t")),
        F.struct(F.col("pred").alias("c"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("t")))
    d = preds.select(*keys, F.explode(sides).alias("_e"))
    return d.groupBy(*keys, F.col("_e.c").alias("c")).agg(
        F.sum("_e.t").alias("tp"), F.sum("_e.s").alias("support"), F.sum("_e.p").alias("called"))


def subject_scores(preds: DataFrame, keys: Sequence[str], n_classes: int, labels: str = "all") -> DataFrame:
    """Accuracy, macro-F1 (a class absent from truth and calls counts 0) and balanced accuracy per group.

    ``labels='present'`` averages F1 over the classes that occur instead of all of them.
    """
    c = class_counts(preds, keys)
    f1 = 2 * F.col("tp") / (F.col("support") + F.col("called"))
    over = F.lit(float(n_classes)) if labels == "all" else F.count(F.lit(1))
    return c.groupBy(*keys).agg(
        F.sum("support").cast("bigint").alias("n_bouts"), (F.sum(f1) / over).alias("macro_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("tp") / F.col("support"))).alias("balanced_acc"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"))


def confusion(preds: DataFrame, n_classes: int) -> DataFrame:
    """true x pred counts over the complete label grid, with the share of the true class in percent."""
    n = preds.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    classes = F.sequence(F.lit(0), F.lit(n_classes - 1))
    grid = preds.sparkSession.range(1).select(F.explode(classes).alias("truth")).withColumn("pred", F.explode(classes))
    full = grid.join(n, ["truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = F.sum("n").over(Window.partitionBy("truth"))
    return full.withColumn("pct", F.when(row > 0, 100 * F.col("n") / row))


def top_confusions(preds: DataFrame, k: int) -> DataFrame:
    """The k most frequent mistakes, ties by class."""
    return (preds.where("truth <> pred").groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "truth", "pred").limit(k))


def named_confusions(preds: DataFrame, k: int, name: Callable[[str], Column]) -> DataFrame:
    """``top_confusions`` with what ``name`` makes of the two classes, and whether the names agree."""
    return top_confusions(preds, k).withColumns({"truth_name": name("truth"), "pred_name": name("pred")}).withColumn(
        "same_name", F.col("truth_name") == F.col("pred_name"))


def two_level_mean(rows: DataFrame, keys: Sequence[str], unit: str, value: Column, name: str) -> DataFrame:
    """Mean per unit first, then across units."""
    u = rows.groupBy(*keys, unit).agg(F.avg(value).alias("_u"))
    return u.groupBy(*keys).agg(F.avg("_u").alias(name), F.count(F.lit(1)).alias("n_units"))


def calibration_bins(windows: DataFrame, n_bins: int) -> DataFrame:
    """Stated confidence against observed accuracy per equal-width bin, with the expected calibration error."""
    bin_ = F.least(F.floor(F.col("conf") * n_bins), F.lit(n_bins - 1)).cast("int")
    b = windows.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_conf"),
                                               F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("accuracy"))
    # at most n_bins rows from here on
    gap = F.col("n") * F.abs(F.col("mean_conf") - F.col("accuracy"))
    w = Window.partitionBy(F.lit(0))
    return b.withColumn("ece", F.sum(gap).over(w) / F.sum("n").over(w))


def complete_cases(rows: DataFrame, unit_keys: Sequence[str], point: str, n_points: int) -> DataFrame:
    """Keep units that have every grid point."""
    full = rows.groupBy(*unit_keys).agg(F.countDistinct(point).alias("_k")).where(F.col("_k") == n_points)
    return rows.join(full.drop("_k"), list(unit_keys), "left_semi")
