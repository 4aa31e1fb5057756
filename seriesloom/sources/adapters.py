"""Stand-in cohort tables derived from the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.session import table

FS = 8.0            # samples per second assumed for the packed signals
SUBJECT_BLOCK = 64  # consecutive vectors that make up one subject
N_CLASSES = 10      # labels 0-9 of the vector table


def periods(manifest: DataFrame) -> DataFrame:
    """One row per subject and date: week since the first date, session order, period order.

    Dates are first reduced to one row each, so the ordered part sees days, never raw rows.
    """
    days = manifest.groupBy("subject", "period_date").agg(F.count(F.lit(1)).alias("n_rows"))
    by_day = Window.partitionBy("subject").orderBy("period_date")
    days = days.withColumn("first_date", F.first("period_date").over(by_day))
    days = days.withColumn("week", F.floor(F.datediff("period_date", "first_date") / 7).cast("int"))
    return days.select("subject", "period_date", "first_date", "week",
                       F.row_number().over(by_day).alias("session_order"),
                       F.dense_rank().over(Window.partitionBy("subject").orderBy("week")).alias("period_order"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows before any ordering: one event = one recorded series."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("series_id"), F.col("user_id").alias("subject"), F.col("event_type").alias("cls"),
        F.to_date("ts").alias("period_date"), F.col("ts").alias("started"),
        F.concat_ws("_", F.col("user_id"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.get_json_object("props", "$.k").cast("int").alias("rep_count"), F.col("value").alias("duration_s"))


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest with session and period order attached."""
    rows = event_rows(spark, sf_dir)
    return rows.join(periods(rows), ["subject", "period_date"])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long samples: one series per user, ordered by event id."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_id"), F.col("event_id").alias("i"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"),
        F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"),
        F.hour("ts").cast("double").alias("z"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed signals: one row per recorded set, four channels of 16 samples each."""
    return packed(table(spark, sf_dir, "embeddings"))


def packed(v: DataFrame) -> DataFrame:
    """The same for any vector table, batch or stream."""
    block = [F.slice(F.col("embedding").cast("array<double>"), 16 * c + 1, 16) for c in range(4)]
    return v.select(
        F.col("vec_id").alias("series_id"), F.floor(F.col("vec_id") / SUBJECT_BLOCK).alias("subject"),
        F.col("label").alias("cls"),
        F.when(F.col("vec_id") % SUBJECT_BLOCK < SUBJECT_BLOCK // 2, 1).otherwise(2).alias("period_order"),
        F.array(*block).alias("ch"))


def vector_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of the packed signals (no samples read: the vector column is pruned away)."""
    return signals(spark, sf_dir).select("series_id", "subject", "cls", "period_order")


def order_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second, larger manifest: customer = subject, priority = class, order date = period."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("series_id"), F.col("o_custkey").alias("subject"),
        F.col("o_orderpriority").alias("cls"), F.col("o_orderstatus").alias("status"),
        F.to_date("o_orderdate").alias("period_date"), F.col("o_totalprice").alias("duration_s"))
