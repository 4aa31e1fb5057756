"""File sources and sinks: sample files, side files, tidy tables, provenance columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.session import fresh_path  # noqa: F401

SAMPLE_SCHEMA = "row int, t_ms bigint, x double, y double, z double"


def _stem() -> F.Column:
    """Recording name: the folder 'stem=<name>' if there is one, else the file name without its ending."""
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, r"/stem=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1))


def scan_samples(spark: SparkSession, path: str, sensor_only: bool = True) -> DataFrame:
    """Header-less sample files below ``path`` with explicit types; sensor rows (row = 1) only.

    ``pos`` orders the rows of one file: (start of the block read, running number inside the task).
    """
    d = (spark.read.schema(SAMPLE_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
         .withColumns({"stem": _stem(), "pos": F.struct(F.col("_metadata.file_block_start").alias("block"),
                                                         F.monotonically_increasing_id().alias("line"))}))
    return d.where("row = 1") if sensor_only else d


def scan_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Two-line side files: person on line 1, class and repetitions on line 2; bad numbers become NULL."""
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
           .withColumn("stem", _stem()))
    line = F.split(F.trim("value"), "\r?\n")
    d = raw.withColumns({"_p": F.split(F.get(line, F.lit(0)), ","), "_c": F.split(F.get(line, F.lit(1)), ",")})
    num = lambda a, i, t: F.get(a, F.lit(i)).try_cast(t)
    return d.select("stem", F.get("_p", F.lit(0)).alias("nick"), num("_p", 1, "double").alias("experience_months"),
                    F.get("_p", F.lit(2)).alias("gender"), num("_p", 3, "int").alias("birth_year"), num("_p", 4, "double").alias("weight_kg"),
                    num("_p", 5, "double").alias("height_cm"), num("_c", 0, "int").alias("cls"), F.get("_c", F.lit(1)).alias("cls_name"),
                    num("_c", 2, "int").alias("reps"))


def attach_sidecar(series: DataFrame, info: DataFrame) -> DataFrame:
    """Attach side files by recording name; recordings without one stay, with ``has_sidecar`` false.

    ``class_agrees`` compares the class in the name with the side file.
    """
    in_name = F.regexp_extract("stem", r"_(\d{2})$", 1).try_cast("int")
    d = series.join(info.withColumn("has_sidecar", F.lit(True)), "stem", "left")
    return d.withColumns({"has_sidecar": F.coalesce("has_sidecar", F.lit(False)), "class_agrees": in_name == F.col("cls")})


def write_samples(rows: DataFrame, path: str) -> None:
    """One folder of header-less files per recording; recordings are brought together, large ones in several files."""
    rows.select("stem", "row", "t_ms", "x", "y", "z").hint("rebalance", "stem").write.partitionBy("stem").option("header", False).csv(path)


def write_sidecars(info: DataFrame, path: str) -> None:
    info.select("stem", "value").hint("rebalance", "stem").write.partitionBy("stem").text(path)


def scan_table(spark: SparkSession, path: str, schema: str | None = None, columns: Sequence[str] | None = None,
               where: str | None = None, fmt: str = "csv") -> DataFrame:
    """Typed table read with column subset and filter, both pushed into the scan where the format allows."""
    reader = spark.read.schema(schema) if schema else spark.read
    d = reader.format(fmt).option("header", True).load(path)
    d = d.where(where) if where else d
    return d.select(*columns) if columns else d


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> str:
    """Tidy result sink: parquet, csv or csv.gz."""
    w = df.write.mode(mode)
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.option("header", True).option("compression", "gzip" if fmt == "csv.gz" else "none").csv(path)
    return path


def with_run_info(df: DataFrame, **info) -> DataFrame:
    """Provenance columns on every row."""
    return df.withColumns({k: F.lit(v) for k, v in info.items()})
