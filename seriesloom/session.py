"""Session settings, table loading, and the shared scratch folder."""

from __future__ import annotations

import atexit
import hashlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def build_session(app: str = "seriesloom", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; set here only where the session names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.getCheckpointDir():
            return spark.sparkContext.getCheckpointDir()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="seriesloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)  # a local session's own folder ends with it
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str):
    """Shorthand: ``t = tables(spark, dir); t("events")``."""
    return lambda name: table(spark, sf_dir, name)


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: StructType) -> DataFrame:
    """A few rows of the driver as a table that starts no task."""
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), schema)


_saved: dict[tuple, tuple[str, str]] = {}


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Digest of names, lengths and times of all files below ``paths``: it changes when a file comes, goes or changes."""
    jvm, conf, seen = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for name in sorted(paths):
        path = jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            seen.append((name, -1, -1))
            continue
        files = fs.listFiles(path, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        seen += sorted(found)
    return hashlib.md5(repr(seen).encode()).hexdigest()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df_fn, spark: SparkSession, key: tuple, outlive: bool = False) -> DataFrame:
    """Write the result of ``df_fn()`` once per parameter key and state of its input, then read it back.

    Parts of the key that begin with "/" or hold "://" are input folders: their files' names, lengths and times are
    part of the key, so a changed input is computed anew, and the table of its old state is deleted. The table lies
    in the shared folder: it survives lost executors and cuts the lineage of everything computed from it. It belongs
    to the session, unless it is to ``outlive`` it: then any later session with the same key, input and version of
    this package finds it, by the marker that a finished write leaves.
    """
    inputs = [p for p in key if isinstance(p, str) and (p.startswith("/") or "://" in p)]
    state = fingerprint(spark, inputs)
    if outlive:
        name = hashlib.md5(repr((key, _version())).encode()).hexdigest()[:16]
        folder = f"{shared_dir(spark).rstrip('/')}/kept-{name}"
        path = f"{folder}/{state}"
        marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
            _delete(spark, folder)  # other states of the input, and a write that did not finish
            df_fn().write.mode("overwrite").parquet(path)
        _saved[("kept", *key)] = state, path
        return spark.read.parquet(path)
    full = (spark.sparkContext.applicationId, *key)
    if full in _saved and _saved[full][0] != state:
        _delete(spark, _saved.pop(full)[1])
    if full not in _saved:
        path = fresh_path(spark, str(key[0]))
        df_fn().write.parquet(path)
        _saved[full] = state, path
    return spark.read.parquet(_saved[full][1])


def drop_materialized(spark: SparkSession, name: str | None = None) -> int:
    """Delete the tables that ``materialize`` wrote in this session, or those of one name (the first part of the key); how many went."""
    mine = [k for k in _saved if k[0] in ("kept", spark.sparkContext.applicationId) and (name is None or k[1] == name)]
    for k in mine:
        _delete(spark, _saved.pop(k)[1])
    return len(mine)


def _version() -> str:
    """Digest of this package's sources: tables of another version are not taken for this one's."""
    digest = hashlib.md5()
    for folder, _, names in sorted(os.walk(os.path.dirname(os.path.abspath(__file__)))):
        for n in sorted(names):
            if n.endswith(".py"):
                with open(os.path.join(folder, n), "rb") as f:
                    digest.update(f.read())
    return digest.hexdigest()


def bounded_broadcast(df: DataFrame, max_rows: int, limit: int = 200_000) -> DataFrame:
    """Broadcast ``df`` only where ``max_rows``, its largest possible number of rows (of numbers, for rows of arrays), is small.

    The bound comes from the design's parameters or from a count, never from an estimate.

    Beyond the limit the join is left to the optimizer (shuffled, with AQE's skew splitting).
    """
    return F.broadcast(df) if max_rows <= limit else df
