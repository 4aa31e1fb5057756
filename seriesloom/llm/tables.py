"""Intermediate tables in the shared folder, and connected components over links of any number."""

from __future__ import annotations

import ctypes
import posixpath
import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.session import fresh_path, shared_dir


#: Bytes of rows that tasks receive at a time, however long the texts are: it bounds both sides of the exchange with Python.
BATCH_BYTES, SPARK_BATCH = 8 << 20, "67108864b"


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session handing rows to Python in batches of at most BATCH_BYTES, unless it has a limit of its own."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == SPARK_BATCH:
        conf.set(name, str(BATCH_BYTES))
    return df


def lean(task):
    """``task`` for ``mapInArrow``, giving memory that Arrow and the C library keep for later back to the system now and then.

    Python workers live on after a task, so what they keep adds up over the steps of a job.
    """

    def give_back():
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    def run(batches):
        last = time.monotonic()
        for out in task(batches):
            yield out
            if time.monotonic() - last > 1:
                give_back()
                last = time.monotonic()
        give_back()

    return run


#: Rows of a narrow table that one file holds, where the number of rows is known before.
FILE_ROWS = 100_000


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back: its lineage ends there.

    With ``rows``, a bound on its rows, it takes files in proportion and not one for each shuffle partition.
    """
    path = fresh_path(df.sparkSession, name)
    (df if rows is None else df.coalesce(2 + rows // FILE_ROWS)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Delete tables written by ``saved`` that nothing unfinished reads any more."""
    for df in tables:
        spark = df.sparkSession
        root = posixpath.basename(shared_dir(spark).rstrip("/"))
        for folder in {posixpath.dirname(f) for f in df.inputFiles()}:
            if posixpath.basename(posixpath.dirname(folder)) == root:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores added until no column of ``frames`` has it (in any case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: The filter of ``without`` and ``within``: BUCKETS rows of 4096 bytes, 2 MB whatever it is built from.
BUCKETS, BITS = 512, 32_768


def within(docs: DataFrame, keys: dict[str, Column], wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``keys`` (name: expression, none NULL) are in ``wanted`` (columns of these names).

    As in ``without``, a broadcast bitmap of fixed size rules out most of the others where they
    are; what it lets through is shuffled and compared exactly.
    """
    number, place, bits = (unused(x, docs) for x in ("bucket", "place", "bits"))
    spot = lambda columns: (F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)), F.pmod(F.shiftright(F.xxhash64(*columns), 20), F.lit(BITS)))
    where, which = spot([F.col(k) for k in keys])
    table = wanted.select(where.alias(number), which.alias("_p")).groupBy(number).agg(F.bitmap_construct_agg("_p").alias(bits))
    where, which = spot(list(keys.values()))
    d = docs.withColumns({number: where, place: which}).join(F.broadcast(table), number)
    byte = F.conv(F.hex(F.substring(bits, (F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    names = {k: unused(f"_{k}", docs) for k in keys}
    d = d.where(F.bit_get(byte, (F.col(place) % 8).cast("int")) == 1).withColumns({n: keys[k] for k, n in names.items()})
    return d.join(wanted.select(*[F.col(k).alias(n) for k, n in names.items()]), list(names.values()), "left_semi").select(*docs.columns)


def without(docs: DataFrame, keys: dict[str, Column], drop: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """Rows of ``docs`` whose ``keys`` (name: expression) are not in ``drop`` (columns of these names); NULL equals NULL.

    Of rows whose keys are in ``once``, one of each stays.  A bitmap of fixed size over the hashes
    of the keys is broadcast.  Rows that it rules out stay where they are; only the others, the
    dropped ones and few more, are shuffled and compared exactly.  All columns pass through.
    """
    number, place, bits = (unused(x, docs) for x in ("bucket", "place", "bits"))
    names = {k: unused(k, docs) for k in keys}
    named = lambda df: df.select(*[F.col(k).alias(f"_{n}") for k, n in names.items()])
    listed = named(drop) if once is None else named(drop).unionByName(named(once))
    spot = lambda columns: (F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)), F.pmod(F.shiftright(F.xxhash64(*columns), 20), F.lit(BITS)))
    where, which = spot(listed.columns)
    table = listed.select(where.alias(number), which.alias("_p")).groupBy(number).agg(F.bitmap_construct_agg("_p").alias(bits))
    d = docs.withColumns({n: keys[k] for k, n in names.items()})
    where, which = spot(names.values())
    d = d.withColumns({number: where, place: which}).join(F.broadcast(table), number, "left")
    byte = F.conv(F.hex(F.substring(bits, (F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    listed_maybe = F.coalesce(F.bit_get(byte, (F.col(place) % 8).cast("int")) == 1, F.lit(False))
    stays, rest = d.where(~listed_maybe).select(*docs.columns), d.where(listed_maybe).select(*docs.columns, *names.values())
    same = F.lit(True)
    for n in names.values():
        same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
    out = stays.unionByName(rest.join(listed.distinct().hint("merge"), same, "left_anti").select(*docs.columns))
    if once is None:
        return out
    return out.unionByName(rest.join(named(once).hint("merge"), same, "left_semi").dropDuplicates([*names.values()]).select(*docs.columns))


def components(links: DataFrame) -> DataFrame:
    """(node long, component long): the smallest node reachable over ``links`` (a long, b long), for linked nodes.

    Alternating large-star and small-star rounds: every node is tied to the smallest of its
    neighbours until only stars are left, which takes a logarithmic number of rounds.  A hub's
    smallest neighbour is found by a pre-aggregated minimum and joined back, so a hub is never
    gathered.  Each round is a table in the shared folder.  Links with a null end or equal ends
    and repeated links are ignored; no links give no rows.  A node that is smallest has no row.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a != b")
    stars, before = saved(ends.distinct(), "links"), None
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, last = state, stars
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every link gives at most one of the next round
        stars = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links", state[0])
        released(last)
