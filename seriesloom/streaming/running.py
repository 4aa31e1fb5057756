"""Structured Streaming: windowed features with a watermark, and stateful running calls per series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seriesloom.functions.arrays import first_argmax
from seriesloom.operators.votes import TIE_WEIGHT
from seriesloom.session import fresh_path


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A parquet table as a file stream with an explicit schema (taken from a file's footer).

    The path is a pattern, so ``name.parquet`` may be a file or a folder of part files of any name.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(f"{sf_dir}/{name}*.parquet")


def windowed_features(samples: DataFrame, length: str, slide: str, delay: str, by: str = "subject", full: int | None = None) -> DataFrame:
    """Sliding-window aggregates per subject over an unbounded stream; rows later than the watermark are dropped.

    ``samples`` has (ts, subject, x). With ``full`` only windows holding that many samples are kept.
    """
    g = (samples.withWatermark("ts", delay).groupBy(F.window("ts", length, slide), by)
         .agg(F.count(F.lit(1)).alias("n_samples"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
              F.min("x").alias("min"), F.max("x").alias("max"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms")))
    out = g.select(by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_samples", "mean", "std", "min", "max", "rms")
    return out.where(F.col("n_samples") == full) if full else out


def running_calls(windows: DataFrame, keys: Sequence[str], n_classes: int, window_s: float, weight: float = TIE_WEIGHT,
                  time_col: str | None = None, delay: str = "0 seconds", idle_s: float = 3600.0) -> DataFrame:
    """One row per window in the order of ``w``: the vote so far and since when it has not changed.

    Windows are numbered from 0 and may come in any order. One is counted, and its row emitted, as soon as all
    before it have been; until then it waits in the state of its series. With ``time_col`` the stream has a watermark
    of ``delay``: rows older than it are dropped, and once it has passed a waiting window, the ones missing before it
    cannot come any more and it is counted without them. A window whose number was counted already (a repeated row)
    does not vote; it is emitted with ``late`` true and the call as it stands. A series is closed and its state freed
    once the watermark has passed its last window by ``idle_s``. Without ``time_col`` a gap waits for ever.

    State per series: class scores, next window, call, time of its last change, and the waiting windows, whose
    number the watermark bounds.
    """
    keys = [*keys, "series_id", "subject", "truth"]
    types = dict(windows.dtypes)
    d = windows.withWatermark(time_col, delay) if time_col else windows
    stamp = F.unix_millis(time_col) if time_col else F.lit(0).cast("bigint")
    d = d.select(*keys, "w", (F.col("t0_s") + F.lit(window_s)).alias("end_s"), "proba", first_argmax(F.col("proba")).alias("top"),
                 stamp.alias("_ms"), *([F.col(time_col).alias("_time")] if time_col else []))
    out = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", w int, end_s double, call int, last_change_s double, late boolean"
    waiting = ["w", "end_s", "top", "_ms"]
    state_schema = ("score array<double>, call int, changed double, next int, seen_ms bigint, "
                    "w array<int>, end_s array<double>, top array<int>, _ms array<bigint>, proba array<double>")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score, call, changed, after, seen, *held, flat = state.get if state.exists else ([0.0] * n_classes, -1, 0.0, 0, 0, [], [], [], [], [])
        mark = state.getCurrentWatermarkMs() if time_col else -1
        rows = pd.DataFrame(dict(zip(waiting, held, strict=True)))
        rows["proba"] = list(np.asarray(flat, float).reshape(-1, n_classes))
        if state.hasTimedOut:
            if rows.empty:
                state.remove()
                return
        else:
            rows = pd.concat([rows, *[b[[*waiting, "proba"]] for b in batches]])
        rows = rows.sort_values(["w", "_ms"], kind="stable")
        old = ((rows["w"] < after) | rows["w"].duplicated()).to_numpy()
        again, rows = rows[old], rows[~old]
        # counted now: what follows without a gap, and what the watermark has passed together with all before it
        numbers, passed = rows["w"].to_numpy(int), np.flatnonzero(rows["_ms"].to_numpy(int) <= mark)
        ready = np.zeros(len(rows), bool)
        if len(passed):
            ready[: passed[-1] + 1] = True
            after = max(after, int(numbers[passed[-1]]) + 1)
        first = int(ready.sum())
        follow = numbers[first:] == after + np.arange(len(rows) - first)
        ready[first : first + int(np.logical_and.accumulate(follow).sum())] = True
        now, rest = rows[ready], rows[~ready]
        total = np.asarray(score, float)
        if len(now):
            votes = np.stack([np.asarray(p, float) for p in now["proba"]]) * weight
            votes[np.arange(len(now)), now["top"].to_numpy(int)] += 1.0
            totals = total + np.cumsum(votes, axis=0)
            calls, total, after = totals.argmax(1), totals[-1], int(now["w"].iloc[-1]) + 1
        since, told = [], []
        for c, end in zip(calls if len(now) else [], now["end_s"], strict=True):
            if c != call:
                call, changed = int(c), float(end)
            since.append(changed)
            told.append(call)
        shown = pd.concat([now, again])
        seen = max([seen, *(int(x) for x in shown["_ms"]), *(int(x) for x in rest["_ms"])])
        probas = [float(x) for p in rest["proba"] for x in p]
        state.update((total.tolist(), call, changed, after, seen, rest["w"].astype(int).tolist(), rest["end_s"].tolist(),
                      rest["top"].astype(int).tolist(), rest["_ms"].astype(int).tolist(), probas))
        if time_col:
            next_ms = int(rest["_ms"].min()) if len(rest) else seen + int(idle_s * 1000)
            state.setTimeoutTimestamp(max(next_ms, mark + 1))
        n = len(again)
        if not len(shown):
            return
        yield pd.DataFrame({**{k: [v] * len(shown) for k, v in zip(keys, key, strict=True)}, "w": shown["w"].to_numpy(int), "end_s": shown["end_s"].to_numpy(float),
                            "call": told + [call] * n, "last_change_s": since + [changed] * n, "late": [False] * len(now) + [True] * n})

    timeout = GroupStateTimeout.EventTimeTimeout if time_col else GroupStateTimeout.NoTimeout
    return d.groupBy(*keys).applyInPandasWithState(step, out, state_schema, "append", timeout)


def drain(spark: SparkSession, stream: DataFrame, name: str, timeout_s: float | None = None) -> DataFrame:
    """Run a stream over everything available into a table in the shared folder and read it back.

    Waits as long as it takes, unless the caller sets ``timeout_s``.
    """
    path, check = fresh_path(spark, name), fresh_path(spark, f"{name}-log")
    q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", check).option("path", path)
         .trigger(availableNow=True).start())
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError(f"stream {name} did not finish in {timeout_s} s")
    return spark.read.schema(stream.schema).parquet(path)
