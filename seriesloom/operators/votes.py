"""From window probabilities to one call per series, at the end or while the series unfolds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.arrays import first_argmax
from seriesloom.functions.ordering import null_safe_join, split_last, split_running_sum

TIE_WEIGHT = 1e-3


def _scores(n_classes: int, weight: float) -> dict[str, Column]:
    """One vote for the window's own call plus a small share of its probabilities, per class."""
    return {f"_v{c}": F.when(F.col("_top") == c, 1.0).otherwise(0.0) + F.lit(weight) * F.get("proba", F.lit(c))
            for c in range(n_classes)}


def vote_series(windows: DataFrame, keys: Sequence[str], n_classes: int, weight: float = TIE_WEIGHT) -> DataFrame:
    """Majority vote of the windows of a series; ties go to the higher mean probability, then the lowest class.

    One sum per class with map-side partial sums: one shuffle of one row per series and task.
    """
    d = windows.withColumn("_top", first_argmax(F.col("proba")))
    sums = [F.sum(c) for c in _scores(n_classes, weight).values()]
    out = d.groupBy(*keys, "series_id", "subject", "cls").agg(F.array(*sums).alias("_s"), F.count(F.lit(1)).alias("n_windows"))
    return out.select(*keys, "series_id", "subject", F.col("cls").alias("truth"), first_argmax(F.col("_s")).alias("pred"), "n_windows")


def mean_proba_call(windows: DataFrame, keys: Sequence[str], n_classes: int) -> DataFrame:
    """Series probability = mean over its windows; label = argmax, confidence = max."""
    d = windows.groupBy(*keys, "series_id", "subject", "cls").agg(
        F.array(*[F.avg(F.get("proba", F.lit(c))) for c in range(n_classes)]).alias("_p"))
    return d.select(*keys, "series_id", "subject", F.col("cls").alias("truth"), first_argmax(F.col("_p")).alias("pred"),
                    F.array_max("_p").alias("conf"))


def running_vote(windows: DataFrame, keys: Sequence[str], n_classes: int, window_s: float,
                 piece_windows: int = 4096, weight: float = TIE_WEIGHT) -> DataFrame:
    """The vote over all windows that have ended so far, one row per window.

    Long series are cut every ``piece_windows`` windows; totals carry over, so no task holds a whole series.
    """
    d = windows.withColumn("_top", first_argmax(F.col("proba"))).withColumns(_scores(n_classes, weight))
    cols = [f"_v{c}" for c in range(n_classes)]
    d = d.select(*keys, "series_id", "subject", F.col("cls").alias("truth"), "w", (F.col("t0_s") + F.lit(window_s)).alias("end_s"), *cols)
    run = split_running_sum(d, [*keys, "series_id"], ["w"], F.floor(F.col("w") / piece_windows), cols)
    call = first_argmax(F.array(*[F.col(f"run_{c}") for c in cols]))
    return run.withColumn("call", call).drop(*cols, *[f"run_{c}" for c in cols])


def asof_calls(running: DataFrame, keys: Sequence[str], times: Sequence[float]) -> DataFrame:
    """Call at each time: of the last window ended by then, of the first one before that; NULL time = the end.

    The time points are parameters, so the as-of lookup is a conditional aggregate and needs no range join.
    """
    first = F.min_by("call", "end_s")
    at = [F.struct(F.lit(float(t)).alias("t_s"), F.coalesce(
        F.max_by("call", F.when(F.col("end_s") <= t, F.col("end_s"))), first).alias("call")) for t in times]
    last = F.struct(F.lit(None).cast("double").alias("t_s"), F.max_by("call", "end_s").alias("call"))
    d = running.groupBy(*keys, "series_id", "subject", "truth").agg(
        F.array(*at, last).alias("_c"), F.max("end_s").alias("set_duration_s"))
    return d.select(*keys, "series_id", "subject", "truth", "set_duration_s", F.explode("_c").alias("_c")).select(
        "*", "_c.t_s", "_c.call").drop("_c")


def asof_join(running: DataFrame, times: DataFrame, keys: Sequence[str], time_col: str = "t_s", piece_s: float = 600.0) -> DataFrame:
    """``times`` (keys, series_id, a time, any other columns) with the ``call`` of each row's series at its time.

    The call is that of the last window ended by then, inclusive; before the first window, that window's; at a NULL
    time, the last one's; NULL for a series without windows. Windows and times are merged in order, and the last call
    is carried on over pieces of ``piece_s`` seconds: no range join, and no task holds a whole series.
    """
    g = [*keys, "series_id"]
    own = [c for c in times.columns if c not in g]
    at = F.coalesce(F.col(time_col).cast("double"), F.lit(float("inf")))
    asked = times.select(*g, at.alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_call"), F.struct(*own).alias("_own"))
    ended = running.select(*g, F.col("end_s").cast("double").alias("_t"), F.lit(0).alias("_kind"), F.col("call").alias("_call"))
    both = ended.withColumn("_own", F.lit(None).cast(asked.schema["_own"].dataType)).unionByName(asked)
    piece = F.floor(F.least(F.col("_t") / piece_s, F.lit(1e15)))
    found = split_last(both, g, ["_t", "_kind"], piece, "_call", "_last").where("_kind = 1")
    first = running.groupBy(*g).agg(F.min_by("call", "end_s").alias("_first"))
    return null_safe_join(found, first, g, "left").select(*g, *[F.col("_own")[c].alias(c) for c in own], F.coalesce("_last", "_first").alias("call"))


def stable_since(running: DataFrame, keys: Sequence[str]) -> DataFrame:
    """End of the first window after which every call is right; NULL when the last call is wrong.

    Takes two aggregates with partial sums instead of an ordered pass: the last wrong window first,
    then the earliest window after it.
    """
    g = [*keys, "series_id", "subject", "truth"]
    wrong = F.when(F.col("call") != F.col("truth"), F.col("w"))
    last = running.groupBy(*g).agg(F.max(wrong).alias("_lw"), F.max("end_s").alias("set_duration_s"))
    after = running.join(last, g).where(F.col("_lw").isNull() | (F.col("w") > F.col("_lw")))
    found = after.groupBy(*g).agg(F.min("end_s").alias("stable_s"))
    return last.join(found, g, "left").select(*g, "set_duration_s", "stable_s")
