"""Closed-form and spark.ml learners; the profile learner fits a whole condition grid in one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.arrays import first_argmax, let, total
from seriesloom.session import bounded_broadcast

MEASURES = ["x_mean", "y_mean", "z_mean", "mag_mean", "x_std", "y_std", "z_std", "mag_std"]


def window_measures(windows: DataFrame) -> DataFrame:
    """Mean and population SD of each channel as one array column ``m`` (order of MEASURES)."""
    d = windows.withColumn("_mu", F.transform("ch", lambda c: total(c) / F.size(c)))
    d = d.withColumn("_sd", F.zip_with("ch", "_mu", lambda c, m: F.sqrt(
        F.aggregate(c, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(c))))
    return d.withColumn("m", F.concat("_mu", "_sd")).drop("_mu", "_sd", "ch")


def measures(ch: Column) -> Column:
    """``window_measures`` of one array of channels."""
    mean = F.transform(ch, lambda c: total(c) / F.size(c))
    return let(mean, lambda mu: F.concat(mu, F.zip_with(ch, mu, lambda c, m: F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(c)))))


def mean_measures(ms: str = "ms", n_measures: int = len(MEASURES)) -> Column:
    """``series_mean`` of the windows' measures of one row, in the order of its windows."""
    def mean(i: int) -> Column:
        known = F.filter(F.transform(ms, lambda w: F.get(w, F.lit(i))), lambda v: v.isNotNull())
        return let(known, lambda v: F.try_divide(total(v), F.size(v)))

    return F.array(*[mean(i) for i in range(n_measures)])


def series_mean(windows: DataFrame, n_measures: int = len(MEASURES)) -> DataFrame:
    """Average of the measure array over the windows of a series (partial sums map-side)."""
    return windows.groupBy("series_id", "subject", "cls").agg(
        F.array(*[F.avg(F.get("m", F.lit(i))) for i in range(n_measures)]).alias("m"))


def calibrate_subject(windows: DataFrame, own: DataFrame, n_measures: int = len(MEASURES)) -> DataFrame:
    """Label-free calibration: every measure less the mean of the subject's windows in ``own``, over their SD.

    Subjects without such windows are left out.
    """
    at = [F.get("m", F.lit(i)) for i in range(n_measures)]
    stats = own.groupBy("subject").agg(F.array(*[F.avg(a) for a in at]).alias("_mu"), F.array(*[F.stddev_pop(a) for a in at]).alias("_sd"))
    z = F.zip_with(F.zip_with("m", "_mu", lambda x, m: x - m), "_sd", lambda x, s: x / (s + F.lit(1e-6)))
    return windows.join(stats, "subject").withColumn("m", z).drop("_mu", "_sd")


def fit_profiles(train: DataFrame, keys: Sequence[str], n_measures: int = len(MEASURES)) -> DataFrame:
    """Class medians and the pooled within-class scale, one row per condition.

    ``train`` holds one row per training series and condition, so a group has at most N*k rows.
    """
    at = [F.get("m", F.lit(i)) for i in range(n_measures)]
    per_class = train.groupBy(*keys, "cls").agg(
        F.array(*[F.percentile(a, 0.5) for a in at]).alias("mu"),
        F.array(*[F.var_samp(a) for a in at]).alias("v"))
    return per_class.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("cls", "mu"))).alias("profiles"),
        F.array(*[F.sqrt(F.avg(F.get("v", F.lit(i)))) + F.lit(1e-9) for i in range(n_measures)]).alias("scale"))


def profile_distances(m: str = "m") -> Column:
    """array<struct<cls, d>>: scaled squared distance of a row to each class profile, classes rising."""
    return F.transform("profiles", lambda p: F.struct(
        p["cls"].alias("cls"),
        total(F.zip_with(F.zip_with(F.col(m), p["mu"], lambda a, b: a - b), F.col("scale"),
                         lambda d, s: (d / s) * (d / s))).alias("d")))


def nearest_profile(rows: DataFrame, profiles: DataFrame, keys: Sequence[str], max_conditions: int) -> DataFrame:
    """Class of the closest profile; the lowest class on ties, classes without a distance skipped."""
    d = rows.join(bounded_broadcast(profiles, max_conditions), list(keys)).withColumn("_d", profile_distances())
    best = F.array_min(F.transform(F.filter("_d", lambda r: r["d"].isNotNull()),
                                   lambda r: F.struct(r["d"].alias("d"), r["cls"].alias("cls"))))
    return d.withColumns({"pred": best["cls"], "distance": best["d"]}).drop("_d", "profiles", "scale", "m")


def profile_proba(rows: DataFrame, profiles: DataFrame, keys: Sequence[str], n_classes: int, max_conditions: int) -> DataFrame:
    """Class probabilities in class order 0..C-1, falling with the distance to the class profile."""
    return proba_from_profiles(rows.join(bounded_broadcast(profiles, max_conditions), list(keys)), n_classes)


def proba_from_profiles(rows: DataFrame, n_classes: int) -> DataFrame:
    """The same for rows that already carry ``profiles`` and ``scale``."""
    d = rows.withColumn("_d", profile_distances())
    by_class = let(F.map_from_entries("_d"), lambda m: F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: F.coalesce(1 / (1 + F.try_element_at(m, c)), F.lit(0.0))))
    proba = let(by_class, lambda w: let(total(w), lambda t: F.transform(w, lambda x: F.try_divide(x, t))))
    return d.withColumn("proba", proba).drop("_d", "profiles", "scale", "m")


def packed_calls(series: DataFrame, models: dict[int, tuple], n_classes: int, n_measures: int = len(MEASURES)) -> DataFrame:
    """``votes.mean_proba_call`` of ``profile_proba`` for rows that hold the windows of a series, without a row per window.

    ``series`` has (series_id, subject, cls, m, ms, cells): ``ms`` the measures of the windows, ``cells`` the numbers of the
    ``models`` (number: profiles, scale, as collected from ``fit_profiles``; the design bounds them). Returns (cell,
    series_id, subject, truth, m, pred, conf); numbers without a model give no row. The sums run in the order of the expressions.
    """
    types = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    fitted = {}
    for cell, (profiles, scale) in models.items():
        known = {p[0]: np.array(p[1], float) for p in profiles if None not in (p[1] or [None])}
        fitted[cell] = {} if None in (scale or [None]) else known, np.array(scale or [], float)

    def proba(x: np.ndarray, missing: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
        """Class probabilities of each window, and whether it has any."""
        profiles, scale = fitted[cell]
        q = np.zeros((n_classes, len(x)))
        for c, mu in profiles.items():
            if 0 <= c < n_classes:
                d = np.zeros(len(x))
                for i in range(n_measures):
                    z = (x[:, i] - mu[i]) / scale[i]
                    d = d + z * z
                q[c] = np.where(missing, 0.0, 1 / (1 + d))
        whole = np.zeros(len(x))
        for c in range(n_classes):
            whole = whole + q[c]
        return q / whole, whole != 0

    def task(batches):
        for batch in batches:
            ms, cells = batch.column("ms"), batch.column("cells")
            windows, size = ms.flatten(), np.diff(ms.offsets.to_numpy())
            values = windows.flatten()
            x = values.to_numpy(zero_copy_only=False).reshape(len(windows), n_measures)
            missing = values.is_null().to_numpy(zero_copy_only=False).reshape(len(windows), n_measures).any(axis=1)
            row, cell = np.repeat(np.arange(batch.num_rows), np.diff(cells.offsets.to_numpy())), cells.flatten().to_numpy()
            for c in np.unique(cell).tolist():
                if c not in fitted:
                    continue
                own = row[cell == c]
                of = np.repeat(np.arange(len(own)), size[own])  # the place in ``own`` of each window's series
                at = np.arange(len(of)) + np.repeat((np.cumsum(size) - size)[own] - (np.cumsum(size[own]) - size[own]), size[own])
                with np.errstate(all="ignore"):
                    p, has = proba(x[at], missing[at], c)
                    n = np.bincount(of[has], minlength=len(own))
                    mean = np.stack([np.bincount(of[has], p[k][has], len(own)) for k in range(n_classes)], axis=1) / n[:, None]
                none = n == 0
                same = [batch.column(name).take(pa.array(own)) for name in ("series_id", "subject", "cls", "m")]
                calls = [pa.array(mean.argmax(axis=1).astype(np.int32), mask=none), pa.array(mean.max(axis=1), mask=none)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c, np.int32)), *same, *calls], ["cell", "series_id", "subject", "truth", "m", "pred", "conf"])

    schema = f"cell int, series_id {types['series_id']}, subject {types['subject']}, truth {types['cls']}, m array<double>, pred int, conf double"
    return series.select("series_id", "subject", "cls", "m", "ms", "cells").mapInArrow(task, schema)


def class_weights(rows: DataFrame, n_classes: int | None = None) -> DataFrame:
    """Balanced weights n / (K * n_c), one row per class."""
    per = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n_rows"))
    tot = per.agg(F.sum("n_rows").alias("n"), F.count(F.lit(1)).alias("k"))
    n, k = tot.select("n").scalar(), F.lit(n_classes) if n_classes else tot.select("k").scalar()
    return per.withColumn("weight", n / (k * F.col("n_rows")))


def standardize(rows: DataFrame, stats_from: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(x - mean) / (sd + 1e-6) with population statistics of ``stats_from``, overall or per key."""
    aggs = [f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    if keys:
        d = rows.join(stats_from.groupBy(*keys).agg(*aggs), list(keys))
    else:
        one = stats_from.agg(F.struct(*aggs).alias("s")).scalar()
        d = rows.withColumn("_one", one).withColumns({f"_{n}_{c}": F.col("_one")[f"_{n}_{c}"] for c in cols for n in "ms"})
    out = d.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + F.lit(1e-6)) for c in cols})
    return out.drop("_one", *[f"_{n}_{c}" for c in cols for n in "ms"])


def ml_learner(kind: str, features: Sequence[str], seed: int = 1, trees: int = 300, max_iter: int = 300) -> Callable:
    """A ``fit_predict(train, test) -> test + proba`` closure around spark.ml, with balanced class weights.

    The test side stays lazy: the fitted model is a transformer in its plan.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    def fit_predict(train: DataFrame, test: DataFrame) -> DataFrame:
        # one row for each class of a classifier: they become a literal of the plan
        weights = {r["cls"]: r for r in class_weights(train).collect()}
        by_class = F.create_map(*[F.lit(x) for c, r in weights.items() for x in (c, r["weight"])])
        weighted = train.withColumns({"label": F.col("cls").cast("double"), "weight": F.element_at(by_class, F.col("cls"))})
        assemble = VectorAssembler(inputCols=list(features), outputCol="_raw")
        if kind == "forest":
            steps = [assemble, RandomForestClassifier(featuresCol="_raw", labelCol="label", weightCol="weight",
                                                      numTrees=trees, maxDepth=8, seed=seed, probabilityCol="_p")]
        elif kind == "logistic":
            scale = StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True)
            # L2 with C=1 on the summed loss is 1/n on spark.ml's averaged loss
            reg = 1.0 / sum(r["n_rows"] for r in weights.values())
            steps = [assemble, scale, LogisticRegression(featuresCol="_z", labelCol="label", weightCol="weight",
                                                         regParam=reg, elasticNetParam=0.0, maxIter=max_iter,
                                                         standardization=False, family="multinomial",
                                                         probabilityCol="_p")]
        else:
            raise ValueError(f"unknown learner {kind!r}")
        model = Pipeline(stages=steps).fit(weighted)
        out = model.transform(test).withColumn("proba", vector_to_array("_p"))
        return out.select(*test.columns, "proba")

    return fit_predict


def window_call(df: DataFrame) -> DataFrame:
    """Label of a single window: the first largest probability."""
    return df.withColumn("pred", first_argmax(F.col("proba")))


def profile_learner(n_classes: int) -> Callable:
    """The profile learner under the same contract: windows with a measure array in, probabilities out."""

    def fit_predict(train: DataFrame, test: DataFrame) -> DataFrame:
        model = fit_profiles(series_mean(train), []).select(F.struct("profiles", "scale").alias("s")).scalar()
        rows = test.withColumn("_model", model).select("*", "_model.profiles", "_model.scale").drop("_model")
        return proba_from_profiles(rows, n_classes)

    return fit_predict
