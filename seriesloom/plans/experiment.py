"""The learning-curve grid as one job: plan, fit every condition, vote, score."""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.arrays import let
from seriesloom.operators import features as FE
from seriesloom.operators import learn as L
from seriesloom.operators import scores as S
from seriesloom.operators import votes as V
from seriesloom.plans import cohort as P
from seriesloom.session import bounded_broadcast, materialize
from seriesloom.sources import adapters as AD

WINDOW_S, OVERLAP = 1.0, 0.75
COND = ["repeat", "n_team", "k"]


def saved_roles(spark: SparkSession, sf_dir: str, design: P.Design = P.Design()) -> DataFrame:
    """The roles of the largest team (a table bounded by the design), written once: everything else filters by them."""
    return materialize(lambda: P.team_roles(pool_roles(spark, sf_dir, design), design), spark, ("roles", sf_dir, *astuple(design)))


def pool_roles(spark: SparkSession, sf_dir: str, design: P.Design = P.Design()) -> DataFrame:
    """The roles of the whole pool."""
    return P.make_roles(AD.vector_bouts(spark, sf_dir), design)


def cohort_signals(spark: SparkSession, sf_dir: str, roles: DataFrame | None = None, max_roles: int = 0) -> DataFrame:
    """Packed signals, cut down map-side to the drawn subjects before anything is computed on them."""
    s = AD.signals(spark, sf_dir)
    if roles is None:
        return s
    return s.join(bounded_broadcast(roles.select("subject").distinct(), max_roles), "subject", "left_semi")


def windows_of(signals: DataFrame) -> DataFrame:
    """Windows with their measure array ``m``."""
    return L.window_measures(FE.sliding_windows(signals, WINDOW_S, OVERLAP, AD.FS))


def packed_windows(signals: DataFrame) -> DataFrame:
    """One row per series with the measures of its windows, in order: (series_id, subject, cls, ms).

    The windows are those of ``windows_of``; rows of one series are put together, series without a whole window left out.
    """
    length, step = FE.window_shape(WINDOW_S, OVERLAP, AD.FS)
    n = F.size(F.get("ch", F.lit(0)))
    cut = lambda ch, a: F.transform(ch, lambda c: F.slice(c, a + 1, F.lit(length)))
    starts = lambda ch: F.sequence(F.lit(0), F.size(F.get(ch, F.lit(0))) - length, F.lit(step))
    d = signals.where(n >= length).groupBy("series_id", "subject", "cls").agg(F.collect_list("ch").alias("_chs"))
    ms = F.flatten(F.transform("_chs", lambda ch: F.transform(starts(ch), lambda a: let(cut(ch, a), L.measures))))
    return d.select("series_id", "subject", "cls", ms.alias("ms"))


def cohort_windows(spark: SparkSession, sf_dir: str, roles: DataFrame | None = None, max_roles: int = 0) -> DataFrame:
    return windows_of(cohort_signals(spark, sf_dir, roles, max_roles))


def training_series(spark: SparkSession, sf_dir: str, train: DataFrame, max_train: int) -> DataFrame:
    """Series measures of the training series only: (series_id, subject, cls, m)."""
    ids = bounded_broadcast(train.select("series_id").distinct(), max_train)
    return L.series_mean(windows_of(AD.signals(spark, sf_dir).join(ids, "series_id", "left_semi")))


def grid_profiles(series: DataFrame, train: DataFrame, design: P.Design) -> DataFrame:
    """Profiles of every condition in one aggregation."""
    rows = series.join(bounded_broadcast(train.select(*COND, "series_id"), design.max_train), "series_id")
    return L.fit_profiles(rows, COND)


def grid_proba(spark: SparkSession, sf_dir: str, design: P.Design) -> DataFrame:
    """Window probabilities of every test series under every condition."""
    bouts = AD.vector_bouts(spark, sf_dir)
    roles = saved_roles(spark, sf_dir, design)
    train = P.train_sets(P.nested_set_order(bouts, roles, design), design)
    profiles = grid_profiles(training_series(spark, sf_dir, train, design.max_train), train, design)
    r = roles.withColumn("_cells", F.filter(
        P.cells(design), lambda c: (F.col("role") == "new") | (c["n_team"] >= F.col("rank"))))
    r = r.select("repeat", "subject", F.when(F.col("role") == "new", "new").otherwise("recorded").alias("role"), "_cells")
    # each test series is windowed once, then fans out to its conditions map-side: the role table is bounded by
    # the design, so windows are not shuffled before the vote
    windows = windows_of(cohort_signals(spark, sf_dir, roles, design.max_roles).where("period_order > 1"))
    test = (windows.join(bounded_broadcast(r, design.max_roles), "subject").select("series_id", "subject", "cls", "w", "t0_s", "m", "repeat", "role", F.explode("_cells").alias("_c"))
            .select("*", "_c.n_team", "_c.k").drop("_c"))
    return L.profile_proba(test, profiles, COND, design.n_classes, design.max_conditions)


def saved_proba(spark: SparkSession, sf_dir: str, design: P.Design = P.Design()) -> DataFrame:
    """``grid_proba`` written once per session and parameters."""
    return materialize(lambda: grid_proba(spark, sf_dir, design), spark, ("proba", sf_dir, *astuple(design)))


def saved_predictions(spark: SparkSession, sf_dir: str, design: P.Design = P.Design()) -> DataFrame:
    """Series predictions of the whole grid, written once per session and parameters."""
    return materialize(lambda: V.vote_series(saved_proba(spark, sf_dir, design), [*COND, "role"], design.n_classes),
                       spark, ("predictions", sf_dir, *astuple(design)))


def scores_of(spark: SparkSession, sf_dir: str, windows: DataFrame, design: P.Design = P.Design(), n_measures: int = len(L.MEASURES),
              train: DataFrame | None = None, test: DataFrame | None = None, fit=L.fit_profiles) -> DataFrame:
    """Subject scores on other windows (series_id, subject, cls, period_order, w, t0_s, m), or for other training and test sets.

    The classes of the training series are those of ``train``, which may be pseudo-labels.
    """
    ship = (lambda df: bounded_broadcast(df, design.max_train)) if train is None else (lambda df: df)  # only the plan's own sets are bounded
    bouts, roles = AD.vector_bouts(spark, sf_dir), saved_roles(spark, sf_dir, design)
    train = P.train_sets(P.nested_set_order(bouts, roles, design), design) if train is None else train
    series = L.series_mean(windows.join(ship(train.select("series_id").distinct()), "series_id", "left_semi"), n_measures)
    rows = series.drop("cls").join(ship(train.select(*COND, "series_id", "cls")), "series_id")
    test = (P.test_sets(bouts, roles, design) if test is None else test).select(*COND, "role", "series_id")
    proba = L.profile_proba(windows.join(test, "series_id"), fit(rows, COND, n_measures), COND, design.n_classes, design.max_conditions)
    return S.subject_scores(V.vote_series(proba, [*COND, "role"], design.n_classes), [*COND, "role", "subject"], design.n_classes)


def grid_scores(spark: SparkSession, sf_dir: str, design: P.Design = P.Design()) -> DataFrame:
    """Subject scores of the whole grid."""
    return S.subject_scores(saved_predictions(spark, sf_dir, design), [*COND, "role", "subject"], design.n_classes)
