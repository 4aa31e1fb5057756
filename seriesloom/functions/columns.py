"""Scalar column expressions of the cohort vocabulary (no joins, no shuffles)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: text of the rule that drops sets with at most one repetition
FEW_REPS_REASON = "rep_count<=1"


def exclude_reason(rep_count: str | Column, error: str | Column) -> Column:
    """A quality error wins over the repetition rule; empty when the row is kept."""
    rep_count = F.col(rep_count) if isinstance(rep_count, str) else rep_count
    error = F.col(error) if isinstance(error, str) else error
    return (F.when(F.coalesce(error, F.lit("")) != "", error)
            .when(rep_count <= 1, FEW_REPS_REASON).otherwise(""))


def magnitude(*axes: str) -> Column:
    """Euclidean norm of the given axes."""
    return F.sqrt(reduce(lambda a, b: a + b, [F.col(a) * F.col(a) for a in axes]))


def recode_prefix(col: str, prefix: str, label: str) -> Column:
    """Collapse every value that starts with ``prefix`` into one label."""
    return F.when(F.col(col).startswith(prefix), label).otherwise(F.col(col))


def pretty_label(col: str, strip: str = "BB_", exceptions: dict[str, str] | None = None) -> Column:
    """'BENCH_PRESS' -> 'Bench Press': drop a prefix, underscores to blanks, capitalise, then fixed exceptions."""
    text = F.initcap(F.replace(F.replace(F.col(col), F.lit(strip), F.lit("")), F.lit("_"), F.lit(" ")))
    for old, new in (exceptions or {}).items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def class_list(col: str) -> Column:
    """'0,6' -> array(0, 6); entries that are no numbers become NULL."""
    return F.transform(F.split(col, ","), lambda c: F.trim(c).try_cast("int"))


def overlaps_any(families: str, list_of_families: str) -> Column:
    """True if the set shares an element with any set of the list."""
    return F.exists(list_of_families, lambda other: F.arrays_overlap(other, F.col(families)))


def pair_low(a: str, b: str) -> Column:
    return F.least(a, b)


def pair_high(a: str, b: str) -> Column:
    return F.greatest(a, b)


def half_even(x: Column) -> Column:
    """Round half to even to a whole number, as numpy and Python do."""
    return F.rint(x)


def normal_two_sided(z: Column) -> Column:
    """Two-sided tail of the standard normal, by the rational error-function approximation
    of Abramowitz & Stegun 7.1.26 (absolute error below 1.5e-7)."""
    # fixed values: published coefficients
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = 1 / (1 + F.lit(p) * x)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + F.lit(c)) * t
    return F.when(z.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), poly * F.exp(-x * x))))
