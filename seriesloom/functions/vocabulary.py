"""Fixed vocabulary of the exercise domain and the mapping expressions built from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Movement families, category maps, name patterns.
FAMILIES = {
    0: ["squat"], 1: ["push"], 2: ["squat"], 3: ["cardio"], 4: ["push"], 5: ["hinge"], 6: ["hinge"], 7: ["overhead"],
    8: ["squat"], 9: ["arm", "pull"], 10: ["overhead"], 11: ["hinge", "pull"], 12: ["cardio"], 13: ["core"],
    14: ["arm", "overhead"],
}
REGION = {"lower": [0, 2, 5, 6, 8], "upper": [1, 4, 7, 9, 10, 11, 14], "full body": [3, 12], "core": [13]}
PATTERN = {"squat": [0, 2, 8], "hinge": [5, 6], "upper push": [1, 4, 7, 10], "upper pull": [9, 11],
           "shoulder isolation": [14], "conditioning": [3, 12], "core": [13]}
PUSHPULL = {"push": [1, 4, 7, 10], "pull": [9, 11]}
NAMED_BATTERIES = {"squat_deadlift": (0, 6), "pushup_pushpress": (1, 7)}
LABEL_EXCEPTIONS = {"Leg Raised Crunch": "Leg-raise crunch"}
SERIES_NAME = r"^([^_]+)_(\d{4})_(\d{4})_(\d{6})_segment(\d+)_(\d{2})$"
OTHER = "other"


def category(col: str | Column, mapping: dict[str, list[int]]) -> Column:
    """Category of a class from a map literal; NULL where the class is in none."""
    col = F.col(col) if isinstance(col, str) else col
    entries = [F.lit(x) for name, classes in mapping.items() for c in classes for x in (c, name)]
    return F.try_element_at(F.create_map(*entries), col.cast("int"))


def families(col: str | Column) -> Column:
    """Movement families of a class as array<string>."""
    col = F.col(col) if isinstance(col, str) else col
    entries = [x for c, fam in FAMILIES.items() for x in (F.lit(c), F.array(*[F.lit(f) for f in fam]))]
    return F.try_element_at(F.create_map(*entries), col.cast("int"))
