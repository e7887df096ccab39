"""Status bands and grades of quality metrics (items 20-23)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Name part, then the largest value still GOOD and still WARNING.
# Zero is always EXCELLENT; the first matching part decides.
STATUS_LIMITS = [("NULL_COUNT", 5, 20), ("DUPLICATE_COUNT", 3, 10), ("INVALID", 2, 10)]
STATUS_NAMES = ["EXCELLENT", "GOOD", "WARNING", "CRITICAL", "UNKNOWN"]

# Name part and the flag raised when the value is above zero.
STATUS_FLAGS = [
    ("INVALID", "ATTENTION_REQUIRED"),
    ("NULL_COUNT", "DATA_COMPLETENESS_ISSUE"),
    ("DUPLICATE", "DATA_UNIQUENESS_ISSUE"),
]

# Points per status in the entity score.
STATUS_POINTS = {"EXCELLENT": 100, "GOOD": 80, "WARNING": 60, "CRITICAL": 20}

# Grade and the least score or percentage for it.
QUALITY_GRADES = [("EXCELLENT", 90), ("GOOD", 75), ("NEEDS_ATTENTION", 60)]
INTEGRITY_GRADES = [("EXCELLENT", 98), ("GOOD", 95), ("NEEDS_ATTENTION", 90)]
LOWEST_GRADE = "CRITICAL"


def dq_status_band(metric: Column, value: Column) -> Column:
    """Item 20. Metrics of no known family, such as row counts, are UNKNOWN."""
    out = None
    for part, good, warning in STATUS_LIMITS:
        band = (
            F.when(value == 0, "EXCELLENT").when(value <= good, "GOOD")
            .when(value <= warning, "WARNING").otherwise("CRITICAL")
        )
        out = F.when(metric.contains(part), band) if out is None else out.when(metric.contains(part), band)
    return out.otherwise("UNKNOWN")


def dq_status_flag(metric: Column, value: Column) -> Column:
    """Item 21."""
    out = None
    for part, flag in STATUS_FLAGS:
        cond = metric.contains(part) & (value > 0)
        out = F.when(cond, flag) if out is None else out.when(cond, flag)
    return out.otherwise("OK")


def _grade(value: Column, grades: list[tuple[str, int]]) -> Column:
    out = None
    for name, least in grades:
        out = F.when(value >= least, name) if out is None else out.when(value >= least, name)
    return out.otherwise(LOWEST_GRADE)


def quality_grade(score: Column) -> Column:
    """Item 22."""
    return _grade(score, QUALITY_GRADES)


def integrity_grade(percent: Column) -> Column:
    """Item 23."""
    return _grade(percent, INTEGRITY_GRADES)
