"""Aggregates with the semantics of either mode.

``ansi`` is SQL's: nulls are skipped, nothing adds up to null. ``compat`` counts
every row and every distinct value, null among them, and adds nothing up to 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count(column: str | None = None, semantics: str = "ansi") -> Column:
    """COUNT(*) without a column, else COUNT(column)."""
    return F.count(F.lit(1) if column is None or semantics == "compat" else F.col(column))


def count_distinct(*columns: str, semantics: str = "ansi") -> Column:
    """Distinct tuples; under ansi a tuple with a null does not count."""
    if semantics == "compat":
        return F.count_distinct(F.struct(*columns))
    return F.count_distinct(*[F.col(c) for c in columns])


def total(column: str, semantics: str = "ansi") -> Column:
    return F.coalesce(F.sum(column), F.lit(0)) if semantics == "compat" else F.sum(column)


def average(column: str, semantics: str = "ansi") -> Column:
    return F.coalesce(F.avg(column), F.lit(0.0)) if semantics == "compat" else F.avg(column)


def exemplar(column: str, order: str) -> Column:
    """A column that is not grouped by: its value in the group's first row by ``order``."""
    return F.min_by(column, order)
