"""Aggregate expressions with explicit rules for missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_count() -> Column:
    """Number of rows, rows with NULL values included."""
    return F.count(F.lit(1))


def missing_count(value: str) -> Column:
    """Number of rows whose ``value`` is NULL."""
    return F.count(F.lit(1)) - F.count(value)


def _unless_missing(value: str, aggregate: Column) -> Column:
    return F.when(F.count(value) == F.count(F.lit(1)), aggregate)


def strict_avg(value: str) -> Column:
    """Mean that is NULL as soon as one value of the group is NULL."""
    return _unless_missing(value, F.avg(value))


def strict_sum(value: str) -> Column:
    """Sum that is NULL as soon as one value of the group is NULL."""
    return _unless_missing(value, F.sum(value))


def weighted_avg(value: str, weight: str) -> Column:
    """Mean of ``value`` weighted by ``weight``; NULL when the weights sum to zero."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    return F.try_divide(
        F.sum(F.when(both, F.col(value) * F.col(weight))), F.sum(F.when(both, F.col(weight)))
    )
