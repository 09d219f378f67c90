"""Small helpers for column-name arguments."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_list(names: str | Iterable[str] | None) -> list[str]:
    """A column-name argument as a list: one name, many names or none."""
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def join_groups(left: DataFrame, right: DataFrame, keys: str | Iterable[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL equals NULL, as grouping has it; key columns come from ``left``."""
    names = as_list(keys)
    rest = [c for c in right.columns if c not in names]
    right = right.select(*(F.col(k).alias(f"_right_{k}") for k in names), *rest)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in names))
    return left.join(right, same, how).drop(*(f"_right_{k}" for k in names))
