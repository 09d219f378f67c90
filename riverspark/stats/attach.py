"""Give every row the values of a small per-group table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.columns import join_groups
from riverspark.session import cut_lineage

#: Tables of so few groups may be broadcast.
_FEW_GROUPS = 10_000


def attach(rows: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on ``keys``, NULL groups included; without keys ``small`` has one row, read as scalar subqueries."""
    if keys:
        return join_groups(rows, small, keys)
    return rows.withColumns({c: small.select(c).scalar() for c in small.columns})


def per_group(small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A table of one row per group, written once, for ``attach``.

    Where groups are few it is broadcast: a join would deal all rows of a group to one task.
    """
    small = cut_lineage(small)
    return F.broadcast(small) if keys and small.count() <= _FEW_GROUPS else small
