"""Wide and long forms, grouping sets and period pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.columns import join_groups
from riverspark.functions import percent_change, row_count


def to_wide(
    df: DataFrame, ids: Sequence[str], names: str, values: str, levels: Sequence[str]
) -> DataFrame:
    """One column per level; ``levels`` are given, so no extra job looks them up.

    Fails when a cell has more than one non-NULL value.
    """
    one = F.when(F.count(values) <= 1, F.first(values, ignorenulls=True)).otherwise(
        F.raise_error(F.lit("more than one value for a cell")).cast(df.schema[values].dataType)
    )
    return df.groupBy(*ids).pivot(names, list(levels)).agg(one)


def to_long(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value"
) -> DataFrame:
    """One row per listed column."""
    return df.unpivot(list(ids), list(columns), name, value)


def grouped_means(
    df: DataFrame, sets: Sequence[Sequence[str]], columns: dict[str, str]
) -> DataFrame:
    """Means under several groupings, with NULL for the keys a grouping lacks.

    ``columns`` maps value columns to result names.
    """
    keys: list[str] = []
    for group in sets:
        keys += [k for k in group if k not in keys]
    # Each grouping needs its own complete keys, else a NULL key of the data
    # could not be told from a key the grouping lacks.
    return df.groupingSets([[F.col(k) for k in g] for g in sets], *map(F.col, keys)).agg(
        *(F.avg(c).alias(out) for c, out in columns.items())
    )


def paired_only(
    df: DataFrame, ids: Sequence[str], variable: str, period: str, value: str
) -> DataFrame:
    """Rows of (id, variable) groups that hold exactly two non-NULL periods."""
    present = df.filter(F.col(value).isNotNull())
    pairs = (
        present.groupBy(*ids, variable).agg(row_count().alias("_n")).filter("_n = 2").drop("_n")
    )
    return join_groups(present, pairs, [*ids, variable], "left_semi")


def period_difference(
    df: DataFrame,
    ids: Sequence[str],
    variable: str,
    period: str,
    value: str,
    recent: str,
    historical: str,
) -> DataFrame:
    """Both periods side by side with absolute and relative change.

    Groups without exactly one value in each period are dropped.
    """
    now, before = F.col(period) == recent, F.col(period) == historical
    present = df.filter(F.col(value).isNotNull())
    wide = present.groupBy(*ids, variable).agg(
        row_count().alias("_n"),
        F.max(F.when(now, F.col(value))).alias("recent"),
        F.max(F.when(before, F.col(value))).alias("historical"),
    )
    return (
        wide.filter("_n = 2 AND recent IS NOT NULL AND historical IS NOT NULL")
        .drop("_n")
        .withColumn("diff", F.col("recent") - F.col("historical"))
        .withColumn("diff_percent", percent_change("recent", "historical"))
    )
