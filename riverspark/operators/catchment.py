"""Catchment attributes: dominant class, remainder class, metadata table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.functions import recode, threshold_class
from riverspark.operators.clean import assemble, top_by
from riverspark.session import cut_lineage


def dominant_class(
    df: DataFrame,
    key: str,
    share: str,
    class_col: str,
    ties: bool = True,
    merge: dict[str, str] | None = None,
    merge_first: bool = False,
) -> DataFrame:
    """Class with the largest share per key.

    ``merge`` relabels classes, after the choice by default, so that the merged
    classes compete separately; ``merge_first=True`` adds their shares up before.
    """
    if merge and merge_first:
        df = (
            df.withColumn(class_col, recode(class_col, merge))
            .groupBy(key, class_col)
            .agg(F.sum(share).alias(share))
        )
    # The largest share is compared with the shares again, so both must be the same numbers.
    top = top_by(cut_lineage(df), key, share, ties, [F.col(class_col)])
    if merge and not merge_first:
        top = top.withColumn(class_col, recode(class_col, merge))
    return top


def fill_remainder(
    df: DataFrame,
    key: str,
    class_col: str,
    share: str,
    label: str,
    area: str | None = None,
    whole: float = 100.0,
    tolerance: float = 1e-9,
) -> DataFrame:
    """Add a class with the missing share where shares sum to less than the whole.

    A remainder up to ``tolerance`` of the whole is rounding, not a class.
    """
    rest = (
        df.groupBy(key)
        .agg(F.sum(share).alias("_sum"))
        .filter(F.col("_sum") < whole * (1 - tolerance))
        .select(key, F.lit(label).alias(class_col), (F.lit(whole) - F.col("_sum")).alias(share))
    )
    if area is not None:
        rest = rest.withColumn(area, F.lit(0.0))
    return df.unionByName(rest, allowMissingColumns=True)


def catchment_table(
    tables: Sequence[DataFrame],
    key: str,
    defaults: dict[str, object] | None = None,
    required: str | None = None,
    classify: dict[str, tuple[str, float, str, str]] | None = None,
) -> DataFrame:
    """One wide row per key from many attribute tables.

    ``defaults`` fills NULLs, ``required`` drops rows without that attribute, and
    ``classify`` maps a new column to (source, cut, label below, label above).
    """
    wide = assemble(tables, key)
    if required is not None:
        wide = wide.filter(F.col(required).isNotNull())
    for column, value in (defaults or {}).items():
        wide = wide.withColumn(column, F.coalesce(F.col(column), F.lit(value)))
    for column, (source, cut, below, above) in (classify or {}).items():
        wide = wide.withColumn(column, threshold_class(source, cut, below, above))
    return wide
