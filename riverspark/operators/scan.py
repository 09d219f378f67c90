"""Running values over a whole order: ranges first, then inside each range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverspark.columns import join_groups
from riverspark.session import cut_lineage


def in_ranges(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str = "_range", ranges: int | None = None
) -> DataFrame:
    """``df`` sorted apart into ranges of about equal size, numbered in the order of ``keys``, then ``order``.

    Without a number of ``ranges`` Spark chooses it by the size of the rows.  Rows alike in all of these share a range; a key may span many ranges.  The
    numbered rows are written once, since another evaluation may cut elsewhere.
    """
    columns = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *columns)
    return cut_lineage(dealt.withColumn(into, F.spark_partition_id()))


def running(
    ranged: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    into: str,
    value: Column,
    how: str = "sum",
    part: str = "_range",
) -> DataFrame:
    """Running sum or maximum of ``value`` up to each row of its key, over the table of ``in_ranges``.

    One value per range and key is carried forward; no window ever holds more than
    one range, or one row for each range.  Rows alike in ``keys`` and ``order`` get
    the same value.
    """
    whole, merge = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, F.greatest)}[how]
    rows = ranged.withColumn(into, value)
    carried = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per_range = rows.groupBy(*keys, part).agg(whole(into).alias("_value"))
    per_range = per_range.withColumn("_before", whole("_value").over(carried)).drop("_value")
    inside = whole(into).over(Window.partitionBy(*keys, part).orderBy(*order))
    rows = join_groups(rows.withColumn(into, inside), per_range, [*keys, part])
    joined = F.when(F.col("_before").isNull(), F.col(into)).otherwise(merge(F.col(into), F.col("_before")))
    return rows.withColumn(into, joined).drop("_before")
