"""Completeness of daily records without their calendars.

The days of a record are those from its first to its last value.  How many of them
a month lacks follows from that interval and the days observed, so the screens read
one row per key and month, and a calendar of days is built only for the keys that
pass.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverspark.columns import as_list, join_groups
from riverspark.functions import mid_month, row_count

_PART = ["year", "month"]


def observed_months(
    df: DataFrame, key: str | Iterable[str], date: str, value: str, lo=None, hi=None, first_days: DataFrame | None = None
) -> DataFrame:
    """Per key and month: first and last day with a value, and days, rows and sum of values inside the window.

    One partial aggregate over the raw rows.  The window is ``lo`` to ``hi``, both
    included, and never starts before ``_first_day`` of the key in ``first_days``.
    """
    keys = as_list(key)
    rows = df.filter(F.col(value).isNotNull() & F.col(date).isNotNull()).select(*keys, date, value)
    if first_days is not None:
        rows = rows.join(first_days, keys, "left")
    inside = _inside(F.col(date), lo, hi, F.col("_first_day") if first_days is not None else None)
    day = F.expr(f"shiftleft(1, day(`{date}`) - 1)")
    return rows.groupBy(*keys, F.year(date).alias("year"), F.month(date).alias("month")).agg(
        F.min(date).alias("_first"),
        F.max(date).alias("_last"),
        F.count_if(inside).alias("_rows"),
        F.bit_count(F.bit_or(F.when(inside, day).otherwise(0))).alias("_days"),
        F.avg(F.when(inside, F.col(value))).alias("_mean"),
    )


def _inside(day: Column, lo, hi, first: Column | None) -> Column:
    test = F.lit(True)
    if lo is not None:
        test &= day >= F.lit(lo)
    if hi is not None:
        test &= day <= F.lit(hi)
    return test if first is None else test & (first.isNull() | (day >= first))


def record_ranges(months: DataFrame, key: str | Iterable[str]) -> DataFrame:
    """First and last day with a value per key, from ``observed_months``."""
    ranges = months.groupBy(*as_list(key)).agg(F.min("_first").alias("start"), F.max("_last").alias("end"))
    return ranges.withColumn("length_years", F.datediff("end", "start") / 365)


def record_months(
    months: DataFrame,
    key: str | Iterable[str],
    value: str,
    max_missing: int = 10,
    lo=None,
    hi=None,
    first_days: DataFrame | None = None,
) -> DataFrame:
    """Per key and month of the record its mean, NULL when more than ``max_missing`` days lack a value.

    Takes ``observed_months`` of the same window.  ``n`` counts the month's days
    inside record and window, a day of two rows twice, ``n_missing`` those without
    a value; months without any value are listed as well.
    """
    keys = as_list(key)
    record = record_ranges(months, keys).drop("length_years")
    if first_days is not None:
        record = record.join(first_days, keys, "left").withColumn("start", F.greatest("start", "_first_day"))
    record = record.withColumn("start", F.greatest("start", F.lit(lo)) if lo is not None else F.col("start"))
    record = record.withColumn("end", F.least("end", F.lit(hi)) if hi is not None else F.col("end"))
    each = F.explode(F.expr("sequence(trunc(start, 'MM'), trunc(end, 'MM'), interval 1 month)")).alias("_month")
    calendar = record.filter("start <= end").select(*keys, "start", "end", each).select(
        *keys,
        F.year("_month").alias("year"),
        F.month("_month").alias("month"),
        (F.datediff(F.least("end", F.last_day("_month")), F.greatest("start", "_month")) + 1).alias("_span"),
    )
    held = join_groups(calendar, months.select(*keys, *_PART, "_rows", "_days", "_mean"), [*keys, *_PART], "left")
    days, rows = F.coalesce("_days", F.lit(0)), F.coalesce("_rows", F.lit(0))
    missing = (F.col("_span") - days).cast("bigint")
    return held.select(
        *keys,
        *_PART,
        F.when(missing <= max_missing, F.col("_mean")).alias(value),
        missing.alias("n_missing"),
        mid_month("year", "month").alias("date"),
        (missing + rows).cast("bigint").alias("n"),
    )


def record_share(months: DataFrame, key: str | Iterable[str], max_share: float | None = 0.3) -> DataFrame:
    """D3: days of the record, days without a value and their share per key; keeps shares above the limit."""
    share = months.groupBy(*as_list(key)).agg(F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing"))
    share = share.withColumn("share", F.col("n_missing") / F.col("n"))
    return share if max_share is None else share.filter(F.col("share") > max_share)
