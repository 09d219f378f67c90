"""Ordered operations on keyed daily series.

A long record is never handed to one task as a whole: rows are windowed inside
(key, year) segments, and only one summary row per segment is windowed per key.
A NULL key is a series of its own.  A day that occurs twice keeps both rows; it
never adds days.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverspark.columns import as_list, join_groups

SEGMENT = "segment"

# Per-key totals to carry along: name -> (aggregate of a segment, how segments combine).
Totals = Mapping[str, tuple[Column, Callable[[str], Column]]]


def with_next(
    df: DataFrame, key: str | Iterable[str], date: str, value: str, totals: Totals | None = None
) -> DataFrame:
    """Add ``segment`` (the year), ``next_date`` and ``next_value``, the following row.

    Inside a calendar year this is a plain ``lead``.  The last row of a year takes
    the first row of the next year that has any.  ``totals`` adds per-key results;
    they travel with the segment summaries, so the rows are joined on (key, year)
    and never gathered by key.
    """
    keys = as_list(key)
    totals = totals or {}
    # Said once for both branches below, so that they share one scan and exchange.
    rows = df.withColumn(SEGMENT, F.year(date)).filter(F.col(date).isNotNull())
    inside = Window.partitionBy(*keys, SEGMENT).orderBy(date)
    whole = Window.partitionBy(*keys)
    across = whole.orderBy(SEGMENT)
    segments = (
        rows.groupBy(*keys, SEGMENT)
        .agg(
            F.min(date).alias("_d"),
            F.min_by(value, date).alias("_v"),
            *(part.alias(f"_t_{name}") for name, (part, _) in totals.items()),
        )
        .select(
            *keys,
            SEGMENT,
            F.lead("_d").over(across).alias("_head_date"),
            F.lead("_v").over(across).alias("_head_value"),
            *(
                combine(f"_t_{name}").over(whole).alias(name)
                for name, (_, combine) in totals.items()
            ),
        )
    )
    linked = rows.withColumn("_lead_date", F.lead(date).over(inside)).withColumn(
        "_lead_value", F.lead(value).over(inside)
    )
    return (
        join_groups(linked, segments, [*keys, SEGMENT], "left")
        .withColumn("next_date", F.coalesce("_lead_date", "_head_date"))
        .withColumn(
            "next_value",
            F.when(F.col("_lead_date").isNotNull(), F.col("_lead_value")).otherwise(
                F.col("_head_value")
            ),
        )
        .drop("_lead_date", "_lead_value", "_head_date", "_head_value")
    )


def _one_row_per_day(
    observed: DataFrame, keys: list[str], date: str, value: str, totals: Totals | None = None
) -> DataFrame:
    """Repeat each observation for the days up to the next one; ``_step`` counts them."""
    linked = with_next(observed, keys, date, value, totals)
    # The first of two rows of one day has no days to fill.
    gap = F.greatest(F.datediff("next_date", date), F.lit(1))
    return linked.select(
        *keys,
        SEGMENT,
        F.col(date).alias("_from"),
        F.col(value).alias("_value"),
        F.col("next_value").alias("_next"),
        gap.alias("_gap"),
        *(totals or {}),
        F.explode(F.sequence(F.lit(0), gap - 1)).alias("_step"),
    )


def densify_daily(df: DataFrame, key: str | Iterable[str], date: str, value: str) -> DataFrame:
    """H1: one row per day from the first to the last non-NULL value of each key.

    Leading and trailing NULLs vanish, days without a value inside the record
    appear as NULL.
    """
    keys = as_list(key)
    observed = df.filter(F.col(value).isNotNull() & F.col(date).isNotNull()).select(
        *keys, date, value
    )
    return _one_row_per_day(observed, keys, date, value).select(
        *keys,
        F.date_add("_from", F.col("_step")).alias(date),
        F.when(F.col("_step") == 0, F.col("_value")).alias(value),
    )


def fill_linear(
    df: DataFrame, key: str | Iterable[str], date: str, value: str, totals: Totals | None = None
) -> DataFrame:
    """One row per day like :func:`densify_daily`, gaps filled on a straight line.

    Adds ``observed``, ``segment`` (year of the observation a day goes back to) and
    the given per-key totals of the observed rows.
    """
    keys = as_list(key)
    observed = df.filter(F.col(value).isNotNull() & F.col(date).isNotNull())
    slope = (F.col("_next") - F.col("_value")) / F.col("_gap")
    return _one_row_per_day(observed, keys, date, value, totals).select(
        *keys,
        F.date_add("_from", F.col("_step")).alias(date),
        F.when(F.col("_step") == 0, F.col("_value"))
        .otherwise(F.col("_value") + slope * F.col("_step"))
        .alias(value),
        (F.col("_step") == 0).alias("observed"),
        SEGMENT,
        *(totals or {}),
    )


def runs_of_days(
    df: DataFrame, key: str | Iterable[str], date: str, value: str, highest: bool = True
) -> DataFrame:
    """Runs of consecutive days among the given rows.

    Returns key, ``start``, ``end``, ``duration`` (days), ``extreme`` (largest or
    smallest value) and ``extreme_date`` (its first day).  Runs are found inside
    calendar years; only runs that touch a year's first or last day can go on in
    another year, and only those are stitched per key.
    """
    keys = as_list(key)
    inside = Window.partitionBy(*keys, SEGMENT).orderBy(date)
    sign = 1 if highest else -1
    pick = F.struct((F.col(value) * sign).alias("v"), F.datediff(F.lit("1970-01-01"), date))
    parts = (
        df.select(*keys, date, value)
        .withColumn(SEGMENT, F.year(date))
        .withColumn("_run", F.date_sub(date, F.dense_rank().over(inside)))
        .groupBy(*keys, SEGMENT, "_run")
        .agg(
            F.min(date).alias("start"),
            F.max(date).alias("end"),
            (F.datediff(F.max(date), F.min(date)) + 1).cast("long").alias("duration"),
            (F.max if highest else F.min)(value).alias("extreme"),
            F.max_by(date, pick).alias("extreme_date"),
        )
    )
    year = F.col(SEGMENT)
    at_edge = (F.col("start") == F.make_date(year, F.lit(1), F.lit(1))) | (
        F.col("end") == F.make_date(year, F.lit(12), F.lit(31))
    )
    columns = [*keys, "start", "end", "duration", "extreme", "extreme_date"]
    whole = parts.filter(~at_edge).select(*columns)

    across = Window.partitionBy(*keys).orderBy("start")
    starts_new = F.coalesce(F.datediff("start", F.lag("end").over(across)) > 1, F.lit(True))
    first_extreme = F.struct(
        (F.col("extreme") * sign).alias("v"), F.datediff(F.lit("1970-01-01"), "extreme_date")
    )
    stitched = (
        parts.filter(at_edge)
        .withColumn("_new", starts_new.cast("int"))
        .withColumn("_run", F.sum("_new").over(across))
        .groupBy(*keys, "_run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("duration").alias("duration"),
            (F.max if highest else F.min)("extreme").alias("extreme"),
            F.max_by("extreme_date", first_extreme).alias("extreme_date"),
        )
        .select(*columns)
    )
    return whole.unionByName(stitched)
