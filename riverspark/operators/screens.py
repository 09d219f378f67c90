"""Record-length, completeness and gap screens, and the station choice built on them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverspark.columns import as_list
from riverspark.functions import mid_month, missing_count, row_count
from riverspark.operators import intervals
from riverspark.operators.clean import apply_trim_rules, clip_period, drop_keys, first_good_days, keep_keys
from riverspark.operators.series import densify_daily
from riverspark.session import cut_lineage


def series_range(df: DataFrame, key: str | Iterable[str], date: str) -> DataFrame:
    """First and last date per key, and the length in years of 365 days."""
    return (
        df.groupBy(*as_list(key))
        .agg(F.min(date).alias("start"), F.max(date).alias("end"))
        .withColumn("length_years", F.datediff("end", "start") / 365)
    )


def range_extremes(ranges: DataFrame) -> DataFrame:
    """Latest start and earliest end over all keys."""
    return ranges.agg(F.max("start").alias("latest_start"), F.min("end").alias("earliest_end"))


def eligible_by_range(
    df: DataFrame, key: str | Iterable[str], date: str, start_before, end_after
) -> DataFrame:
    """Ranges of the keys that start early enough and end late enough."""
    return in_time(series_range(df, key, date), start_before, end_after)


def in_time(ranges: DataFrame, start_before, end_after) -> DataFrame:
    """Ranges that start before one day and end after another."""
    return ranges.filter(
        (F.col("start") < F.lit(start_before)) & (F.col("end") > F.lit(end_after))
    )


def missing_share(
    df: DataFrame, keys: str | Iterable[str], value: str, max_share: float | None = 0.3
) -> DataFrame:
    """Rows, NULL rows and their share per key; keeps shares above the limit.

    ``max_share=None`` reports every key.
    """
    share = (
        df.groupBy(*as_list(keys))
        .agg(row_count().alias("n"), missing_count(value).alias("n_missing"))
        .withColumn("share", F.col("n_missing") / F.col("n"))
    )
    return share if max_share is None else share.filter(F.col("share") > max_share)


def monthly_mean(
    df: DataFrame, key: str | Iterable[str], date: str, value: str, max_missing: int = 10
) -> DataFrame:
    """Mean per month, NULL when more than ``max_missing`` of its days are NULL."""
    return _months(df, key, date, value, max_missing).drop("n")


def _months(df: DataFrame, key: str | Iterable[str], date: str, value: str, max_missing: int) -> DataFrame:
    """:func:`monthly_mean` of a densified series, with the number of rows ``n``."""
    return (
        df.groupBy(
            *as_list(key), F.year(date).alias("year"), F.month(date).alias("month")
        )
        .agg(
            F.when(missing_count(value) <= max_missing, F.avg(value)).alias(value),
            missing_count(value).alias("n_missing"),
            row_count().alias("n"),
        )
        .withColumn("date", mid_month("year", "month"))
    )


def gap_islands(
    df: DataFrame,
    keys: str | Iterable[str],
    order: str,
    max_step: int,
    min_len: int | None = 4,
) -> DataFrame:
    """Islands among rows, split where ``order`` jumps by more than ``max_step``.

    ``order`` is a year number or a date (steps in days).  Give it the NULL months
    only: the input is then at most one row per key and month.  Keeps islands with
    more than ``min_len`` rows; ``None`` keeps all.
    """
    names = as_list(keys)
    along = Window.partitionBy(*names).orderBy(order)
    is_date = df.schema[order].dataType.typeName() == "date"
    previous = F.lag(order).over(along)
    step = F.datediff(order, previous) if is_date else F.col(order) - previous
    islands = (
        df.withColumn("_new", F.coalesce((step > max_step).cast("int"), F.lit(1)))
        .withColumn("island", F.sum("_new").over(along))
        .groupBy(*names, "island")
        .agg(
            row_count().alias("n"),
            F.min(order).alias("gap_start"),
            F.max(order).alias("gap_end"),
        )
    )
    return islands if min_len is None else islands.filter(F.col("n") > min_len)


def _rejected(
    months: DataFrame,
    key: str,
    value: str,
    *,
    max_share: float = 0.3,
    max_month_share: float = 0.3,
    max_year_step: int = 4,
    max_day_step: int = 70,
    min_len: int = 4,
    gap_before=None,
    pardon_gaps: DataFrame | None = None,
    reject: Sequence[DataFrame] = (),
) -> list[DataFrame]:
    """The key lists of all completeness screens, from one row per key and month."""
    void = months.filter(F.col(value).isNull())
    by_day = intervals.record_share(months, key, max_share)
    by_month = missing_share(months.drop("n", "n_missing"), [key, "month"], value, max_month_share)
    by_year_gap = gap_islands(void, [key, "month"], "year", max_year_step, min_len)
    by_gap = gap_islands(void, key, "date", max_day_step, min_len)
    if gap_before is not None:
        by_gap = by_gap.filter(F.col("gap_start") < F.lit(gap_before))
    if pardon_gaps is not None:
        by_gap = by_gap.join(pardon_gaps.select(key).distinct(), key, "left_anti")
    return [by_day, by_month, by_year_gap, by_gap, *reject]


def select_stations(
    df: DataFrame, key: str, date: str, value: str, *, max_missing_days: int = 10, **limits
) -> DataFrame:
    """Rows of the stations that pass all completeness screens.

    ``df`` is a densified daily series.  A station fails when too many days
    (``max_share``), or too many values of one calendar month
    (``max_month_share``), are missing, or when it has a long island of missing
    months along the years (``max_year_step``, ``min_len``) or along the calendar
    (``max_day_step``).  ``gap_before`` ignores calendar islands that start later;
    ``pardon_gaps`` lists keys whose calendar islands are forgiven; ``reject`` adds
    key lists.
    """
    months = _months(df, key, date, value, max_missing_days)
    return drop_keys(df, _rejected(months, key, value, **limits), key)


def select_records(
    raw: DataFrame,
    key: str,
    date: str,
    value: str,
    *,
    lo=None,
    hi=None,
    trim_rules: DataFrame | None = None,
    start_before=None,
    end_after=None,
    max_missing_days: int = 10,
    reuse: bool = True,
    **limits,
) -> DataFrame:
    """Daily series, one row per day, of the stations whose raw records pass all screens.

    Equals :func:`select_stations` of the densified records between ``lo`` and
    ``hi`` without bad starts (``apply_trim_rules``), for stations that start before
    ``start_before`` and end after ``end_after``; but the screens read one row per
    station and month, and calendars are built for the stations that pass only.
    ``reuse`` writes those months once.
    """
    first_days = None if trim_rules is None else first_good_days(trim_rules, key)
    parts = intervals.observed_months(raw, key, date, value, lo, hi, first_days)
    bounded = start_before is not None or end_after is not None
    parts = cut_lineage(parts) if reuse and bounded else parts
    months = intervals.record_months(parts, key, value, max_missing_days, lo, hi, first_days)
    months = cut_lineage(months) if reuse else months
    kept = raw
    if bounded:
        ranges = intervals.record_ranges(parts, key)
        kept = keep_keys(kept, in_time(ranges, start_before, end_after), key)
    kept = drop_keys(kept, _rejected(months, key, value, **limits), key)
    daily = clip_period(densify_daily(kept, key, date, value), date, lo, hi)
    return daily if trim_rules is None else apply_trim_rules(daily, trim_rules, key, date)
