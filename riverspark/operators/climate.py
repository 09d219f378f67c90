"""Hourly climate to local days and months, climatologies and timing indices."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverspark.columns import as_list
from riverspark.functions import (
    local_timestamp,
    mid_month,
    row_count,
    strict_avg,
    strict_sum,
    weighted_avg,
)


def daily_mean(
    df: DataFrame, ts: str, key: str | Iterable[str], value: str, na: str = "propagate"
) -> DataFrame:
    """Mean per day; by default NULL as soon as one value of the day is NULL."""
    mean = strict_avg(value) if na == "propagate" else F.avg(value)
    return df.groupBy(*as_list(key), F.to_date(ts).alias("date")).agg(mean.alias(value))


def to_local_time(df: DataFrame, utc: str, hours_behind: str) -> DataFrame:
    """Add local timestamp, date, year, month, day of the year and hour."""
    local = F.col("local_ts")
    return (
        df.withColumn("local_ts", local_timestamp(utc, hours_behind))
        .withColumn("date", F.to_date(local))
        .withColumn("year", F.year(local))
        .withColumn("month", F.month(local))
        .withColumn("jday", F.dayofyear(local))
        .withColumn("hour", F.hour(local))
    )


def rollup_climate(
    df: DataFrame,
    grain: Sequence[str],
    variable: str,
    value: str,
    mean_vars: Sequence[str],
    min_obs: int | None = None,
    exact_obs: int | None = None,
) -> DataFrame:
    """Mean of state variables, sum of fluxes, per grain and variable.

    Groups need more than ``min_obs`` rows, or exactly ``exact_obs`` rows.  A NULL
    value makes the group's result NULL.
    """
    rolled = df.groupBy(*grain, variable).agg(
        row_count().alias("n"),
        F.when(F.col(variable).isin(*mean_vars), strict_avg(value))
        .otherwise(strict_sum(value))
        .alias(value),
    )
    if min_obs is not None:
        rolled = rolled.filter(F.col("n") > min_obs)
    if exact_obs is not None:
        rolled = rolled.filter(F.col("n") == exact_obs)
    return rolled.drop("n")


def partition_precip(
    df: DataFrame, ppt: str = "ppt", snow: str = "snowfall", rain: str = "rain"
) -> DataFrame:
    """Repair total and frozen precipitation and derive rain.

    Negative amounts become zero, snowfall is held between zero and the total, and
    rain is the rest.  A NULL part leaves its dependants NULL.
    """
    total = F.when(F.col(ppt).isNotNull(), F.greatest(F.col(ppt), F.lit(0.0)))
    frozen = F.when(
        F.col(ppt).isNotNull() & F.col(snow).isNotNull(),
        F.least(F.greatest(F.col(snow), F.lit(0.0)), total),
    ).when(F.col(ppt) <= 0, F.lit(0.0))
    return df.withColumns({ppt: total, snow: frozen}).withColumn(rain, F.col(ppt) - F.col(snow))


def clip_to_station_range(
    df: DataFrame, ranges: DataFrame, on: str | Iterable[str], at: str, lo: str, hi: str
) -> DataFrame:
    """Rows whose date or year lies inside their own key's range.

    The equality on the key makes this a hash join with a residual test.
    """
    names = as_list(on)
    bounds = ranges.select(*names, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    joined = df.join(bounds, names, "inner")
    return joined.filter(F.col(at).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def period_climatology(
    monthly: DataFrame,
    ranges: DataFrame,
    key: str,
    sums: dict[str, float],
    means: Sequence[str],
    date: str = "date",
    lo: str = "start",
    hi: str = "end",
    by: Sequence[str] = (),
    full_year: int = 12,
) -> DataFrame:
    """Months inside each key's range, complete years, then the mean over years.

    ``sums`` maps flux columns to a unit factor; ``means`` are state columns.
    ``ranges`` may carry ``by`` columns such as a period, each with its own range.
    """
    inside = clip_to_station_range(monthly, ranges, [key, *by], date, lo, hi)
    annual = (
        inside.groupBy(key, *by, F.year(date).alias("year"))
        .agg(
            row_count().alias("_n"),
            *((strict_sum(c) * factor).alias(c) for c, factor in sums.items()),
            *(strict_avg(c).alias(c) for c in means),
        )
        .filter(F.col("_n") == full_year)
    )
    return annual.groupBy(key, *by).agg(
        row_count().alias("n_years"), *(F.avg(c).alias(c) for c in [*sums, *means])
    )


def full_season_years(
    ranges: DataFrame, first_jday: int, last_jday: int, start: str = "start", end: str = "end"
) -> DataFrame:
    """First and last year of a record that hold the whole season."""
    late = (F.dayofyear(start) > first_jday).cast("int")
    early = (F.dayofyear(end) < last_jday).cast("int")
    return ranges.withColumn("first_year", F.year(start) + late).withColumn(
        "last_year", F.year(end) - early
    )


def seasonality_index(
    daily: DataFrame,
    key: str,
    value: str,
    bounds: DataFrame,
    lo: int = 152,
    hi: int = 304,
    by: Sequence[str] = (),
    agg: str = "sum",
) -> DataFrame:
    """Departure of daily amounts from an even spread over a season.

    For a season total S over ``hi - lo + 1`` days every day adds
    |amount - S / days| / S.  The parts are summed over days and years, so the
    index grows with the record; ``agg="mean"`` averages the years instead.
    ``bounds`` gives ``first_year`` and ``last_year`` per key and ``by`` columns.
    """
    keys = [key, *by]
    length = hi - lo + 1
    season = clip_to_station_range(
        daily.filter(F.col("jday").between(lo, hi)), bounds, keys, "year", "first_year", "last_year"
    )
    # One season of one key per window: at most `length` daily rows.
    whole = Window.partitionBy(*keys, "year")
    total = F.when(F.count(value).over(whole) == row_count().over(whole), F.sum(value).over(whole))
    part = F.try_divide(F.abs(F.col(value) - F.col("_total") / length), F.col("_total"))
    yearly = (
        season.withColumn("_total", total)
        .withColumn("_part", part)
        .groupBy(*keys, "year")
        .agg(strict_sum("_part").alias("si"))
    )
    return yearly.groupBy(*keys).agg(
        (strict_sum("si") if agg == "sum" else F.avg("si")).alias("si")
    )


def melt_timing(
    daily: DataFrame,
    key: str,
    value: str,
    bounds: DataFrame,
    lo: int = 60,
    hi: int = 181,
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean over years of the value-weighted day within a season."""
    keys = [key, *by]
    season = daily.filter(F.col("jday").between(lo, hi) & (F.col(value) > 0))
    centres = season.groupBy(*keys, "year").agg(weighted_avg("jday", value).alias("centre"))
    inside = clip_to_station_range(centres, bounds, keys, "year", "first_year", "last_year")
    return inside.groupBy(*keys).agg(F.avg("centre").alias("melt_t"))


def zonal_mean(
    cells: DataFrame,
    weights: DataFrame,
    cell: str,
    zone: str,
    value: str,
    weight: str,
    by: Sequence[str] = (),
    na: str = "propagate",
) -> DataFrame:
    """Coverage-weighted mean of grid cells per zone (and time step).

    A zone with a NULL cell is NULL; ``na="skip"`` leaves such cells out.  Partial
    sums are formed before the shuffle on the zone.
    """
    if na not in ("propagate", "skip"):
        raise ValueError(f"na={na!r}")
    mean = weighted_avg(value, weight)
    if na == "propagate":
        mean = F.when(F.count(value) == F.count(F.lit(1)), mean)
    return cells.join(weights, cell, "inner").groupBy(zone, *by).agg(mean.alias(value))


def label_polygons(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """C14: give extraction results the station of their polygon id."""
    return df.join(ids, on, "inner")


def with_mid_month(df: DataFrame) -> DataFrame:
    """Add the date that stands for a monthly row."""
    return df.withColumn("date", mid_month("year", "month"))
