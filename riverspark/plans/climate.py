"""Hourly climate to monthly and seasonal covariates of each catchment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.functions import KELVIN_OFFSET, METRES_TO_MM, convert
from riverspark.operators import clean, climate, reshape

MONTH_HOURS = 600
DAY_HOURS = 24


def local_rollups(
    hourly: DataFrame,
    offsets: DataFrame,
    key: str,
    utc: str,
    variable: str,
    value: str,
    mean_vars: Sequence[str] = ("temp",),
    month_hours: int = MONTH_HOURS,
    day_hours: int = DAY_HOURS,
) -> tuple[DataFrame, DataFrame]:
    """Monthly and daily values in each station's standard time.

    ``offsets`` gives ``hours_behind`` per key.  Months need more than
    ``month_hours`` hours, days exactly ``day_hours``.
    """
    local = climate.to_local_time(clean.enrich(hourly, offsets, key), utc, "hours_behind")
    monthly = climate.rollup_climate(
        local, [key, "year", "month"], variable, value, mean_vars, min_obs=month_hours
    )
    daily = climate.rollup_climate(
        local, [key, "year", "month", "jday"], variable, value, mean_vars, exact_obs=day_hours
    )
    return monthly, daily


def monthly_table(
    monthly: DataFrame,
    key: str,
    variable: str = "variable",
    value: str = "value",
    names: Mapping[str, str] | None = None,
    temp_offset: float = KELVIN_OFFSET,
) -> DataFrame:
    """Wide monthly table with repaired precipitation parts and temperature in °C.

    Rows without value, key or month are left out.

    ``names`` maps the roles ppt, snowfall, snowmelt and temp to variable tags.
    """
    names = names or {r: r for r in ("ppt", "snowfall", "snowmelt", "temp")}
    complete = monthly.dropna(subset=[key, "year", "month", value])
    # Of repeated cells one value is kept, the smallest, whatever the row order.
    monthly = clean.dedupe(complete, [key, "year", "month", variable], [F.col(value)])
    wide = reshape.to_wide(monthly, [key, "year", "month"], variable, value, list(names.values()))
    renamed = wide.select(key, "year", "month", *(F.col(v).alias(r) for r, v in names.items()))
    parts = climate.partition_precip(renamed)
    return climate.with_mid_month(
        parts.withColumn("temp", convert("temp", offset=temp_offset))
    )


def catchment_climate(
    monthly: DataFrame, ranges: DataFrame, key: str, by: Sequence[str] = ("period",)
) -> DataFrame:
    """Mean annual amounts in mm and mean temperature per key and period."""
    fluxes = {c: METRES_TO_MM for c in ("ppt", "snowfall", "rain", "snowmelt")}
    return climate.period_climatology(monthly, ranges, key, fluxes, ["temp"], by=list(by))


def catchment_covariates(
    monthly: DataFrame,
    daily: DataFrame,
    ranges: DataFrame,
    key: str,
    periods: Mapping[str, tuple[int, int]],
    fluxes: Mapping[str, float],
    means: Sequence[str],
    season: tuple[int, int] = (152, 304),
    melt: tuple[int, int] = (60, 182),
) -> DataFrame:
    """One row of climate covariates per key, each column once per period.

    ``monthly`` has a date and the columns of ``fluxes`` (with unit factors) and
    ``means``; ``daily`` has year, jday, ppt, snowfall and snowmelt; ``ranges``
    has start and end per key and period.  Rain is derived from the daily parts;
    its seasonality index needs whole seasons, melt timing whole melt seasons,
    which end before ``melt[1]``.
    """
    in_period = clean.assign_period(monthly.withColumn("year", F.year("date")), "year", periods)
    amounts = climate.period_climatology(
        in_period.drop("year"), ranges, key, dict(fluxes), list(means), by=["period"]
    ).drop("n_years")
    days = climate.partition_precip(clean.assign_period(daily, "year", periods))

    def whole(bounds: tuple[int, int]) -> DataFrame:
        years = climate.full_season_years(ranges, *bounds)
        return years.select(key, "period", "first_year", "last_year")

    index = climate.seasonality_index(days, key, "rain", whole(season), *season, by=["period"])
    timing = climate.melt_timing(days, key, "snowmelt", whole(melt), melt[0], melt[1] - 1, by=["period"])
    tables = []
    for table in (amounts, index, timing):
        values = [c for c in table.columns if c not in (key, "period")]
        long = reshape.to_long(table, [key, "period"], values)
        named = long.withColumn("variable", F.concat_ws("_", "variable", "period"))
        levels = [f"{v}_{p}" for v in values for p in periods]
        tables.append(reshape.to_wide(named, [key], "variable", "value", levels))
    return clean.assemble(tables, key)
