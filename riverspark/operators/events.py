"""High-flow events and the yearly anomaly metrics of a seasonal signal."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.columns import as_list, join_groups
from riverspark.functions import row_count, strict_avg
from riverspark.operators.clean import assemble
from riverspark.operators.series import runs_of_days


def independent_events(
    df: DataFrame,
    key: str | Iterable[str],
    date: str,
    value: str,
    cutoff: float = 0.0,
    above: bool = True,
) -> DataFrame:
    """Runs of consecutive days beyond a cutoff.

    A day that is NULL or absent ends a run.  Year and day of the year are those
    of the extreme value.
    """
    beyond = F.col(value) > cutoff if above else F.col(value) < cutoff
    runs = runs_of_days(df.filter(beyond), key, date, value, highest=above)
    return runs.withColumn("year", F.year("extreme_date")).withColumn(
        "jday", F.dayofyear("extreme_date")
    )


def mean_of_means(
    df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str
) -> DataFrame:
    """Mean per inner group, then mean of those per outer group."""
    first = df.groupBy(*inner).agg(F.avg(value).alias(value))
    return first.groupBy(*outer).agg(F.avg(value).alias(value))


def high_anomaly(
    signal: DataFrame,
    peak: DataFrame,
    key: str | Iterable[str],
    date: str,
    value: str = "resid",
    lo: int = 60,
    hi: int = 304,
    min_days: int = 200,
) -> DataFrame:
    """Largest anomaly of each open-water season and its timing.

    ``peak`` gives the reference day per key, from the same or another period.
    Seasons with ``min_days`` rows or fewer are left out, rows with a NULL anomaly
    counted; so are seasons without any anomaly.  The earliest day wins ties.  ``timing`` is the day minus the reference day.
    """
    keys = as_list(key)
    first_largest = F.struct(F.col(value), (-F.col("jday")).alias("j"))
    yearly = (
        signal.filter(F.col("jday").between(lo, hi))
        .groupBy(*keys, "year")
        .agg(
            row_count().alias("_days"),
            F.max(value).alias(value),
            F.max_by("jday", first_largest).alias("jday"),
            F.max_by(date, first_largest).alias(date),
        )
        .filter((F.col("_days") > min_days) & F.col(value).isNotNull())
        .drop("_days")
    )
    return join_groups(yearly, peak, keys, "left").withColumn("timing", F.col("jday") - F.col("peak"))


def summarise_anomaly(anomalies: DataFrame, key: str | Iterable[str], value: str = "resid") -> DataFrame:
    """Mean yearly anomaly and timing per key, with the one reference day.

    Fails when a key carries more than one reference day.
    """
    one_peak = F.min("peak").eqNullSafe(F.max("peak"))
    peak = F.when(one_peak, F.max("peak")).otherwise(
        F.raise_error(F.lit("more than one reference day for a key")).cast("int")
    )
    return anomalies.groupBy(*as_list(key)).agg(
        strict_avg(value).alias("hsam"), strict_avg("timing").alias("hsam_t"), peak.alias("peak")
    )


def sigma_high_flow(events: DataFrame, key: str | Iterable[str]) -> DataFrame:
    """Number of events and root mean square of their extremes."""
    return events.groupBy(*as_list(key)).agg(
        row_count().alias("n_floods"),
        F.sqrt(F.avg(F.col("extreme") * F.col("extreme"))).alias("sigma_hf"),
    )


def regime_metrics(
    metrics: DataFrame,
    sigma: DataFrame,
    anomaly: DataFrame,
    duration: DataFrame,
    ranges: DataFrame,
    key: str | Iterable[str],
) -> DataFrame:
    """One row per key with all regime metrics and the record's range."""
    return assemble([metrics, sigma, anomaly, duration, ranges], key)
