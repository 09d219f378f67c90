"""Daily flow: from raw values to screened series and regime metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.operators import clean, events, screens, series, spectral
from riverspark.sources import append
from riverspark.session import cut_lineage


def screened_flow(
    raw: DataFrame,
    key: str,
    date: str,
    value: str,
    *,
    flag: str | None = None,
    allowed: Sequence[str] = (),
    period: tuple = (None, None),
    start_before=None,
    end_after=None,
    trim_rules: DataFrame | None = None,
    reuse: bool = True,
    **screen_limits,
) -> DataFrame:
    """Daily series, one row per day, of the stations fit for analysis.

    Masks values by quality flag, keeps stations whose record starts and ends in
    time, clips to the period, trims bad starts and applies the completeness screens
    (see ``select_stations`` for their limits).  The screens read one row per
    station and month, which ``reuse`` writes once; only stations that pass get a
    calendar filled with NULL days.
    """
    masked = clean.mask_by_flag(raw, value, flag, allowed) if flag else raw
    return screens.select_records(
        masked,
        key,
        date,
        value,
        lo=period[0],
        hi=period[1],
        trim_rules=trim_rules,
        start_before=start_before,
        end_after=end_after,
        reuse=reuse,
        **screen_limits,
    )


def flow_regime(
    daily: DataFrame,
    key: str,
    date: str,
    value: str,
    *,
    reference_peak: DataFrame | None = None,
    max_na: int | None = None,
    reuse: bool = True,
    strict: bool = False,
) -> DataFrame:
    """One row of regime metrics per key, from raw daily values.

    ``reference_peak`` supplies the seasonal peak days of another period; by
    default each key's own peak is used.  Several branches read the gap-filled
    series and its signal; with ``reuse`` both daily tables are written once to the
    checkpoint folder instead of being derived from the raw table for each branch.

    ``strict`` refuses NULL keys and days that occur twice (among values above 0 of keys
    with a whole year).  They are counted while the series is written, so it needs ``reuse``.
    """
    if strict and not reuse:
        raise ValueError("strict needs reuse")
    ready = spectral.prepare_flow(daily, key, date, value, max_na)
    if strict:
        ready, seen = clean.observe_checks(ready, [key, series.SEGMENT], date, key)
    ready = cut_lineage(ready) if reuse else ready
    if strict:
        found = seen.get
        if found["repeats"] or found[f"nulls_{key}"]:
            raise ValueError(f"{found['repeats']} repeated days, {found[f'nulls_{key}']} rows without {key}")
    signal = spectral.seasonal_signal(ready, key, date)
    signal = cut_lineage(signal) if reuse else signal
    peak = spectral.seasonal_peak(signal, key) if reference_peak is None else reference_peak
    floods = events.independent_events(signal, key, date, "resid")
    duration = events.mean_of_means(floods, [key, "year"], [key], "duration")
    anomaly = events.summarise_anomaly(events.high_anomaly(signal, peak, key, date), key)
    return events.regime_metrics(
        spectral.spectral_metrics(ready, key),
        events.sigma_high_flow(floods, key),
        anomaly,
        duration.withColumnRenamed("duration", "event_duration"),
        screens.series_range(daily, key, date).drop("length_years"),
        key,
    )


def two_period_metrics(
    daily: DataFrame,
    key: str,
    date: str,
    value: str,
    periods: Mapping[str, tuple],
    reference: str,
    *,
    metadata: DataFrame | None = None,
    reuse: bool = True,
) -> DataFrame:
    """Regime metrics of several periods in one table, tagged with ``period``.

    ``periods`` maps a name to its first and last day.  Timing refers to the
    seasonal peaks of the period ``reference`` throughout.  ``metadata`` adds
    columns per key.
    """
    clips = {name: clean.clip_period(daily, date, *days) for name, days in periods.items()}
    ready = spectral.prepare_flow(clips[reference], key, date, value)
    peak = spectral.seasonal_peak(spectral.seasonal_signal(ready, key, date), key)
    peak = cut_lineage(peak) if reuse else peak
    tables = (
        flow_regime(part, key, date, value, reference_peak=peak, reuse=reuse).withColumn("period", F.lit(name))
        for name, part in clips.items()
    )
    stacked = append(*tables)
    return stacked if metadata is None else clean.enrich(stacked, metadata, key)
