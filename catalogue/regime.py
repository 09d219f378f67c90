"""Queries on the seasonal signal, anomalies and flood events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalogue import register
from catalogue.views import (
    BRAND,
    brand_series,
    full_signal_sql,
    prepared,
    prepared_sql,
    signal,
    table,
    terms_sql,
)
from riverspark.operators import clean, events, spectral
from riverspark.plans.flow import flow_regime, two_period_metrics


@register(
    "fill_linear",
    f"""WITH {BRAND}, {prepared_sql('s_brand')}
SELECT station, date, t, n AS n_days, years AS n_years, round(y, 8) + 0.0 AS y, observed FROM prep""",
)
def fill_linear(spark, folder):
    return prepared(spark, folder).drop("segment").withColumn("y", F.round("y", 8))


@register(
    "seasonal_signal",
    f"""WITH {BRAND}, {full_signal_sql()}
SELECT station, date, year, jday, round(y, 6) + 0.0 AS y, round(pred, 6) + 0.0 AS pred,
  round(resid, 6) + 0.0 AS resid FROM signal""",
)
def seasonal_signal(spark, folder):
    rounded = (F.round(c, 6).alias(c) for c in ("y", "pred", "resid"))
    return signal(spark, folder).select("station", "date", "year", "jday", *rounded)


METRICS = """metrics AS (
  SELECT station, n AS n_days, years AS n_years, sqrt(p / 3) AS rms_signal,
    sqrt((var_y - p) / (floor((n - 1) / 2) - 3)) AS rms_noise
  FROM (SELECT *, (a1*a1 + c1*c1 + a2*a2 + c2*c2 + a3*a3 + c3*c3) / 2 AS p FROM terms))"""


@register(
    "spectral_metrics",
    f"""WITH {BRAND}, {prepared_sql('s_brand')}, {terms_sql()}, {METRICS}
SELECT station, n_days, n_years, round(rms_signal, 8) AS rms_signal,
  round(rms_noise, 8) AS rms_noise, round(20 * ln(rms_signal / rms_noise), 6) AS snr FROM metrics""",
)
def spectral_metrics(spark, folder):
    metrics = spectral.spectral_metrics(prepared(spark, folder), "station")
    return metrics.select(
        "station",
        "n_days",
        "n_years",
        F.round("rms_signal", 8).alias("rms_signal"),
        F.round("rms_noise", 8).alias("rms_noise"),
        F.round("snr", 6).alias("snr"),
    )


SPECTRUM = """bins AS (
  SELECT station, y, t, n, years, UNNEST(generate_series(1, n // 2)) AS bin FROM prep WHERE t < n),
spec AS (
  SELECT station, CAST(bin AS INT) AS bin, bin / CAST(MAX(years) AS DOUBLE) AS per_year,
    CASE WHEN 2 * bin = MAX(n) THEN 1.0 ELSE 2.0 END / MAX(n)
      * sqrt(SUM(y * cos(2 * pi() * bin * t / n)) ** 2 + SUM(y * sin(2 * pi() * bin * t / n)) ** 2)
      AS amplitude
  FROM bins GROUP BY station, bin)"""


@register(
    "spectrum",
    f"""WITH {BRAND}, {prepared_sql('s_brand')}, {SPECTRUM}
SELECT station, bin, round(per_year, 6) AS per_year, round(amplitude, 6) AS amplitude FROM spec""",
)
def spectrum(spark, folder):
    return spectral.spectrum(prepared(spark, folder), "station").select(
        "station",
        "bin",
        F.round("per_year", 6).alias("per_year"),
        F.round("amplitude", 6).alias("amplitude"),
    )


@register(
    "seasonal_flag",
    f"""WITH {BRAND}, {prepared_sql('s_brand')}, {SPECTRUM},
ranked AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY amplitude DESC, bin) AS k
  FROM spec)
SELECT station, CASE WHEN bool_or(per_year IN (1.0, 2.0)) THEN 'yes' ELSE 'no' END AS seasonal
FROM ranked WHERE k <= 50 GROUP BY 1""",
)
def seasonal_flag(spark, folder):
    return spectral.seasonal_flag(spectral.spectrum(prepared(spark, folder), "station"), "station", 50)


PEAK = """peaks AS (
  SELECT station, CAST(MIN(jday) AS INT) AS peak FROM (
    SELECT station, jday, round(pred, 9) AS p, MAX(round(pred, 9)) OVER (PARTITION BY station) AS m
    FROM signal) WHERE p = m GROUP BY 1)"""


@register("seasonal_peak", f"WITH {BRAND}, {full_signal_sql()}, {PEAK} SELECT * FROM peaks")
def seasonal_peak(spark, folder):
    return spectral.seasonal_peak(signal(spark, folder), "station")


def anomaly_sql(signal_name: str, peaks: str, name: str = "anomaly") -> str:
    return f"""{name}_season AS (
  SELECT *, COUNT(*) OVER w AS days, row_number() OVER (w ORDER BY resid DESC NULLS LAST, jday) AS k
  FROM {signal_name} WHERE jday BETWEEN 60 AND 304 WINDOW w AS (PARTITION BY station, year)),
{name} AS (
  SELECT s.station, s.year, s.resid, s.jday, s.date, p.peak,
    CAST(s.jday - p.peak AS INT) AS timing
  FROM {name}_season s LEFT JOIN {peaks} p ON p.station = s.station WHERE k = 1 AND days > 200 AND resid IS NOT NULL)"""


@register(
    "high_anomaly",
    f"""WITH {BRAND}, {full_signal_sql()}, {PEAK}, {anomaly_sql('signal', 'peaks')}
SELECT station, year, round(resid, 6) AS resid, jday, date, peak, timing FROM anomaly""",
)
def high_anomaly(spark, folder):
    daily = signal(spark, folder)
    found = events.high_anomaly(daily, spectral.seasonal_peak(daily, "station"), "station", "date")
    return found.withColumn("resid", F.round("resid", 6))


PERIOD_SPLIT = """s_old AS (SELECT * FROM s_brand WHERE date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'),
s_new AS (SELECT * FROM s_brand WHERE date BETWEEN DATE '1999-01-01' AND DATE '2001-12-31')"""


@register(
    "high_anomaly_reference_peak",
    f"""WITH {BRAND}, {PERIOD_SPLIT}, {full_signal_sql('s_old', 'o_')}, {full_signal_sql('s_new', 'n_')},
{PEAK.replace('FROM signal', 'FROM n_signal')}, {anomaly_sql('o_signal', 'peaks')}
SELECT station, year, round(resid, 6) AS resid, jday, date, peak, timing FROM anomaly""",
)
def high_anomaly_reference_peak(spark, folder):
    series = brand_series(spark, folder)

    def period_signal(lo, hi):
        part = clean.clip_period(series, "date", lo, hi)
        ready = spectral.prepare_flow(part, "station", "date", "discharge")
        return spectral.seasonal_signal(ready, "station", "date")

    old = period_signal(dt.date(1995, 1, 1), dt.date(1997, 12, 31))
    new = period_signal(dt.date(1999, 1, 1), dt.date(2001, 12, 31))
    found = events.high_anomaly(old, spectral.seasonal_peak(new, "station"), "station", "date")
    return found.withColumn("resid", F.round("resid", 6))


EVENTS = """flood_runs AS (
  SELECT station, date, resid, jday, year,
    date - CAST(row_number() OVER (PARTITION BY station ORDER BY date) AS INT) AS run
  FROM signal WHERE resid > 0),
floods AS (
  SELECT station, MIN(date) AS start, MAX(date) AS "end", CAST(COUNT(*) AS BIGINT) AS duration,
    MAX(resid) AS extreme, first(date ORDER BY resid DESC, date) AS extreme_date,
    first(year ORDER BY resid DESC, date) AS year, first(jday ORDER BY resid DESC, date) AS jday
  FROM flood_runs GROUP BY station, run)"""


@register(
    "flood_events",
    f"""WITH {BRAND}, {full_signal_sql()}, {EVENTS}
SELECT station, start, "end", duration, round(extreme, 6) AS extreme, extreme_date, year, jday
FROM floods""",
)
def flood_events(spark, folder):
    found = events.independent_events(signal(spark, folder), "station", "date", "resid")
    return found.withColumn("extreme", F.round("extreme", 6))


@register(
    "event_duration",
    f"""WITH {BRAND}, {full_signal_sql()}, {EVENTS},
yearly AS (SELECT station, year, AVG(duration) AS duration FROM floods GROUP BY 1, 2)
SELECT station, round(AVG(duration), 6) AS duration FROM yearly GROUP BY 1""",
)
def event_duration(spark, folder):
    found = events.independent_events(signal(spark, folder), "station", "date", "resid")
    means = events.mean_of_means(found, ["station", "year"], ["station"], "duration")
    return means.withColumn("duration", F.round("duration", 6))


def regime_sql(source: str = "s_brand", peaks: str = PEAK) -> str:
    """All metrics of one source; ``peaks`` defines the reference days."""
    return f"""{full_signal_sql(source)}, {METRICS}, {peaks}, {anomaly_sql('signal', 'peaks')}, {EVENTS},
sigma AS (SELECT station, CAST(COUNT(*) AS BIGINT) AS n_floods, sqrt(AVG(extreme * extreme)) AS sigma_hf
  FROM floods GROUP BY 1),
sam AS (SELECT station, AVG(resid) AS hsam, AVG(timing) AS hsam_t, MAX(peak) AS peak FROM anomaly GROUP BY 1),
yearly AS (SELECT station, year, AVG(duration) AS duration FROM floods GROUP BY 1, 2),
dur AS (SELECT station, AVG(duration) AS event_duration FROM yearly GROUP BY 1),
rng AS (SELECT station, MIN(date) AS start, MAX(date) AS "end" FROM {source} GROUP BY 1)
SELECT station, n_days, n_years, round(rms_signal, 8) AS rms_signal, round(rms_noise, 8) AS rms_noise,
  round(20 * ln(rms_signal / rms_noise), 6) AS snr, n_floods, round(sigma_hf, 6) AS sigma_hf,
  round(hsam, 6) AS hsam, round(hsam_t, 6) AS hsam_t, peak, round(event_duration, 6) AS event_duration,
  start, "end"
FROM rng LEFT JOIN metrics USING (station) LEFT JOIN sigma USING (station)
LEFT JOIN sam USING (station) LEFT JOIN dur USING (station)"""


def rounded_metrics(out):
    digits = {"rms_signal": 8, "rms_noise": 8}
    return out.select(
        *(
            F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c)
            for c, t in out.dtypes
        )
    )


@register("regime_metrics", f"WITH {BRAND}, {regime_sql()}")
def regime_metrics(spark, folder):
    return rounded_metrics(flow_regime(brand_series(spark, folder), "station", "date", "discharge"))


@register(
    "two_period_metrics",
    f"""WITH {BRAND}, {PERIOD_SPLIT},
ref_peaks AS (SELECT * FROM (WITH {full_signal_sql('s_new')}, {PEAK} SELECT * FROM peaks)),
brands AS (SELECT p_brand AS station, CAST(COUNT(*) AS BIGINT) AS n_parts FROM part GROUP BY 1)
SELECT 'recent' AS period, r.*, n_parts FROM (WITH {regime_sql('s_new', 'peaks AS (SELECT * FROM ref_peaks)')}) r
  LEFT JOIN brands USING (station)
UNION ALL SELECT 'historical', h.*, n_parts FROM (WITH {regime_sql('s_old', 'peaks AS (SELECT * FROM ref_peaks)')}) h
  LEFT JOIN brands USING (station)""",
)
def two_period(spark, folder):
    periods = {
        "recent": (dt.date(1999, 1, 1), dt.date(2001, 12, 31)),
        "historical": (dt.date(1995, 1, 1), dt.date(1997, 12, 31)),
    }
    brands = table(spark, folder, "part").groupBy(F.col("p_brand").alias("station")).agg(F.count("*").alias("n_parts"))
    series = brand_series(spark, folder)
    return rounded_metrics(
        two_period_metrics(series, "station", "date", "discharge", periods, "recent", metadata=brands)
    )
