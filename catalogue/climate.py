"""Queries on the climate roll-ups, climatologies and timing indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import register
from catalogue.views import BRAND, NATION, brand_series, dense, dense_sql, table
from riverspark.functions import (
    epoch_to_timestamp,
    glue_label,
    jday_to_date,
    mid_month,
    pad_hour,
    repair_exponent,
    utc_minus,
    utc_timestamp,
    variable_from_source,
)
from riverspark.operators import clean, climate, reshape, screens
from riverspark.plans.climate import catchment_covariates, local_rollups, monthly_table
from riverspark.session import cut_lineage
from riverspark.sources import append

TYPES = ["click", "error", "purchase", "signup", "view"]
REGIONS = ["AK", "YT", "NT", "MB", "ON", "NL"]


def hourly(spark, folder):
    """Climate stand-in: station from the user, variable = event type."""
    return table(spark, folder, "events").select(
        (F.col("user_id") % 10).cast("int").alias("station"),
        F.col("event_type").alias("variable"),
        F.col("ts"),
        F.to_date("ts").alias("date_utc"),
        F.hour("ts").alias("hour_utc"),
        "value",
    )


HOURLY = """hourly AS (
  SELECT CAST(user_id % 10 AS INT) AS station, event_type AS variable, ts,
    CAST(ts AS DATE) AS date_utc, CAST(hour(ts) AS INT) AS hour_utc, value FROM events)"""


def local_hours(spark, folder):
    region = F.element_at(F.array(*map(F.lit, REGIONS)), (F.col("station") % 6 + 1).cast("int"))
    tagged = (
        hourly(spark, folder)
        .withColumn("region", region)
        .withColumn("hours_behind", utc_minus("region"))
        .withColumn("utc_ts", utc_timestamp("date_utc", "hour_utc"))
    )
    return climate.to_local_time(tagged, "utc_ts", "hours_behind")


LOCAL = """regional AS (
  SELECT *, ['AK', 'YT', 'NT', 'MB', 'ON', 'NL'][CAST(station % 6 + 1 AS INT)] AS region FROM hourly),
local AS (
  SELECT *, CAST(date_utc AS TIMESTAMP) + to_hours(hour_utc) - to_hours(hours_behind) AS local_ts
  FROM (SELECT *, CAST(CASE region WHEN 'AK' THEN 9 WHEN 'YT' THEN 8 WHEN 'NT' THEN 7
    WHEN 'MB' THEN 6 WHEN 'ON' THEN 5 WHEN 'NL' THEN 4 END AS INT) AS hours_behind FROM regional))"""


@register(
    "daily_mean",
    f"""WITH {HOURLY}
SELECT station, date_utc AS date,
  round(CASE WHEN COUNT(v) = COUNT(*) THEN AVG(v) END, 8) AS value
FROM (SELECT *, CASE WHEN value < 250 THEN value END AS v FROM hourly) GROUP BY 1, 2""",
)
def daily_mean(spark, folder):
    masked = hourly(spark, folder).withColumn("value", F.when(F.col("value") < 250, F.col("value")))
    means = climate.daily_mean(masked, "ts", "station", "value")
    return means.withColumn("value", F.round("value", 8))


@register(
    "local_time_shift",
    f"""WITH {HOURLY}, {LOCAL}
SELECT station, region, hours_behind, CAST(local_ts AS DATE) AS date, CAST(year(local_ts) AS INT) AS year,
  CAST(month(local_ts) AS INT) AS month, CAST(dayofyear(local_ts) AS INT) AS jday,
  CAST(hour(local_ts) AS INT) AS hour, lpad(CAST(hour_utc AS VARCHAR), 2, '0') AS hour_text,
  CAST(COUNT(*) AS BIGINT) AS n
FROM local GROUP BY ALL""",
)
def local_time_shift(spark, folder):
    return (
        local_hours(spark, folder)
        .withColumn("hour_text", pad_hour("hour_utc"))
        .groupBy(
            "station", "region", "hours_behind", "date", "year", "month", "jday", "hour", "hour_text"
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _rollup_sql(grain: str, having: str) -> str:
    return f"""WITH {HOURLY}, {LOCAL},
l AS (SELECT station, CAST(year(local_ts) AS INT) AS year, CAST(month(local_ts) AS INT) AS month,
  CAST(dayofyear(local_ts) AS INT) AS jday, variable, value FROM local)
SELECT {grain}, variable, round(CASE WHEN variable IN ('click') THEN AVG(value) ELSE SUM(value) END, 8) AS value
FROM l GROUP BY {grain}, variable HAVING {having}"""


@register("rollup_climate_monthly", _rollup_sql("station, year, month", "COUNT(*) > 150"))
def rollup_climate_monthly(spark, folder):
    rolled = climate.rollup_climate(
        local_hours(spark, folder),
        ["station", "year", "month"],
        "variable",
        "value",
        ["click"],
        min_obs=150,
    )
    return rolled.withColumn("value", F.round("value", 8))


@register("rollup_climate_daily", _rollup_sql("station, year, month, jday", "COUNT(*) = 7"))
def rollup_climate_daily(spark, folder):
    rolled = climate.rollup_climate(
        local_hours(spark, folder),
        ["station", "year", "month", "jday"],
        "variable",
        "value",
        ["click"],
        exact_obs=7,
    )
    return rolled.withColumn("value", F.round("value", 8))


@register(
    "variable_from_source",
    """WITH named AS (SELECT 'clim-' || event_type || '-' || CAST(year(ts) AS VARCHAR) || '.nc.csv' AS source,
  value, ts FROM events)
SELECT regexp_replace(regexp_replace(substr(source, 6), '.[0-9]+', ''), '\\.nc\\.csv', '') AS variable,
  replace(CAST(month(ts) AS VARCHAR) || 'e.0' || CAST(day(ts) % 10 AS VARCHAR), 'e.', 'e+') AS repaired,
  CAST(COUNT(*) AS BIGINT) AS n
FROM named GROUP BY 1, 2""",
)
def variable_from_source_query(spark, folder):
    source = F.concat(
        F.lit("clim-"), "event_type", F.lit("-"), F.year("ts").cast("string"), F.lit(".nc.csv")
    )
    named = table(spark, folder, "events").withColumn("source", source)
    return named.groupBy(
        variable_from_source("source").alias("variable"),
        repair_exponent(
            F.concat(F.month("ts").cast("string"), F.lit("e.0"), (F.dayofmonth("ts") % 10).cast("string"))
        ).alias("repaired"),
    ).agg(F.count(F.lit(1)).alias("n"))


@register(
    "stack_and_dedupe",
    f"""WITH {HOURLY},
a AS (SELECT station, date_utc, hour_utc, variable, value, 'a' AS source FROM hourly),
b AS (SELECT station, date_utc, hour_utc, variable, value, 'b' AS source FROM hourly WHERE value > 5),
u AS (SELECT * FROM a UNION SELECT * FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY station, date_utc, hour_utc, variable
  ORDER BY source DESC, value) AS k FROM u)
SELECT station, date_utc, hour_utc, variable, source, round(value, 6) AS value FROM r WHERE k = 1""",
)
def stack_and_dedupe(spark, folder):
    base = hourly(spark, folder).drop("ts")
    both = append(
        base.withColumn("source", F.lit("a")),
        base.filter("value > 5").withColumn("source", F.lit("b")),
    ).distinct()
    keys = ["station", "date_utc", "hour_utc", "variable"]
    first = clean.dedupe(both, keys, [F.col("source").desc(), F.col("value")])
    return first.withColumn("value", F.round("value", 6))


@register(
    "has_duplicates",
    """SELECT (SELECT COUNT(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber
  HAVING COUNT(*) > 1)) > 0 AS lineitem_duplicates,
  (SELECT COUNT(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING COUNT(*) > 1)) > 0 AS order_duplicates,
  EXISTS (SELECT 1 FROM orders WHERE o_orderdate IS NULL OR o_totalprice IS NULL) AS order_nulls""",
)
def has_duplicates(spark, folder):
    orders = table(spark, folder, "orders")
    lines = table(spark, folder, "lineitem")
    found = clean.duplicates_found(lines, ["l_orderkey", "l_linenumber"], "lineitem_duplicates")
    more = {
        "order_duplicates": clean.duplicates_found(orders, "o_orderkey"),
        "order_nulls": clean.nulls_found(orders, ["o_orderdate", "o_totalprice"]),
    }
    return found.withColumns({name: one.scalar() for name, one in more.items()})


@register(
    "observed_checks",
    """SELECT COUNT(*) AS seen, COUNT(*) - COUNT(DISTINCT (l_suppkey, l_shipdate)) AS repeats,
  COUNT(*) FILTER (note IS NULL) AS nulls, COUNT(*) FILTER (l_quantity > 10) AS written
FROM (SELECT *, CASE WHEN l_quantity > 40 THEN l_linestatus END AS note FROM lineitem) q""",
)
def observed_checks(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", F.expr("CASE WHEN l_quantity > 40 THEN l_linestatus END AS note")
    ).withColumn("year", F.year("l_shipdate"))
    checked, seen = clean.observe_checks(lines, ["l_suppkey", "year"], "l_shipdate", "note")
    written = cut_lineage(checked.filter("l_quantity > 10"))
    found = seen.get
    return written.agg(F.count(F.lit(1)).alias("written")).select(
        *(F.lit(found[a]).cast("long").alias(b) for a, b in {"rows": "seen", "repeats": "repeats", "nulls_note": "nulls"}.items()),
        "written",
    )


def wide(spark, folder):
    """Daily sums per station in wide form; ``view`` plays precipitation."""
    daily = climate.rollup_climate(
        local_hours(spark, folder), ["station", "date"], "variable", "value", ["click"]
    )
    return reshape.to_wide(daily, ["station", "date"], "variable", "value", TYPES)


WIDE = f"""{HOURLY}, {LOCAL},
rolled AS (SELECT station, CAST(local_ts AS DATE) AS date, variable,
  CASE WHEN variable IN ('click') THEN AVG(value) ELSE SUM(value) END AS value
  FROM local GROUP BY 1, 2, 3),
wide AS (SELECT station, date, {', '.join(f"MAX(CASE WHEN variable = '{t}' THEN value END) AS {t}" for t in TYPES)}
  FROM rolled GROUP BY 1, 2)"""


@register(
    "to_wide_climate",
    f"WITH {WIDE} SELECT station, date, {', '.join(f'round({t}, 6) AS {t}' for t in TYPES)} FROM wide",
)
def to_wide_climate(spark, folder):
    return wide(spark, folder).select("station", "date", *(F.round(t, 6).alias(t) for t in TYPES))


@register(
    "to_long_climate",
    f"""WITH {WIDE}
SELECT station, date, variable, round(value, 6) AS value FROM (
  {' UNION ALL '.join(f"SELECT station, date, '{t}' AS variable, {t} AS value FROM wide" for t in TYPES[:3])})""",
)
def to_long_climate(spark, folder):
    long = reshape.to_long(wide(spark, folder), ["station", "date"], TYPES[:3])
    return long.withColumn("value", F.round("value", 6))


@register(
    "complete_cases",
    f"""WITH {WIDE} SELECT station, date FROM wide
WHERE click IS NOT NULL AND error IS NOT NULL AND purchase IS NOT NULL AND signup IS NOT NULL
  AND view IS NOT NULL""",
)
def complete_cases(spark, folder):
    return clean.complete_cases(wide(spark, folder), TYPES).select("station", "date")


@register(
    "partition_precip",
    f"""WITH {WIDE},
p0 AS (SELECT station, date, view - 60 AS ppt, purchase - 60 AS snow FROM wide),
p1 AS (SELECT station, date, CASE WHEN ppt < 0 THEN 0 ELSE ppt END AS ppt,
  CASE WHEN snow < 0 THEN 0 ELSE snow END AS snow FROM p0),
p2 AS (SELECT station, date, ppt, CASE WHEN ppt IS NULL THEN NULL WHEN ppt <= 0 THEN 0 ELSE snow END AS snow FROM p1),
p3 AS (SELECT station, date, ppt, CASE WHEN ppt IS NULL OR snow IS NULL THEN NULL
  WHEN snow > ppt THEN ppt ELSE snow END AS snow FROM p2)
SELECT station, date, round(ppt, 6) + 0.0 AS ppt, round(snow, 6) + 0.0 AS snowfall,
  round(ppt - snow, 6) + 0.0 AS rain FROM p3""",
)
def partition_precip(spark, folder):
    amounts = wide(spark, folder).select(
        "station",
        "date",
        (F.col("view") - 60).alias("ppt"),
        (F.col("purchase") - 60).alias("snowfall"),
    )
    parts = climate.partition_precip(amounts)
    return parts.select(
        "station", "date", *(F.round(c, 6).alias(c) for c in ("ppt", "snowfall", "rain"))
    )


@register(
    "full_join_suffixed",
    f"""WITH {HOURLY}, daily AS (SELECT station, date_utc AS date, variable, SUM(value) AS value
  FROM hourly GROUP BY 1, 2, 3)
SELECT COALESCE(a.station, b.station) AS station, COALESCE(a.date, b.date) AS date,
  round(a.value, 6) AS value_x, round(b.value, 6) AS value_y
FROM (SELECT * FROM daily WHERE variable = 'view' AND value > 20) a
FULL JOIN (SELECT * FROM daily WHERE variable = 'click' AND value > 20) b
ON a.station = b.station AND a.date = b.date""",
)
def full_join_suffixed(spark, folder):
    daily = climate.rollup_climate(
        hourly(spark, folder).withColumn("date", F.col("date_utc")),
        ["station", "date"],
        "variable",
        "value",
        [],
    ).filter("value > 20")
    views = daily.filter("variable = 'view'").drop("variable")
    clicks = daily.filter("variable = 'click'").drop("variable")
    joined = clean.full_join_suffixed(views, clicks, ["station", "date"])
    return joined.withColumns({c: F.round(c, 6) for c in ("value_x", "value_y")})


def _ranges(spark, folder):
    """Record of every brand from its nation-independent first and last ship date."""
    return screens.series_range(brand_series(spark, folder), "station", "date").withColumns(
        {
            "start": F.date_add("start", (F.length("station") * 20).cast("int")),
            "end": F.date_sub("end", (F.length("station") * 30).cast("int")),
        }
    )


RANGES = """ranges AS (
  SELECT station, CAST(MIN(date) + CAST(length(station) * 20 AS INT) AS DATE) AS start,
    CAST(MAX(date) - CAST(length(station) * 30 AS INT) AS DATE) AS "end"
  FROM s_brand GROUP BY station)"""


@register(
    "clip_to_station_range",
    f"""WITH {BRAND}, {RANGES}
SELECT s.station, s.date, round(discharge, 2) AS discharge FROM s_brand s
JOIN ranges r ON r.station = s.station AND s.date BETWEEN start AND "end" """,
)
def clip_to_station_range(spark, folder):
    kept = climate.clip_to_station_range(
        brand_series(spark, folder), _ranges(spark, folder), "station", "date", "start", "end"
    )
    return kept.select("station", "date", F.round("discharge", 2).alias("discharge"))


PERIODS = {"historical": (1995, 1997), "recent": (1999, 2001)}
PERIOD_SQL = """CASE WHEN year BETWEEN 1995 AND 1997 THEN 'historical'
    WHEN year BETWEEN 1999 AND 2001 THEN 'recent' END"""


@register(
    "period_climatology",
    f"""WITH {BRAND}, {RANGES}, {dense_sql('s_brand')},
monthly AS (SELECT station, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
  AVG(discharge) AS discharge, make_date(CAST(year(date) AS INT), CAST(month(date) AS INT), 15) AS date
  FROM dense GROUP BY station, year(date), month(date)),
p AS (SELECT m.*, {PERIOD_SQL} AS period FROM monthly m JOIN ranges r
  ON r.station = m.station AND m.date BETWEEN r.start AND r."end"),
annual AS (SELECT station, period, year,
  CASE WHEN COUNT(discharge) = 12 THEN SUM(discharge) * 0.001 END AS total,
  CASE WHEN COUNT(discharge) = 12 THEN AVG(discharge) END AS mean
  FROM p WHERE period IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) = 12)
SELECT station, period, CAST(COUNT(*) AS BIGINT) AS n_years, round(log10(AVG(total)), 8) AS log_total,
  round(log10(AVG(mean)), 8) AS log_mean FROM annual GROUP BY 1, 2""",
)
def period_climatology(spark, folder):
    monthly = screens.monthly_mean(
        dense(brand_series(spark, folder)), "station", "date", "discharge", 31
    ).select("station", "date", "year", "discharge", F.col("discharge").alias("mean"))
    in_period = clean.assign_period(monthly, "year", PERIODS).drop("year")
    periods = spark.createDataFrame([(p,) for p in PERIODS], "period string")
    ranges = _ranges(spark, folder).select(
        "station", "start", "end", F.explode(F.array(*map(F.lit, PERIODS))).alias("period")
    )
    climatology = climate.period_climatology(
        in_period.withColumnRenamed("discharge", "total"),
        ranges,
        "station",
        {"total": 0.001},
        ["mean"],
        by=["period"],
    )
    # Logarithms, as plain means of a few prices often end exactly half-way.
    return climatology.select(
        "station",
        "period",
        "n_years",
        F.round(F.log10("total"), 8).alias("log_total"),
        F.round(F.log10("mean"), 8).alias("log_mean"),
    )


@register(
    "full_season_years",
    f"""WITH {BRAND}, {RANGES}
SELECT station, start, "end",
  CAST(year(start) + CASE WHEN dayofyear(start) <= 152 THEN 0 ELSE 1 END AS INT) AS first_year,
  CAST(year("end") - CASE WHEN dayofyear("end") >= 304 THEN 0 ELSE 1 END AS INT) AS last_year
FROM ranges""",
)
def full_season_years(spark, folder):
    bounds = climate.full_season_years(_ranges(spark, folder), 152, 304)
    return bounds.select("station", "start", "end", "first_year", "last_year")


def _season_bounds(spark, folder, a, b):
    bounds = climate.full_season_years(_ranges(spark, folder), a, b)
    return bounds.select(
        "station",
        "first_year",
        "last_year",
        F.explode(F.array(*map(F.lit, PERIODS))).alias("period"),
    )


def _bounds_sql(a: int, b: int) -> str:
    return f"""bounds AS (SELECT station,
  CAST(year(start) + CASE WHEN dayofyear(start) <= {a} THEN 0 ELSE 1 END AS INT) AS first_year,
  CAST(year("end") - CASE WHEN dayofyear("end") >= {b} THEN 0 ELSE 1 END AS INT) AS last_year
FROM ranges)"""


def _period_days(spark, folder, series):
    days = series.withColumns({"year": F.year("date"), "jday": F.dayofyear("date")})
    return clean.assign_period(days, "year", PERIODS)


def _days_sql(source: str) -> str:
    return f"""days AS (SELECT *, {PERIOD_SQL} AS period FROM (
  SELECT station, date, CAST(year(date) AS INT) AS year, CAST(dayofyear(date) AS INT) AS jday, discharge
  FROM {source}))"""


@register(
    "seasonality_index",
    f"""WITH {BRAND}, {RANGES}, {_bounds_sql(152, 304)}, {_days_sql('s_brand')},
season AS (SELECT d.*, SUM(discharge) OVER (PARTITION BY d.station, d.year) AS total
  FROM days d JOIN bounds b ON b.station = d.station AND d.year BETWEEN first_year AND last_year
  WHERE period IS NOT NULL AND jday BETWEEN 152 AND 304)
SELECT station, period, round(SUM(abs(discharge - total / 153) / total), 6) AS si
FROM season GROUP BY 1, 2""",
)
def seasonality_index(spark, folder):
    index = climate.seasonality_index(
        _period_days(spark, folder, brand_series(spark, folder)),
        "station",
        "discharge",
        _season_bounds(spark, folder, 152, 304),
        by=["period"],
    )
    return index.withColumn("si", F.round("si", 6))


@register(
    "melt_timing",
    f"""WITH {BRAND}, {RANGES}, {_bounds_sql(60, 182)}, {_days_sql('s_brand')},
centres AS (SELECT station, period, year, SUM(jday * discharge) / SUM(discharge) AS centre FROM days
  WHERE period IS NOT NULL AND jday >= 60 AND jday < 182 AND discharge > 0 GROUP BY 1, 2, 3),
kept AS (SELECT c.* FROM centres c JOIN bounds b ON b.station = c.station
  WHERE c.year BETWEEN first_year AND last_year)
SELECT station, period, round(AVG(centre), 6) AS melt_t,
  CAST(make_date(2001, 1, 1) + CAST(floor(AVG(centre)) AS INT) - 1 AS DATE) AS melt_day
FROM kept GROUP BY 1, 2""",
)
def melt_timing(spark, folder):
    timing = climate.melt_timing(
        _period_days(spark, folder, brand_series(spark, folder)),
        "station",
        "discharge",
        _season_bounds(spark, folder, 60, 182),
        by=["period"],
    )
    return timing.select(
        "station",
        "period",
        F.round("melt_t", 6).alias("melt_t"),
        jday_to_date(F.lit(2001), F.floor("melt_t")).alias("melt_day"),
    )


def _wide_sql(columns: dict[str, str]) -> str:
    return ", ".join(
        f"MAX(CASE WHEN period = '{p}' THEN {e} END) AS {c}_{p}" for c, e in columns.items() for p in PERIODS
    )


@register(
    "catchment_covariates",
    f"""WITH {BRAND}, {RANGES}, {dense_sql('s_brand')},
monthly AS (SELECT station, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
  AVG(discharge) AS discharge, make_date(CAST(year(date) AS INT), CAST(month(date) AS INT), 15) AS date
  FROM dense GROUP BY station, year(date), month(date)),
p AS (SELECT m.*, {PERIOD_SQL} AS period FROM monthly m JOIN ranges r
  ON r.station = m.station AND m.date BETWEEN r.start AND r."end"),
annual AS (SELECT station, period, year,
  CASE WHEN COUNT(discharge) = 12 THEN SUM(discharge) * 0.001 END AS total,
  CASE WHEN COUNT(discharge) = 12 THEN AVG(discharge) END AS mean
  FROM p WHERE period IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) = 12),
clim AS (SELECT station, period, AVG(total) AS total, AVG(mean) AS mean FROM annual GROUP BY 1, 2),
parts AS (SELECT station, date, discharge, greatest(discharge - 30000, 0) AS ppt,
  CASE WHEN discharge <= 30000 THEN 0 ELSE least(greatest(discharge * 0.4 - 20000, 0), discharge - 30000) END AS snow
  FROM s_brand),
si AS (SELECT * FROM (WITH {_bounds_sql(152, 304)}, {_days_sql('(SELECT station, date, ppt - snow AS discharge FROM parts)')},
  season AS (SELECT d.*, SUM(discharge) OVER (PARTITION BY d.station, d.year) AS total
    FROM days d JOIN bounds b ON b.station = d.station AND d.year BETWEEN first_year AND last_year
    WHERE period IS NOT NULL AND jday BETWEEN 152 AND 304)
  SELECT station, period, SUM(abs(discharge - total / 153) / total) AS si FROM season GROUP BY 1, 2)),
melt AS (SELECT * FROM (WITH {_bounds_sql(60, 182)}, {_days_sql('s_brand')},
  centres AS (SELECT station, period, year, SUM(jday * discharge) / SUM(discharge) AS centre FROM days
    WHERE period IS NOT NULL AND jday >= 60 AND jday < 182 AND discharge > 0 GROUP BY 1, 2, 3)
  SELECT c.station, period, AVG(centre) AS melt_t FROM centres c JOIN bounds b ON b.station = c.station
    WHERE c.year BETWEEN first_year AND last_year GROUP BY 1, 2)),
al AS (SELECT station, period, total, mean, si, melt_t FROM clim FULL JOIN si USING (station, period)
  FULL JOIN melt USING (station, period))
SELECT station, {_wide_sql({'total': 'round(log10(total), 8)', 'mean': 'round(log10(mean), 8)', 'si': 'round(si, 6)', 'melt_t': 'round(melt_t, 6)'})}
FROM al GROUP BY 1""",
)
def catchment_covariates_query(spark, folder):
    series = brand_series(spark, folder)
    monthly = screens.monthly_mean(dense(series), "station", "date", "discharge", 31).select(
        "station", "date", F.col("discharge").alias("total"), F.col("discharge").alias("mean")
    )
    daily = series.select(
        "station",
        F.year("date").alias("year"),
        F.dayofyear("date").alias("jday"),
        (F.col("discharge") - 30000).alias("ppt"),
        (F.col("discharge") * 0.4 - 20000).alias("snowfall"),
        F.col("discharge").alias("snowmelt"),
    )
    ranges = _ranges(spark, folder).select(
        "station", "start", "end", F.explode(F.array(*map(F.lit, PERIODS))).alias("period")
    )
    found = catchment_covariates(monthly, daily, ranges, "station", PERIODS, {"total": 0.001}, ["mean"])
    logs = [F.round(F.log10(f"{c}_{p}"), 8).alias(f"{c}_{p}") for c in ("total", "mean") for p in PERIODS]
    plain = [F.round(f"{c}_{p}", 6).alias(f"{c}_{p}") for c in ("si", "melt_t") for p in PERIODS]
    return found.select("station", *logs, *plain)


@register(
    "clip_by_period_bounds",
    f"""WITH {BRAND}, {NATION}, {_days_sql('s_brand')},
b AS (SELECT station, CAST(MIN(year(date)) AS INT) AS first_year, CAST(MAX(year(date)) - 1 AS INT) AS last_year
  FROM s_brand GROUP BY 1)
SELECT d.station, period, CAST(COUNT(*) AS BIGINT) AS n FROM days d JOIN b ON b.station = d.station
WHERE CASE WHEN period = 'recent' THEN year BETWEEN first_year + 5 AND last_year
  WHEN period = 'historical' THEN year BETWEEN first_year + 1 AND last_year END
GROUP BY 1, 2""",
)
def clip_by_period_bounds(spark, folder):
    series = brand_series(spark, folder)
    bounds = screens.series_range(series, "station", "date").select(
        "station",
        (F.year("start") + 5).alias("start_recent"),
        (F.year("start") + 1).alias("start_old"),
        (F.year("end") - 1).alias("last_year"),
    )
    days = clean.enrich(_period_days(spark, folder, series), bounds, "station")
    kept = clean.clip_by_period_bounds(
        days,
        "year",
        "period",
        {"recent": ("start_recent", "last_year"), "historical": ("start_old", "last_year")},
    )
    return kept.groupBy("station", "period").agg(F.count(F.lit(1)).alias("n"))


@register(
    "zonal_mean",
    """SELECT l_suppkey AS zone, round(SUM(p_retailprice * l_quantity) / SUM(l_quantity), 6) AS value
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def zonal_mean(spark, folder):
    cells = table(spark, folder, "part").select(
        F.col("p_partkey").alias("cell"), F.col("p_retailprice").alias("value")
    )
    weights = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("cell"), F.col("l_suppkey").alias("zone"), "l_quantity"
    )
    mean = climate.zonal_mean(cells, weights, "cell", "zone", "value", "l_quantity")
    return mean.withColumn("value", F.round("value", 6))


@register(
    "label_polygons",
    """WITH z AS (SELECT l_suppkey AS id, AVG(l_quantity) AS value FROM lineitem GROUP BY 1)
SELECT s_name AS station, round(value, 6) AS value FROM z JOIN supplier ON s_suppkey = id""",
)
def label_polygons(spark, folder):
    zones = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        F.avg("l_quantity").alias("value")
    )
    ids = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("station")
    )
    return climate.label_polygons(zones, ids, "id").select(
        "station", F.round("value", 6).alias("value")
    )


NAMES = {"ppt": "view", "snowfall": "purchase", "snowmelt": "signup", "temp": "click"}


@register(
    "monthly_climate_table",
    f"""WITH {HOURLY}, {LOCAL},
m AS (SELECT station, CAST(year(local_ts) AS INT) AS year, CAST(month(local_ts) AS INT) AS month, variable,
  CASE WHEN variable = 'click' THEN AVG(value) ELSE SUM(value) END AS value
  FROM local GROUP BY 1, 2, 3, 4 HAVING COUNT(*) > 100),
w AS (SELECT station, year, month, MAX(CASE WHEN variable = 'view' THEN value END) AS p,
  MAX(CASE WHEN variable = 'purchase' THEN value END) AS s,
  MAX(CASE WHEN variable = 'signup' THEN value END) AS snowmelt,
  MAX(CASE WHEN variable = 'click' THEN value END) AS temp FROM m GROUP BY 1, 2, 3)
SELECT station, year, month, round(p, 8) AS ppt,
  round(CASE WHEN s > p THEN p ELSE s END, 8) AS snowfall, round(snowmelt, 8) AS snowmelt,
  round(p - CASE WHEN s > p THEN p ELSE s END, 8) + 0.0 AS rain, round(temp - 273.15, 8) AS temp,
  make_date(year, month, 15) AS date FROM w""",
)
def monthly_climate_table(spark, folder):
    region = F.element_at(F.array(*map(F.lit, REGIONS)), (F.col("station") % 6 + 1).cast("int"))
    hours = hourly(spark, folder).withColumn("utc_ts", utc_timestamp("date_utc", "hour_utc"))
    offsets = hours.select("station").distinct().withColumn("hours_behind", utc_minus(region))
    monthly, _ = local_rollups(
        hours, offsets, "station", "utc_ts", "variable", "value", ["click"], month_hours=100
    )
    wide = monthly_table(monthly, "station", names=NAMES)
    rounded = ("ppt", "snowfall", "snowmelt", "rain", "temp")
    return wide.withColumns({c: F.round(c, 8) for c in rounded})


@register(
    "calendar_functions",
    """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INT) AS y,
  CAST(month(o_orderdate) AS INT) AS m, CAST(dayofyear(o_orderdate) AS INT) AS j FROM orders)
SELECT y AS year, m AS month, make_date(y, m, 15) AS middle, MIN(day) AS first_day, MAX(day) AS last_day,
  CAST(y AS VARCHAR) || '-' || CAST(m AS VARCHAR) AS label, CAST(COUNT(DISTINCT j) AS BIGINT) AS n_days
FROM o GROUP BY 1, 2""",
)
def calendar_functions(spark, folder):
    """Dates rebuilt from the day of the year and from epoch seconds."""
    day = F.to_date("o_orderdate")
    orders = table(spark, folder, "orders").select(
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        F.dayofyear("o_orderdate").alias("jday"),
        (F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400).alias("seconds"),
    )
    return orders.groupBy("year", "month").agg(
        F.max(mid_month("year", "month")).alias("middle"),
        F.min(jday_to_date("year", "jday")).alias("first_day"),
        F.to_date(F.max(epoch_to_timestamp("seconds"))).alias("last_day"),
        F.max(glue_label("year", "month")).alias("label"),
        F.count_distinct("jday").alias("n_days"),
    )
