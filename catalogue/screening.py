"""Queries on cleaning, source merging and completeness screens."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalogue import register
from catalogue.views import (
    BRAND,
    NATION,
    ORDERS,
    brand_series,
    dense,
    dense_sql,
    nation_series,
    order_series,
    table,
)
from riverspark.functions import CFS_TO_M3S, convert
from riverspark.operators import clean, intervals, screens
from riverspark.plans.flow import screened_flow
from riverspark.session import shared_folder
from riverspark.sources import append, daily_values, read_csv_skip, read_many, stack_tables, write_bucketed, write_table

DATE = dt.date


def _rules(spark):
    rows = [
        ("Brand#1", DATE(1996, 3, 31), False),
        ("Brand#2", DATE(1995, 6, 1), True),
        ("Brand#2", DATE(1995, 9, 1), True),
        ("Brand#7", DATE(1997, 1, 1), True),
    ]
    return spark.createDataFrame(rows, "station string, min_date date, inclusive boolean")


@register(
    "unit_convert_clip",
    f"""WITH {BRAND}
SELECT station, date, round(discharge * 0.028316846592, 4) AS flow FROM s_brand
WHERE date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' AND station <> 'Brand#25'""",
)
def unit_convert_clip(spark, folder):
    series = clean.clip_period(
        brand_series(spark, folder), "date", DATE(1995, 1, 1), DATE(1997, 12, 31)
    )
    return series.filter(F.col("station") != "Brand#25").select(
        "station", "date", F.round(convert("discharge", CFS_TO_M3S), 4).alias("flow")
    )


@register(
    "mask_by_flag",
    """SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS BIGINT) AS n,
  CAST(COUNT(CASE WHEN l_returnflag IN ('A', 'R') THEN l_quantity END) AS BIGINT) AS n_kept,
  round(SUM(CASE WHEN l_returnflag IN ('A', 'R') THEN l_quantity END), 2) AS kept
FROM lineitem GROUP BY 1, 2""",
)
def mask_by_flag(spark, folder):
    masked = clean.mask_by_flag(
        table(spark, folder, "lineitem"), "l_quantity", "l_returnflag", ["A", "R"], into="value"
    )
    return masked.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("value").alias("n_kept"),
        F.round(F.sum("value"), 2).alias("kept"),
    )


@register(
    "trim_rules",
    f"""WITH {BRAND},
rules(station, min_date, inclusive) AS (VALUES
  ('Brand#1', DATE '1996-03-31', false), ('Brand#2', DATE '1995-06-01', true),
  ('Brand#2', DATE '1995-09-01', true), ('Brand#7', DATE '1997-01-01', true))
SELECT station, date, round(discharge, 2) AS discharge FROM s_brand s
WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.station = s.station AND
  NOT CASE WHEN inclusive THEN s.date >= min_date ELSE s.date > min_date END)""",
)
def trim_rules(spark, folder):
    kept = clean.apply_trim_rules(brand_series(spark, folder), _rules(spark), "station", "date")
    return kept.select("station", "date", F.round("discharge", 2).alias("discharge"))


@register(
    "daily_values",
    """WITH keep AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
SELECT l_suppkey AS station, CAST(COUNT(*) AS BIGINT) AS n, round(SUM(l_quantity), 2) AS quantity
FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey IN (SELECT s_suppkey FROM keep) GROUP BY 1""",
)
def daily_values_query(spark, folder):
    stations = (
        table(spark, folder, "supplier")
        .filter("s_acctbal > 0")
        .select(F.col("s_suppkey").alias("station"))
    )
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_suppkey", "station")
    kept = daily_values(lines, stations, "R", parameter_col="l_returnflag")
    return kept.groupBy("station").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@register(
    "densify_daily",
    f"""WITH {BRAND}, {dense_sql('s_brand')}
SELECT station, date, round(discharge, 2) AS discharge FROM dense""",
)
def densify_daily_query(spark, folder):
    return dense(brand_series(spark, folder)).select(
        "station", "date", F.round("discharge", 2).alias("discharge")
    )


@register(
    "series_range_eligible",
    f"""WITH {NATION},
r AS (SELECT station, MIN(date) AS start, MAX(date) AS "end" FROM s_nation GROUP BY 1),
ok AS (SELECT * FROM r WHERE start < DATE '1996-01-01' AND "end" > DATE '2001-01-01')
SELECT station, start, "end", round(("end" - start) / 365.0, 6) AS length_years,
  (SELECT MAX(start) FROM ok) AS latest_start, (SELECT MIN("end") FROM ok) AS earliest_end
FROM ok""",
)
def series_range_eligible(spark, folder):
    ok = screens.eligible_by_range(
        nation_series(spark, folder), "station", "date", DATE(1996, 1, 1), DATE(2001, 1, 1)
    )
    extremes = screens.range_extremes(ok)
    return ok.select(
        "station",
        "start",
        "end",
        F.round("length_years", 6).alias("length_years"),
        extremes.select("latest_start").scalar().alias("latest_start"),
        extremes.select("earliest_end").scalar().alias("earliest_end"),
    )


@register(
    "missing_share",
    f"""WITH {BRAND}, {dense_sql('s_brand')}
SELECT station, CAST(COUNT(*) AS BIGINT) AS n,
  CAST(COUNT(*) - COUNT(discharge) AS BIGINT) AS n_missing,
  round((COUNT(*) - COUNT(discharge)) / CAST(COUNT(*) AS DOUBLE), 8) AS share
FROM dense GROUP BY 1 HAVING (COUNT(*) - COUNT(discharge)) / CAST(COUNT(*) AS DOUBLE) > 0.05""",
)
def missing_share(spark, folder):
    share = intervals.record_share(_months(brand_series(spark, folder)), "station", 0.05)
    return share.withColumn("share", F.round("share", 8))


MONTHLY = """monthly AS (
  SELECT station, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
    CASE WHEN COUNT(*) - COUNT(discharge) <= {k} THEN AVG(discharge) END AS discharge,
    CAST(COUNT(*) - COUNT(discharge) AS BIGINT) AS n_missing,
    make_date(CAST(year(date) AS INT), CAST(month(date) AS INT), 15) AS date
  FROM dense GROUP BY station, year(date), month(date))"""


@register(
    "monthly_mean_gap_tolerant",
    f"""WITH {BRAND}, {dense_sql('s_brand')}, {MONTHLY.format(k=10)}
SELECT station, year, month, round(discharge, 6) AS discharge, n_missing, date FROM monthly""",
)
def monthly_mean_gap_tolerant(spark, folder):
    monthly = _months(brand_series(spark, folder)).drop("n")
    return monthly.withColumn("discharge", F.round("discharge", 6))


def _months(series, k=10):
    """One row per station and month of its record, from the observed days."""
    observed = intervals.observed_months(series, "station", "date", "discharge")
    return intervals.record_months(observed, "station", "discharge", k)


def _order_months(spark, folder, k=22):
    return _months(order_series(spark, folder), k).drop("n")


ORDER_MONTHS = f"{ORDERS}, {dense_sql('s_orders')}, {MONTHLY.format(k=22)}"


@register(
    "missing_share_by_month",
    f"""WITH {ORDER_MONTHS}
SELECT station, month, CAST(COUNT(*) AS BIGINT) AS n,
  CAST(COUNT(*) - COUNT(discharge) AS BIGINT) AS n_missing,
  round((COUNT(*) - COUNT(discharge)) / CAST(COUNT(*) AS DOUBLE), 8) AS share
FROM monthly GROUP BY 1, 2
HAVING (COUNT(*) - COUNT(discharge)) / CAST(COUNT(*) AS DOUBLE) > 0.3""",
)
def missing_share_by_month(spark, folder):
    share = screens.missing_share(
        _order_months(spark, folder), ["station", "month"], "discharge", 0.3
    )
    return share.withColumn("share", F.round("share", 8))


@register(
    "gap_islands_year",
    f"""WITH {ORDER_MONTHS},
marked AS (
  SELECT station, month, year,
    CASE WHEN year - LAG(year) OVER w <= 1 THEN 0 ELSE 1 END AS fresh
  FROM monthly WHERE discharge IS NULL WINDOW w AS (PARTITION BY station, month ORDER BY year)),
grouped AS (SELECT *, SUM(fresh) OVER (PARTITION BY station, month ORDER BY year) AS island FROM marked)
SELECT station, month, CAST(island AS BIGINT) AS island, CAST(COUNT(*) AS BIGINT) AS n,
  MIN(year) AS gap_start, MAX(year) AS gap_end
FROM grouped GROUP BY station, month, island HAVING COUNT(*) > 1""",
)
def gap_islands_year(spark, folder):
    void = _order_months(spark, folder).filter(F.col("discharge").isNull())
    return screens.gap_islands(void, ["station", "month"], "year", 1, 1)


@register(
    "gap_islands_days",
    f"""WITH {ORDER_MONTHS},
marked AS (
  SELECT station, date, CASE WHEN date - LAG(date) OVER w <= 70 THEN 0 ELSE 1 END AS fresh
  FROM monthly WHERE discharge IS NULL WINDOW w AS (PARTITION BY station ORDER BY date)),
grouped AS (SELECT *, SUM(fresh) OVER (PARTITION BY station ORDER BY date) AS island FROM marked)
SELECT station, CAST(island AS BIGINT) AS island, CAST(COUNT(*) AS BIGINT) AS n,
  MIN(date) AS gap_start, MAX(date) AS gap_end
FROM grouped GROUP BY station, island HAVING COUNT(*) > 4""",
)
def gap_islands_days(spark, folder):
    void = _order_months(spark, folder).filter(F.col("discharge").isNull())
    return screens.gap_islands(void, "station", "date", 70, 4)


@register(
    "select_stations",
    f"""WITH {NATION}, {dense_sql('s_nation')}, {MONTHLY.format(k=15)},
by_day AS (SELECT station FROM dense GROUP BY 1
  HAVING (COUNT(*) - COUNT(discharge)) / CAST(COUNT(*) AS DOUBLE) > 0.5),
by_month AS (SELECT DISTINCT station FROM (SELECT station, month FROM monthly GROUP BY 1, 2
  HAVING (COUNT(*) - COUNT(discharge)) / CAST(COUNT(*) AS DOUBLE) > 0.5)),
y1 AS (SELECT station, month, year,
    CASE WHEN year - LAG(year) OVER w <= 4 THEN 0 ELSE 1 END AS fresh
  FROM monthly WHERE discharge IS NULL WINDOW w AS (PARTITION BY station, month ORDER BY year)),
y2 AS (SELECT *, SUM(fresh) OVER (PARTITION BY station, month ORDER BY year) AS island FROM y1),
by_year_gap AS (SELECT DISTINCT station FROM
  (SELECT station FROM y2 GROUP BY station, month, island HAVING COUNT(*) > 4)),
d1 AS (SELECT station, date, CASE WHEN date - LAG(date) OVER w <= 70 THEN 0 ELSE 1 END AS fresh
  FROM monthly WHERE discharge IS NULL WINDOW w AS (PARTITION BY station ORDER BY date)),
d2 AS (SELECT *, SUM(fresh) OVER (PARTITION BY station ORDER BY date) AS island FROM d1),
by_gap AS (SELECT DISTINCT station FROM (SELECT station FROM d2 GROUP BY station, island
  HAVING COUNT(*) > 4 AND MIN(date) < DATE '2001-01-01')
  WHERE station NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 0)),
rejected AS (SELECT station FROM by_day UNION SELECT station FROM by_month
  UNION SELECT station FROM by_year_gap UNION SELECT station FROM by_gap
  UNION SELECT n_name FROM nation WHERE n_regionkey = 4)
SELECT station, CAST(COUNT(*) AS BIGINT) AS n_days, CAST(COUNT(discharge) AS BIGINT) AS n_values,
  MIN(date) AS start, MAX(date) AS "end"
FROM dense d WHERE NOT EXISTS (SELECT 1 FROM rejected r WHERE r.station = d.station) GROUP BY 1""",
)
def select_stations(spark, folder):
    nations = table(spark, folder, "nation").withColumnRenamed("n_name", "station")
    kept = screens.select_stations(
        dense(nation_series(spark, folder)),
        "station",
        "date",
        "discharge",
        max_share=0.5,
        max_missing_days=15,
        gap_before=DATE(2001, 1, 1),
        pardon_gaps=nations.filter("n_regionkey = 0"),
        reject=[nations.filter("n_regionkey = 4")],
        max_month_share=0.5,
    )
    return kept.groupBy("station").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count("discharge").alias("n_values"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
    )


@register(
    "missing_keys",
    f"""WITH {BRAND}, {NATION}
SELECT station FROM (SELECT DISTINCT n_name AS station FROM nation)
WHERE station NOT IN (SELECT station FROM s_nation WHERE discharge > 400000)""",
)
def missing_keys(spark, folder):
    strong = nation_series(spark, folder).filter("discharge > 400000")
    names = table(spark, folder, "nation").select(F.col("n_name").alias("station"))
    return clean.missing_keys(names, strong, "station")


@register(
    "append_sources",
    f"""WITH {BRAND}, {NATION},
both_sources AS (
  SELECT station, date, discharge, NULL AS region, CAST('brand' AS VARCHAR) AS source FROM s_brand
  UNION ALL
  SELECT s.station, date, discharge, r_name, 'nation' FROM s_nation s
  JOIN nation ON n_name = s.station JOIN region ON r_regionkey = n_regionkey)
SELECT station, CAST(region AS VARCHAR) AS region, source, CAST(COUNT(*) AS BIGINT) AS n,
  round(SUM(discharge), 2) AS total FROM both_sources GROUP BY 1, 2, 3""",
)
def append_sources(spark, folder):
    nations = table(spark, folder, "nation").select(
        F.col("n_name").alias("station"), F.col("n_regionkey").alias("r_regionkey")
    )
    regions = nations.join(table(spark, folder, "region"), "r_regionkey").select(
        "station", F.col("r_name").alias("region")
    )
    brand = brand_series(spark, folder).withColumn("source", F.lit("brand"))
    nation = clean.enrich(nation_series(spark, folder), regions, "station").withColumn(
        "source", F.lit("nation")
    )
    return append(brand, nation).groupBy("station", "region", "source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("discharge"), 2).alias("total")
    )


@register(
    "stack_tables",
    """WITH s AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS id, l_quantity AS value FROM lineitem
  UNION ALL SELECT o_orderpriority, NULL FROM orders
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), TRY_CAST(c_name AS DOUBLE) FROM customer)
SELECT id, CAST(COUNT(*) AS BIGINT) AS n, round(SUM(value), 2) AS total FROM s GROUP BY 1""",
)
def stack_tables_query(spark, folder):
    from pyspark.sql import types as T

    schema = T.StructType(
        [T.StructField("id", T.StringType()), T.StructField("value", T.DoubleType())]
    )
    stacked = stack_tables(
        [
            table(spark, folder, "lineitem").selectExpr("l_orderkey AS id", "l_quantity AS value"),
            table(spark, folder, "orders").selectExpr("o_orderpriority AS id"),
            table(spark, folder, "customer").selectExpr("c_custkey AS id", "c_name AS value"),
        ],
        schema,
    )
    return stacked.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@register(
    "enrich_station",
    f"""WITH {NATION}
SELECT r_name AS region, s.station, CAST(COUNT(*) AS BIGINT) AS n
FROM s_nation s LEFT JOIN nation ON n_name = s.station JOIN region ON n_regionkey = r_regionkey
GROUP BY 1, 2""",
)
def enrich_station(spark, folder):
    nations = table(spark, folder, "nation").select(
        F.col("n_name").alias("station"), F.col("n_regionkey").alias("r_regionkey")
    )
    regions = table(spark, folder, "region").withColumnRenamed("r_name", "region")
    joined = clean.enrich(nation_series(spark, folder), nations, "station")
    return joined.join(regions, "r_regionkey").groupBy("region", "station").agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "precedence_merge",
    f"""WITH {BRAND},
finals AS (SELECT station, date, discharge FROM s_brand WHERE date < DATE '1999-01-01'),
prelim AS (SELECT station, date, discharge * 2 AS discharge, 'prelim' AS version
  FROM s_brand WHERE date >= DATE '1998-06-01'),
merged AS (
  SELECT station, date, discharge, CAST(NULL AS VARCHAR) AS version FROM finals
  UNION ALL SELECT * FROM prelim p WHERE NOT EXISTS
    (SELECT 1 FROM finals f WHERE f.station = p.station AND f.date = p.date))
SELECT station, date, round(discharge, 2) AS discharge, version FROM merged""",
)
def precedence_merge(spark, folder):
    series = brand_series(spark, folder)
    final = clean.clip_period(series, "date", hi=DATE(1999, 1, 1), hi_open=True)
    prelim = clean.clip_period(series, "date", lo=DATE(1998, 6, 1)).select(
        "station",
        "date",
        (F.col("discharge") * 2).alias("discharge"),
        F.lit("prelim").alias("version"),
    )
    merged = clean.merge_with_precedence(final, prelim, ["station", "date"])
    return merged.withColumn("discharge", F.round("discharge", 2))


@register(
    "replace_keys",
    f"""WITH {BRAND}, better AS (SELECT station, date, -discharge AS discharge FROM s_brand
  WHERE station IN ('Brand#3', 'Brand#4') AND date >= DATE '1997-01-01')
SELECT station, date, round(discharge, 2) AS discharge FROM s_brand
WHERE station NOT IN (SELECT station FROM better)
UNION ALL SELECT station, date, round(discharge, 2) FROM better""",
)
def replace_keys(spark, folder):
    series = brand_series(spark, folder)
    better = series.filter(
        F.col("station").isin("Brand#3", "Brand#4") & (F.col("date") >= F.lit(DATE(1997, 1, 1)))
    ).withColumn("discharge", -F.col("discharge"))
    merged = clean.replace_keys(series, better, "station")
    return merged.withColumn("discharge", F.round("discharge", 2))


@register(
    "override_values",
    """WITH fixes(n_name, n_new) AS (SELECT n_name, 'renamed ' || r_name FROM nation
  JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey IN (1, 3))
SELECT CAST(c_custkey AS BIGINT) AS custkey, COALESCE(n_new, n.n_name) AS n_name
FROM customer JOIN nation n ON c_nationkey = n_nationkey LEFT JOIN fixes f ON f.n_name = n.n_name""",
)
def override_values(spark, folder):
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    fixes = (
        nation.join(region, nation.n_regionkey == region.r_regionkey)
        .filter(F.col("r_regionkey").isin(1, 3))
        .select("n_nationkey", F.concat(F.lit("renamed "), "r_name").alias("n_name"))
    )
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("n_nationkey")
    )
    named = customers.join(nation.select("n_nationkey", "n_name"), "n_nationkey")
    return clean.override_values(named, fixes, "n_nationkey", "n_name").select("custkey", "n_name")


@register(
    "global_min_gate",
    f"""WITH {BRAND}
SELECT station, CAST(COUNT(*) AS BIGINT) AS n FROM s_brand
WHERE (SELECT MIN(year(date)) FROM s_brand) < 1996 GROUP BY 1""",
)
def global_min_gate(spark, folder):
    series = brand_series(spark, folder).withColumn("year", F.year("date"))
    gated = clean.above_global_min(series, "year", 1996)
    return gated.groupBy("station").agg(F.count(F.lit(1)).alias("n"))


@register(
    "min_group_size",
    f"""WITH {BRAND},
big AS (SELECT station, year(date) AS y FROM s_brand GROUP BY 1, 2 HAVING COUNT(*) > 200)
SELECT s.station, s.date FROM s_brand s JOIN big b ON b.station = s.station AND b.y = year(s.date)""",
)
def min_group_size(spark, folder):
    series = brand_series(spark, folder).withColumn("year", F.year("date"))
    return clean.min_group_size(series, ["station", "year"], 200).select("station", "date")


@register(
    "top_by_ties",
    """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity,
  rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS k FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, round(l_quantity, 2) AS l_quantity FROM r WHERE k = 1""",
)
def top_by_ties(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"
    )
    top = clean.top_by(lines, "l_suppkey", "l_quantity")
    return top.withColumn("l_quantity", F.round("l_quantity", 2))


@register(
    "dedupe_keep_first",
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, round(o_totalprice, 2) AS price
FROM r WHERE k = 1""",
)
def dedupe_keep_first(spark, folder):
    orders = table(spark, folder, "orders")
    first = clean.dedupe(orders, "o_custkey", ["o_orderdate", "o_orderkey"])
    return first.select(
        "o_custkey",
        "o_orderkey",
        F.to_date("o_orderdate").alias("day"),
        F.round("o_totalprice", 2).alias("price"),
    )


@register(
    "screened_flow",
    f"""WITH s_raw AS (
  SELECT n_name AS station, CAST(l_shipdate AS DATE) AS date, SUM(l_extendedprice) AS discharge,
    MIN(l_returnflag) AS flag
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2),
s_ok AS (SELECT station, date, discharge FROM s_raw WHERE flag IN ('A', 'N')),
{dense_sql('s_ok', 'filled')},
eligible AS (SELECT station FROM filled GROUP BY 1
  HAVING MIN(date) < DATE '1996-01-01' AND MAX(date) > DATE '2001-01-01'),
dense AS (SELECT * FROM filled WHERE station IN (SELECT station FROM eligible)
  AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
  AND NOT (date < DATE '1996-07-01' AND station IN (SELECT n_name FROM nation WHERE n_regionkey = 1))),
{MONTHLY.format(k=20)},
y1 AS (SELECT station, month, year,
    CASE WHEN year - LAG(year) OVER w <= 4 THEN 0 ELSE 1 END AS fresh
  FROM monthly WHERE discharge IS NULL WINDOW w AS (PARTITION BY station, month ORDER BY year)),
y2 AS (SELECT *, SUM(fresh) OVER (PARTITION BY station, month ORDER BY year) AS island FROM y1),
d1 AS (SELECT station, date, CASE WHEN date - LAG(date) OVER w <= 70 THEN 0 ELSE 1 END AS fresh
  FROM monthly WHERE discharge IS NULL WINDOW w AS (PARTITION BY station ORDER BY date)),
d2 AS (SELECT *, SUM(fresh) OVER (PARTITION BY station ORDER BY date) AS island FROM d1),
bad AS (SELECT station FROM dense GROUP BY 1
    HAVING (COUNT(*) - COUNT(discharge)) / CAST(COUNT(*) AS DOUBLE) > 0.7
  UNION SELECT station FROM monthly GROUP BY station, month
    HAVING (COUNT(*) - COUNT(discharge)) / CAST(COUNT(*) AS DOUBLE) > 0.6
  UNION SELECT station FROM y2 GROUP BY station, month, island HAVING COUNT(*) > 4
  UNION SELECT station FROM d2 GROUP BY station, island HAVING COUNT(*) > 4)
SELECT station, CAST(COUNT(*) AS BIGINT) AS n_days, CAST(COUNT(discharge) AS BIGINT) AS n_values,
  round(SUM(discharge), 2) AS total FROM dense WHERE station NOT IN (SELECT station FROM bad) GROUP BY 1""",
)
def screened_flow_query(spark, folder):
    lines = table(spark, folder, "lineitem")
    places = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("station"))
    )
    raw = (
        lines.join(places, "l_suppkey")
        .groupBy("station", F.to_date("l_shipdate").alias("date"))
        .agg(F.sum("l_extendedprice").alias("discharge"), F.min("l_returnflag").alias("flag"))
    )
    rules = table(spark, folder, "nation").filter("n_regionkey = 1")
    rules = rules.select(F.col("n_name").alias("station"), F.lit(DATE(1996, 7, 1)).alias("min_date"))
    kept = screened_flow(
        raw,
        "station",
        "date",
        "discharge",
        flag="flag",
        allowed=["A", "N"],
        period=(DATE(1996, 1, 1), DATE(2000, 12, 31)),
        start_before=DATE(1996, 1, 1),
        end_after=DATE(2001, 1, 1),
        max_share=0.7,
        max_month_share=0.6,
        max_missing_days=20,
        trim_rules=rules,
    )
    return kept.groupBy("station").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count("discharge").alias("n_values"),
        F.round(F.sum("discharge"), 2).alias("total"),
    )


@register(
    "glob_sources",
    """SELECT 'nation.parquet' AS source, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(n_name) AS BIGINT) AS nations FROM nation
UNION ALL SELECT 'region.parquet', COUNT(*), 0 FROM region""",
)
def glob_sources(spark, folder):
    """Every file of a glob with its name; a file without a column gives NULLs."""
    rows = read_many(spark, f"{folder}/*ion.parquet", "n_name string, r_name string")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("n_name").alias("nations"))


@register(
    "sorted_series",
    f"""WITH {BRAND}
SELECT station, date, round(discharge, 2) AS discharge,
  CAST(row_number() OVER (PARTITION BY station ORDER BY date) AS INT) AS place FROM s_brand ORDER BY station, date""",
)
def sorted_series(spark, folder):
    """Rows in output order; ``place`` is computed from that order, per station."""
    placed = Window.partitionBy("station").orderBy("date")
    rows = brand_series(spark, folder).withColumn("place", F.row_number().over(placed))
    return rows.withColumn("discharge", F.round("discharge", 2)).orderBy("station", "date")


@register(
    "annual_peaks",
    f"""WITH {BRAND}, y AS (SELECT *, CAST(year(date) AS INT) AS year FROM s_brand),
tops AS (SELECT station, year, MAX(discharge) AS top, CAST(COUNT(*) AS BIGINT) AS n_days FROM y GROUP BY 1, 2)
SELECT station, year, date, round(discharge, 2) AS discharge, n_days
FROM y JOIN tops USING (station, year) WHERE discharge = top""",
)
def annual_peaks(spark, folder):
    """Series and yearly maxima written in the same buckets, then joined without an exchange."""
    tag = uuid.uuid4().hex
    series = brand_series(spark, folder).withColumn("year", F.year("date"))
    series = write_bucketed(series, f"series_{tag}", ["station", "year"], 8, "date")
    tops = series.groupBy("station", "year").agg(F.max("discharge").alias("top"), F.count(F.lit(1)).alias("n_days"))
    tops = write_bucketed(tops, f"tops_{tag}", ["station", "year"], 8)
    peaks = series.join(tops, ["station", "year"]).filter("discharge = top")
    return peaks.select("station", "year", "date", F.round("discharge", 2).alias("discharge"), "n_days")


@register(
    "text_round_trip",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, o_orderpriority FROM orders""",
)
def text_round_trip(spark, folder):
    """Orders written as text with a head line in each file, and scanned again behind it."""
    path = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    orders = table(spark, folder, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    orders = orders.select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    write_table(orders, path, "csv")
    return read_csv_skip(spark, path, 1, orders.schema, header=False)
