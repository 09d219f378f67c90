"""Stand-in series on the test tables, in Spark and as SQL common table expressions.

The tables hold orders, not rivers: a brand or a nation plays the station, the
ship or order date the day, and a summed price the flow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverspark.operators.series import densify_daily
from riverspark.operators.spectral import prepare_flow, seasonal_signal
from riverspark.sources import read_table

HISTORICAL = ("1995-01-01", "1997-12-31")
RECENT = ("1999-01-01", "2001-12-31")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def brand_series(spark: SparkSession, folder: str) -> DataFrame:
    """station = part brand, date = ship date, discharge = summed price."""
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("station")
    )
    return (
        lines.join(parts, "l_partkey")
        .groupBy("station", F.to_date("l_shipdate").alias("date"))
        .agg(F.sum("l_extendedprice").alias("discharge"))
    )


BRAND = """s_brand AS (
  SELECT p_brand AS station, CAST(l_shipdate AS DATE) AS date, SUM(l_extendedprice) AS discharge
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def nation_series(spark: SparkSession, folder: str) -> DataFrame:
    """station = supplier nation, date = ship date, discharge = summed price."""
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")
    )
    nations = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("station"))
    return (
        lines.join(suppliers.join(nations, "n_nationkey"), "l_suppkey")
        .groupBy("station", F.to_date("l_shipdate").alias("date"))
        .agg(F.sum("l_extendedprice").alias("discharge"))
    )


NATION = """s_nation AS (
  SELECT n_name AS station, CAST(l_shipdate AS DATE) AS date, SUM(l_extendedprice) AS discharge
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2)"""


def order_series(spark: SparkSession, folder: str) -> DataFrame:
    """station = customer nation, date = order date, discharge = summed order price."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")
    )
    nations = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("station"))
    return (
        orders.join(customers.join(nations, "n_nationkey"), "o_custkey")
        .groupBy("station", F.to_date("o_orderdate").alias("date"))
        .agg(F.sum("o_totalprice").alias("discharge"))
    )


ORDERS = """s_orders AS (
  SELECT n_name AS station, CAST(o_orderdate AS DATE) AS date, SUM(o_totalprice) AS discharge
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)"""


def dense(df: DataFrame) -> DataFrame:
    return densify_daily(df, "station", "date", "discharge")


def dense_sql(source: str, name: str = "dense") -> str:
    return f"""{name}_range AS (
  SELECT station, MIN(date) AS lo, MAX(date) AS hi FROM {source} GROUP BY 1),
{name} AS (
  SELECT d.station, d.date, s.discharge
  FROM (SELECT station, CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
        FROM {name}_range) d
  LEFT JOIN {source} s ON s.station = d.station AND s.date = d.date)"""


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    return prepare_flow(brand_series(spark, folder), "station", "date", "discharge")


def signal(spark: SparkSession, folder: str) -> DataFrame:
    return seasonal_signal(prepared(spark, folder), "station", "date")


def prepared_sql(source: str, p: str = "") -> str:
    """Gap-filled log series on whole years; ``p`` prefixes the CTE names."""
    return f"""{p}pos AS (SELECT * FROM {source} WHERE discharge > 0),
{p}stats AS (
  SELECT *, CAST(floor(years * 365.25) AS INT) AS n FROM (
    SELECT station, MIN(date) AS lo, MAX(date) AS hi, AVG(discharge) AS mean_q,
           CAST(floor((MAX(date) - MIN(date) + 1) / 365.25) AS INT) AS years
    FROM {p}pos GROUP BY 1) WHERE years >= 1),
{p}days AS (
  SELECT station, CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
  FROM {p}stats),
{p}logged AS (
  SELECT d.station, d.date, log10(s.discharge / t.mean_q) AS y0
  FROM {p}days d JOIN {p}stats t ON t.station = d.station
  LEFT JOIN {p}pos s ON s.station = d.station AND s.date = d.date),
{p}edges AS (
  SELECT station, date, y0,
    LAST_VALUE(y0 IGNORE NULLS) OVER back AS y_a,
    LAST_VALUE(CASE WHEN y0 IS NOT NULL THEN date END IGNORE NULLS) OVER back AS d_a,
    FIRST_VALUE(y0 IGNORE NULLS) OVER ahead AS y_b,
    FIRST_VALUE(CASE WHEN y0 IS NOT NULL THEN date END IGNORE NULLS) OVER ahead AS d_b
  FROM {p}logged
  WINDOW back AS (PARTITION BY station ORDER BY date ROWS UNBOUNDED PRECEDING),
         ahead AS (PARTITION BY station ORDER BY date
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{p}prep AS (
  SELECT e.station, e.date, CAST(e.date - t.lo AS INT) AS t, t.n, t.years,
    CASE WHEN y0 IS NOT NULL THEN y0
         ELSE y_a + (y_b - y_a) * (e.date - d_a) / CAST(d_b - d_a AS DOUBLE) END AS y,
    y0 IS NOT NULL AS observed
  FROM {p}edges e JOIN {p}stats t ON t.station = e.station)"""


def _angle(k: int) -> str:
    return f"(2 * pi() * {k} * years * t / n)"


def terms_sql(p: str = "") -> str:
    sums = ",\n    ".join(
        f"2.0 / MAX(n) * SUM(y * {f}({_angle(k)})) AS {c}{k}"
        for k in (1, 2, 3)
        for c, f in (("a", "cos"), ("c", "sin"))
    )
    return f"""{p}terms AS (
  SELECT station, MAX(n) AS n, MAX(years) AS years, AVG(y) AS mean_y, VAR_POP(y) AS var_y,
    {sums}
  FROM {p}prep WHERE t < n GROUP BY 1)"""


def signal_sql(p: str = "") -> str:
    fit = " + ".join(
        f"a{k} * cos({_angle(k).replace('years', 'p.years').replace('* t', '* p.t').replace('/ n', '/ p.n')})"
        f" + c{k} * sin({_angle(k).replace('years', 'p.years').replace('* t', '* p.t').replace('/ n', '/ p.n')})"
        for k in (1, 2, 3)
    )
    return f"""{p}signal AS (
  SELECT station, date, CAST(year(date) AS INT) AS year, CAST(dayofyear(date) AS INT) AS jday,
         y, pred, CASE WHEN observed THEN y - pred END AS resid
  FROM (SELECT p.station, p.date, p.y, p.observed, mean_y + {fit} AS pred
        FROM {p}prep p JOIN {p}terms t ON t.station = p.station))"""


def full_signal_sql(source: str = "s_brand", p: str = "") -> str:
    return ",\n".join([prepared_sql(source, p), terms_sql(p), signal_sql(p)])
