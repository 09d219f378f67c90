"""Queries on catchment classes and the metadata table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import register
from catalogue.views import table
from riverspark.functions import recode, sentence_case
from riverspark.operators import catchment


def composition(spark, folder):
    """Share of each part type in a nation's supplied quantity."""
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    places = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("station"))
    )
    amounts = (
        lines.join(parts, "l_partkey")
        .join(places, "l_suppkey")
        .groupBy("station", F.col("p_type").alias("class"))
        .agg(F.sum("l_quantity").alias("area"))
    )
    totals = amounts.groupBy("station").agg(F.sum("area").alias("total"))
    return amounts.join(totals, "station").select(
        "station", "class", "area", (F.col("area") / F.col("total") * 100).alias("share")
    )


COMPOSITION = """amounts AS (
  SELECT n_name AS station, p_type AS class, SUM(l_quantity) AS area
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2),
composition AS (SELECT station, class, area,
  area / SUM(area) OVER (PARTITION BY station) * 100 AS share FROM amounts)"""


@register(
    "dominant_class",
    f"""WITH {COMPOSITION},
r AS (SELECT *, rank() OVER (PARTITION BY station ORDER BY share DESC) AS k FROM composition)
SELECT station, CASE WHEN label = 'Economy' THEN 'Standard' ELSE label END AS class,
  round(share, 6) AS share
FROM (SELECT *, left(class, 1) || lower(substr(class, 2)) AS label FROM r WHERE k = 1)""",
)
def dominant_class(spark, folder):
    labelled = composition(spark, folder).withColumn("class", sentence_case("class"))
    top = catchment.dominant_class(
        labelled, "station", "share", "class", merge={"Economy": "Standard"}
    )
    return top.select("station", "class", F.round("share", 6).alias("share"))


@register(
    "dominant_class_merged",
    f"""WITH {COMPOSITION},
m AS (SELECT station, CASE WHEN class = 'ECONOMY' THEN 'STANDARD' ELSE class END AS class,
  SUM(share) AS share FROM composition GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY share DESC, class) AS k FROM m)
SELECT station, class, round(share, 6) AS share FROM r WHERE k = 1""",
)
def dominant_class_merged(spark, folder):
    top = catchment.dominant_class(
        composition(spark, folder),
        "station",
        "share",
        "class",
        ties=False,
        merge={"ECONOMY": "STANDARD"},
        merge_first=True,
    )
    return top.select("station", "class", F.round("share", 6).alias("share"))


@register(
    "fill_remainder",
    f"""WITH {COMPOSITION}, cut AS (SELECT * FROM composition WHERE share >= 15)
SELECT station, class, round(area, 2) AS area, round(share, 6) AS share FROM cut
UNION ALL
SELECT station, 'Unfrozen', 0.0::DOUBLE, round(100 - SUM(share), 6) FROM cut
GROUP BY station HAVING SUM(share) < 100 * (1 - 1e-9)""",
)
def fill_remainder(spark, folder):
    cut = composition(spark, folder).filter("share >= 15")
    full = catchment.fill_remainder(
        cut, "station", "class", "share", "Unfrozen", "area", whole=100.0
    )
    return full.select(
        "station", "class", F.round("area", 2).alias("area"), F.round("share", 6).alias("share")
    )


@register(
    "catchment_table",
    f"""WITH {COMPOSITION},
r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY share DESC, class) AS k FROM composition),
top AS (SELECT station, class, share FROM r WHERE k = 1),
glacier AS (SELECT station, share AS glacier_percent FROM composition WHERE class = 'PROMO' AND share > 16),
area AS (SELECT n_name AS station, SUM(c_acctbal) AS balance, ln(COUNT(*)) AS log_n
  FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
SELECT station, class, round(share, 6) AS share, round(COALESCE(glacier_percent, 0), 6) AS glacier_percent,
  round(balance, 2) AS balance, round(log_n, 6) AS log_n,
  CASE WHEN COALESCE(glacier_percent, 0) < 17 THEN 'non-glacial' ELSE 'glacial' END AS glacial
FROM area FULL JOIN top USING (station) FULL JOIN glacier USING (station) WHERE class IS NOT NULL""",
)
def catchment_table(spark, folder):
    shares = composition(spark, folder)
    top = catchment.dominant_class(shares, "station", "share", "class", ties=False)
    glacier = shares.filter("class = 'PROMO' AND share > 16").select(
        "station", F.col("share").alias("glacier_percent")
    )
    nations = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("station")
    )
    area = (
        table(spark, folder, "customer")
        .join(nations, "c_nationkey")
        .groupBy("station")
        .agg(F.sum("c_acctbal").alias("balance"), F.ln(F.count(F.lit(1))).alias("log_n"))
    )
    wide = catchment.catchment_table(
        [area, top.drop("area"), glacier],
        "station",
        defaults={"glacier_percent": 0.0},
        required="class",
        classify={"glacial": ("glacier_percent", 17.0, "non-glacial", "glacial")},
    )
    return wide.withColumns(
        {
            "share": F.round("share", 6),
            "glacier_percent": F.round("glacier_percent", 6),
            "balance": F.round("balance", 2),
            "log_n": F.round("log_n", 6),
        }
    )


@register(
    "recode",
    """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'urgent'
    ELSE o_orderpriority END AS priority,
  CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS status,
  CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2""",
)
def recode_query(spark, folder):
    priority = recode("o_orderpriority", {"1-URGENT": "urgent", "2-HIGH": "urgent"})
    status = recode("o_orderstatus", {"F": "final", "O": "open"}, keep_others=False)
    return (
        table(spark, folder, "orders")
        .groupBy(priority.alias("priority"), status.alias("status"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
