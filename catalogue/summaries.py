"""Queries on order statistics, shares, densities, hulls and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import register
from catalogue.statistics import VECTORS, vectors
from catalogue.views import table
from riverspark.operators import spatial, summaries
from riverspark.operators.clean import unordered_pairs


@register(
    "box_summary",
    """WITH q AS (SELECT o_orderpriority, CAST(COUNT(*) AS BIGINT) AS n,
    quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
    quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT o_orderpriority, n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
  round(MIN(o_totalprice), 2) AS lower, round(MAX(o_totalprice), 2) AS upper
FROM orders JOIN q USING (o_orderpriority)
WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""",
)
def box_summary(spark, folder):
    box = summaries.box_summary(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice")
    return box.select(
        "o_orderpriority",
        "n",
        *(F.round(c, 4).alias(c) for c in ("q1", "median", "q3")),
        *(F.round(c, 2).alias(c) for c in ("lower", "upper")),
    )


@register(
    "exact_quantiles",
    """SELECT l_returnflag, CAST(COUNT(*) AS BIGINT) AS n, round(quantile_cont(l_quantity, 0.1), 4) AS q10,
  round(quantile_cont(l_quantity, 0.9), 4) AS q90 FROM lineitem GROUP BY 1""",
)
def exact_quantiles(spark, folder):
    found = summaries.exact_quantiles(
        table(spark, folder, "lineitem"), "l_returnflag", "l_quantity", [0.1, 0.9]
    )
    return found.select(
        "l_returnflag",
        "n",
        F.round(F.get("quantiles", F.lit(0)), 4).alias("q10"),
        F.round(F.get("quantiles", F.lit(1)), 4).alias("q90"),
    )


@register(
    "class_shares",
    """WITH c AS (SELECT r_name, c_mktsegment, COUNT(*) AS n FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT r_name, c_mktsegment, CAST(n AS BIGINT) AS n, round(n / SUM(n) OVER (PARTITION BY r_name), 8) AS share,
  CAST(COUNT(*) OVER (PARTITION BY r_name) AS BIGINT) AS n_classes FROM c""",
)
def class_shares(spark, folder):
    places = (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    )
    customers = table(spark, folder, "customer").join(places, "c_nationkey")
    shares = summaries.class_shares(customers, "r_name", "c_mktsegment")
    return shares.withColumn("share", F.round("share", 8))


@register(
    "unordered_pairs",
    """WITH l AS (SELECT DISTINCT p_type AS t FROM part)
SELECT a.t AS var1, b.t AS var2 FROM l a JOIN l b ON a.t < b.t""",
)
def unordered_pairs_query(spark, folder):
    return unordered_pairs(table(spark, folder, "part"), "p_type")


# A ring with a notch, and a square that overlaps it.
RINGS = [
    ("notched", 1, -0.2, -0.2),
    ("notched", 2, 0.2, -0.2),
    ("notched", 3, 0.05, 0.0),
    ("notched", 4, 0.2, 0.2),
    ("notched", 5, -0.2, 0.2),
    ("square", 1, 0.0, 0.0),
    ("square", 2, 0.3, 0.0),
    ("square", 3, 0.3, 0.3),
    ("square", 4, 0.0, 0.3),
]


def _edges_sql() -> str:
    edges = []
    for name in ("notched", "square"):
        ring = [(x, y) for n, _, x, y in RINGS if n == name]
        for a, b in zip(ring, ring[1:] + ring[:1]):
            edges.append(f"('{name}', {a[0]}, {a[1]}, {b[0]}, {b[1]})")
    return f"""edges AS (SELECT poly_id, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1,
  CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2
  FROM (VALUES {', '.join(edges)}) v(poly_id, x1, y1, x2, y2))"""


@register(
    "points_in_region",
    f"""WITH {VECTORS}, {_edges_sql()}
SELECT vec_id, poly_id FROM vectors JOIN edges ON (y1 > x2_) <> (y2 > x2_)
  AND x1_ < x1 + (x2_ - y1) * (x2 - x1) / (y2 - y1)
GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1""".replace(
        "FROM vectors JOIN", "FROM (SELECT vec_id, x1 AS x1_, x2 AS x2_ FROM vectors) JOIN"
    ),
)
def points_in_region(spark, folder):
    vertices = spark.createDataFrame(RINGS, "poly_id string, seq int, px double, py double")
    edges = spatial.polygon_edges(
        vertices.withColumn("ring", F.lit(0)), "poly_id", "ring", "seq", "px", "py"
    )
    points = vectors(spark, folder).select("vec_id", F.col("x1").alias("px"), F.col("x2").alias("py"))
    return spatial.points_in_region(points, edges, "px", "py").select("vec_id", "poly_id")


@register(
    "convex_hull",
    """WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y
  FROM embeddings),
sides AS (SELECT a.label, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_
  FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
outer_sides AS (SELECT s.label, s.ax, s.ay, s.bx, s.by_ FROM sides s JOIN e p ON p.label = s.label
  GROUP BY ALL HAVING MIN((bx - ax) * (p.y - ay) - (by_ - ay) * (p.x - ax)) >= 0)
SELECT DISTINCT label, round(ax, 6) + 0.0 AS x, round(ay, 6) + 0.0 AS y FROM outer_sides""",
)
def convex_hull(spark, folder):
    hull = summaries.convex_hull(vectors(spark, folder), "label", "x1", "x2")
    return hull.select("label", F.round("x1", 6).alias("x"), F.round("x2", 6).alias("y"))


@register(
    "density_grid",
    f"""WITH {VECTORS},
f AS (SELECT label, COUNT(*) AS n, MIN(x1) AS lo, MAX(x1) AS hi,
  0.9 * least(STDDEV_SAMP(x1), (quantile_cont(x1, 0.75) - quantile_cont(x1, 0.25)) / 1.34) * pow(COUNT(*), -0.2) AS h
  FROM vectors GROUP BY 1),
g AS (SELECT f.*, CAST(UNNEST(range(0, 64)) AS INT) AS point FROM f),
p AS (SELECT v.label, (x1 - lo) / ((hi - lo) / 63) AS place FROM vectors v JOIN f ON v.label = f.label),
b AS (SELECT label, bin, SUM(w) AS w FROM (
    SELECT label, floor(place) AS bin, 1 - (place - floor(place)) AS w FROM p
    UNION ALL SELECT label, floor(place) + 1, place - floor(place) FROM p) WHERE w > 0 GROUP BY 1, 2)
SELECT g.label, point, round(lo + (hi - lo) / 63 * point, 6) + 0.0 AS x,
  round(SUM(w * exp(-0.5 * ((point - bin) * ((hi - lo) / 63) / h) ** 2)) / (MAX(n) * MAX(h) * sqrt(2 * pi())), 6) AS density
FROM g JOIN b ON b.label = g.label GROUP BY g.label, point, lo, hi""",
)
def density_grid(spark, folder):
    grid = summaries.density_grid(vectors(spark, folder), "label", "x1", points=64)
    return grid.withColumns({"x": F.round("x", 6), "density": F.round("density", 6)})
