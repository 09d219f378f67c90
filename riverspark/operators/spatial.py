"""Points in polygons, with polygons as edge tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverspark.columns import join_groups
from riverspark.session import cut_lineage


def polygon_edges(vertices: DataFrame, poly: str, ring: str, seq: str, x: str, y: str) -> DataFrame:
    """Edge table of closed rings from a vertex table.

    Vertices of one ring are linked in the order of ``seq``; the last one is linked
    to the first.
    """
    around = Window.partitionBy(poly, ring).orderBy(seq)
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return vertices.select(
        poly,
        F.col(x).alias("x1"),
        F.col(y).alias("y1"),
        F.coalesce(F.lead(x).over(around), F.first(x).over(whole)).alias("x2"),
        F.coalesce(F.lead(y).over(around), F.first(y).over(whole)).alias("y2"),
    )


#: A cell is cut into this many rows and columns at once.
_FAN = 8


def _crossings(edge, x: Column, y: Column, to_x: Column, to_y: Column) -> Column:
    """How often an edge crosses the way from a point to the right, up to ``to_x``, and from there up to ``to_y``."""
    dx, dy = edge["x2"] - edge["x1"], edge["y2"] - edge["y1"]
    across = (edge["y1"] > y) != (edge["y2"] > y)
    at_x = edge["x1"] + F.try_divide((y - edge["y1"]) * dx, dy)
    along = (edge["x1"] > to_x) != (edge["x2"] > to_x)
    at_y = edge["y1"] + F.try_divide((to_x - edge["x1"]) * dy, dx)
    right = F.when(across & (x < at_x) & (at_x <= to_x), 1).otherwise(0)
    return right + F.when(along & (y < at_y) & (at_y <= to_y), 1).otherwise(0)


def _touches(edge, low: tuple[Column, Column], high: tuple[Column, Column]) -> Column:
    """Whether an edge may meet a box: their extents overlap, and corners lie on both sides of the edge's line."""
    dx, dy = edge["x2"] - edge["x1"], edge["y2"] - edge["y1"]
    sides = [(cy - edge["y1"]) * dx - (cx - edge["x1"]) * dy for cx in (low[0], high[0]) for cy in (low[1], high[1])]
    slack = (F.abs(dx) + F.abs(dy)) * (high[0] - low[0] + high[1] - low[1]) * 1e-9
    return (
        (F.least(edge["x1"], edge["x2"]) <= high[0]) & (F.greatest(edge["x1"], edge["x2"]) >= low[0])
        & (F.least(edge["y1"], edge["y2"]) <= high[1]) & (F.greatest(edge["y1"], edge["y2"]) >= low[1])
        & (F.least(*sides) <= slack) & (F.greatest(*sides) >= -slack)
    )


@dataclass(frozen=True)
class Quadtree:
    """Cells ``poly, level, cx, cy, odd, edges``: all that meet a polygon's boundary or lie inside it.

    ``odd`` tells whether the upper right corner is inside the polygon, ``edges``
    are the polygon's edges in the cell, NULL where it has none there.
    """

    cells: DataFrame
    levels: tuple[int, ...]
    low: tuple[float, float]
    size: tuple[float, float]

    def place(self, level: int, x: Column, y: Column) -> Column:
        count = float(_FAN**level)
        cx, cy = (F.floor((c - lo) / size * count).cast("long") for c, lo, size in zip((x, y), self.low, self.size))
        return F.struct(F.lit(level).alias("level"), cx.alias("cx"), cy.alias("cy"))


def _corner(low, size, level, cx, cy):
    count = F.pow(F.lit(float(_FAN)), level)
    return F.lit(low[0]) + cx * F.lit(size[0]) / count, F.lit(low[1]) + cy * F.lit(size[1]) / count


def quadtree(edges: DataFrame, poly: str = "poly_id", capacity: int = 64, deepest: int = 8) -> Quadtree:
    """Cut the box around all polygons until no cell holds more than ``capacity`` edges, ``deepest`` times at most.

    Each step cuts crowded cells into 8 by 8.  A corner of a new cell is inside a
    polygon if the corner of the old cell is, unless the way between both crosses
    the boundary an odd number of times; that way stays in the old cell, so its own
    edges decide.  New cells without edges are inside as a whole or left out.
    """
    ends = F.array(*(F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2)))
    extent = edges.select(F.inline(ends)).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if extent[0] is None:
        none = edges.select(poly).withColumns({c: F.lit(0).cast("long") for c in ("level", "cx", "cy")})
        entry = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
        none = none.withColumns({"odd": F.lit(False), "edges": F.lit(None).cast(entry)}).filter("false")
        return Quadtree(none, (), (0.0, 0.0), (1.0, 1.0))
    spans = [float(hi - lo) or 1.0 for lo, hi in ((extent[0], extent[1]), (extent[2], extent[3]))]
    # A margin that is no round part of the box keeps vertices off the cells' borders.
    low = (extent[0] - 0.01703 * spans[0], extent[2] - 0.01409 * spans[1])
    size = (1.0371 * spans[0], 1.0317 * spans[1])
    key = ["level", "cx", "cy"]
    edge = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    open_ = edges.select(poly, *(F.col(c).cast("double").alias(c) for c in edge)).dropna()
    open_ = open_.withColumns({c: F.lit(0).cast("long") for c in key}).withColumn("odd", F.lit(False))
    found, levels = [], []
    for level in range(1, deepest + 1):
        at = F.lit(level)
        whole = _corner(low, size, F.col("level"), F.col("cx") + 1, F.col("cy") + 1)
        split = open_.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(_FAN * _FAN - 1))))
        split = split.withColumns(
            {"_cx": F.col("cx") * _FAN + F.col("_part") % _FAN, "_cy": F.col("cy") * _FAN + F.floor(F.col("_part") / _FAN)}
        )
        box = _corner(low, size, at, F.col("_cx"), F.col("_cy")), _corner(low, size, at, F.col("_cx") + 1, F.col("_cy") + 1)
        split = split.withColumns({"_way": _crossings(edge, *box[1], *whole), "_in": _touches(edge, *box)})
        split = split.select(
            poly, *edge, "odd", "_way", "_in", at.cast("long").alias("level"), F.col("_cx").alias("cx"), F.col("_cy").alias("cy")
        )
        odd = F.first("odd") != (F.sum("_way") % 2 == 1)
        cells = split.groupBy(poly, *key).agg(odd.alias("odd"), F.count_if("_in").alias("_n"))
        cells = cut_lineage(cells.filter(F.col("odd") | (F.col("_n") > 0)))
        crowd = cells.groupBy(*key).agg(F.sum("_n").alias("_all"))
        cells = cells.join(crowd, key)
        more = F.lit(level < deepest) & (F.col("_all") > capacity)
        inside = cells.filter(F.col("_n") == 0).select(poly, *key, "odd", F.lit(None).alias("edges"))
        held = split.filter("_in").drop("odd", "_way", "_in")
        held = join_groups(held, cells.filter(F.col("_n") > 0).select(poly, *key, "odd", more.alias("_more")), [poly, *key])
        listed = F.collect_list(F.struct(*edge)).alias("edges")
        leaves = held.filter(~F.col("_more")).groupBy(poly, *key, "odd").agg(listed)
        found += [inside, leaves]
        levels.append(level)
        if crowd.filter(more).isEmpty():
            break
        open_ = cut_lineage(held.filter("_more").drop("_more"))
    tree = found[1]
    for part in found[:1] + found[2:]:
        tree = tree.unionByName(part)
    return Quadtree(cut_lineage(tree), tuple(levels), low, size)


def points_in_region(
    points: DataFrame, edges: DataFrame, x: str, y: str, poly: str = "poly_id", capacity: int = 64
) -> DataFrame:
    """The points inside each polygon, with the polygon's id added.

    A point meets the polygons of the cells of a ``quadtree`` it lies in.  Cells
    inside a polygon need no test; elsewhere a point is inside if the way to the
    corner of its leaf crosses the polygon's edges there an odd number of times,
    the corner counted in.  A leaf holds ``capacity`` edges or fewer, unless more
    meet in one spot.  Points without a coordinate are in no polygon.
    """
    tree = quadtree(edges, poly, capacity)
    if not tree.levels:
        return points.join(tree.cells.select(poly), F.lit(False))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    places = F.array(*(tree.place(level, px, py) for level in tree.levels))
    held = px.between(tree.low[0], tree.low[0] + tree.size[0]) & py.between(tree.low[1], tree.low[1] + tree.size[1])
    located = points.filter(held).select("*", F.explode(places).alias("_cell"))
    same = F.col("_cell") == F.struct(F.col("_t.level").cast("int").alias("level"), "_t.cx", "_t.cy")
    met = located.join(tree.cells.alias("_t"), same)
    corner = _corner(tree.low, tree.size, F.col("_cell.level"), F.col("_cell.cx") + 1, F.col("_cell.cy") + 1)
    crossed = F.aggregate("_t.edges", F.lit(0), lambda n, e: n + _crossings(e, px, py, *corner))
    inside = F.col("_t.odd") != (F.coalesce(crossed, F.lit(0)) % 2 == 1)
    return met.filter(inside).select(*(points[c] for c in points.columns), F.col(f"_t.{poly}").alias(poly))
