import numpy as np
import pytest
from pyspark.sql import functions as F

from riverspark.operators import spatial, summaries


def test_quantiles_equal_numpy_with_ties_and_a_hot_group(spark):
    rng = np.random.default_rng(11)
    data = {
        "hot": np.round(rng.normal(size=6000), 2),
        "same": np.full(500, 3.0),
        "one": np.array([7.0]),
        "two": np.array([1.0, 2.0]),
        "skewed": np.concatenate([np.zeros(900), rng.exponential(size=300)]),
    }
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    for r in summaries.exact_quantiles(df, "g", "v", probs, accuracy=50).collect():
        assert r.n == len(data[r.g])
        assert r.quantiles == pytest.approx(np.quantile(data[r.g], probs))


@pytest.mark.parametrize("few", [0, 10_000])
def test_rows_of_few_groups_are_not_sorted_for_a_join(spark, monkeypatch, few):
    monkeypatch.setattr(summaries, "_FEW_GROUPS", few)
    rows = [(None if i % 3 == 0 else "g", float(i % 40)) for i in range(600)]
    found = summaries.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", [0.1, 0.5], accuracy=20)
    joined = found._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in joined) == (few == 0)
    for r in found.collect():
        own = [v for g, v in rows if g == r.g]
        assert r.n == len(own) and r.quantiles == pytest.approx(np.quantile(own, [0.1, 0.5]))


def test_box_hides_outliers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    r = summaries.box_summary(df, "g", "v").first()
    assert (r.q1, r.median, r.q3, r.lower, r.upper) == (2.25, 3.5, 4.75, 1.0, 5.0)


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")], "g string, c string")
    got = {(r.g, r.c): (r.share, r.n_classes) for r in summaries.class_shares(df, "g", "c").collect()}
    assert got == {("a", "x"): (2 / 3, 2), ("a", "y"): (1 / 3, 2), ("b", "x"): (1.0, 1)}


def test_density_integrates_to_most_of_one(spark):
    rng = np.random.default_rng(12)
    v = rng.normal(size=400)
    df = spark.createDataFrame([("a", float(x)) for x in v], "g string, v double")
    out = summaries.density_grid(df, "g", "v", points=100).orderBy("point").toPandas()
    h = 0.9 * min(v.std(ddof=1), np.subtract(*np.quantile(v, [0.75, 0.25])) / 1.34) * 400**-0.2
    grid = np.linspace(v.min(), v.max(), 100)
    place = (v - v.min()) / (grid[1] - grid[0])
    low = np.floor(place).astype(int)
    weight = np.bincount(low, 1 - (place - low), 101) + np.bincount(low + 1, place - low, 101)
    kernel = np.exp(-0.5 * ((grid[:, None] - grid) / h) ** 2)
    np.testing.assert_allclose(out.density, kernel @ weight[:100] / (400 * h * np.sqrt(2 * np.pi)), rtol=1e-9)
    exact = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).mean(1) / (h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(out.density, exact, atol=0.01 * exact.max())
    assert summaries.density_grid(df, "g", "v", 10, bandwidth=0.5).count() == 10


def inside_hull(hull, p):
    a, b = hull, np.roll(hull, -1, axis=0)
    cross = (b - a)[:, 0] * (p - a)[:, 1] - (b - a)[:, 1] * (p - a)[:, 0]
    return (cross >= -1e-12).all()


def test_hull_of_partial_hulls_holds_all_points(spark):
    rng = np.random.default_rng(13)
    points = rng.normal(size=(3000, 2))
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.5, 0.5), (0.5, 0.0), (0.0, 0.0)]
    rows = [("cloud", float(x), float(y)) for x, y in points] + [("square", *p) for p in square]
    rows += [("pair", 0.0, 0.0), ("pair", 1.0, 1.0), ("pair", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(7)
    out = summaries.convex_hull(df, "g", "x", "y").orderBy("g", "seq").toPandas()
    cloud = out[out.g == "cloud"][["x", "y"]].to_numpy()
    assert all(inside_hull(cloud, p) for p in points)
    assert {tuple(p) for p in cloud} <= {tuple(p) for p in points}
    assert out[out.g == "square"][["x", "y"]].to_numpy().tolist() == [[0, 0], [1, 0], [1, 1], [0, 1]]
    assert (out.g == "pair").sum() == 2


@pytest.mark.parametrize("capacity", [2, 5, 64])
def test_points_in_ring_with_hole_and_vertex_levels(spark, capacity):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    vertices = [("a", 0, i, *p) for i, p in enumerate(ring)] + [("a", 1, i, *p) for i, p in enumerate(hole)]
    v = spark.createDataFrame(vertices, "poly_id string, ring int, seq int, x double, y double")
    edges = spatial.polygon_edges(v, "poly_id", "ring", "seq", "x", "y")
    assert edges.count() == 8
    rows = [
        (1, 0.5, 0.5), (2, 2.0, 2.0), (3, 5.0, 2.0), (4, -1.0, 1.0), (5, 0.5, 1.0),
        (6, 3.5, 3.0), (7, 2.0, 9.0), (8, None, 1.0), (9, -1.0, 4.0), (10, 2.0, 3.5),
    ]
    points = spark.createDataFrame(rows, "id int, x double, y double")
    got = spatial.points_in_region(points, edges, "x", "y", capacity=capacity)
    assert sorted(r.id for r in got.collect()) == [1, 5, 6, 10]


def rays(points, edges):
    """Polygons whose edges a ray to the right crosses an odd number of times, by point."""
    found = set()
    for i, px, py in points:
        count = {}
        for poly, x1, y1, x2, y2 in edges:
            if (y1 > py) != (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
                count[poly] = count.get(poly, 0) + 1
        found |= {(i, poly) for poly, n in count.items() if n % 2}
    return found


@pytest.mark.parametrize("capacity", [8, 40])
def test_points_in_many_polygons(spark, capacity):
    rng = np.random.default_rng(3)
    vertices = []
    for poly in range(14):
        angles = np.sort(rng.uniform(0, 2 * np.pi, 60 if poly else 400))
        reach = rng.uniform(0.2, 1.0, len(angles)) * (3.0 if poly % 3 == 0 else 0.4)
        cx, cy = rng.uniform(-2, 2, 2)
        for i, (a, r) in enumerate(zip(angles, reach)):
            vertices.append((f"p{poly}", 0, i, float(cx + r * np.cos(a)), float(cy + r * np.sin(a))))
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    vertices += [("grid", 3 * i + j, k, x + i - 1, y + j - 1) for i in range(3) for j in range(3) for k, (x, y) in enumerate(square)]
    v = spark.createDataFrame(vertices, "poly string, ring int, seq int, x double, y double")
    edges = spatial.polygon_edges(v, "poly", "ring", "seq", "x", "y")
    points = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(-4, 4, (400, 2)))]
    points += [(500 + i, 0.25 * (i % 17) - 2, 0.5 * (i // 17) - 2) for i in range(100)]
    table = spark.createDataFrame([(*p, "l", 1) for p in points], "id int, x double, y double, level string, cx int")
    got = spatial.points_in_region(table, edges, "x", "y", "poly", capacity)
    expected = rays(points, [tuple(r) for r in edges.select("poly", "x1", "y1", "x2", "y2").collect()])
    assert got.columns == ["id", "x", "y", "level", "cx", "poly"]
    assert sorted((r.id, r.poly) for r in got.collect()) == sorted(expected) and len(expected) > 300
    tree = spatial.quadtree(edges, "poly", capacity)
    most = tree.cells.groupBy("level", "cx", "cy").agg(F.sum(F.size("edges")).alias("n")).agg(F.max("n")).first()[0]
    assert most <= capacity and len(tree.levels) > 1


def test_no_polygons(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5)], "id int, x double, y double")
    edges = spark.createDataFrame([], "poly_id string, x1 double, y1 double, x2 double, y2 double")
    assert spatial.points_in_region(points, edges, "x", "y").collect() == []
