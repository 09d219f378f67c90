"""Running values over ranges against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from riverspark.operators.scan import in_ranges, running
from riverspark.stats.holm import holm


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    return [(draw.choice(["a", "a", "a", "b", None]), draw.randrange(400), i, draw.uniform(-5, 5)) for i in range(3000)]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running(spark, rows, keys):
    table = spark.createDataFrame(rows, "k string, at int, id int, x double")
    ranged = in_ranges(table, keys, ["at"], ranges=7)
    assert ranged.select("_range").distinct().count() > 1
    got = running(ranged, keys, ["at"], "total", F.lit(1))
    got = {r.id: r for r in running(got, keys, ["at"], "top", F.col("x"), "max").collect()}
    assert len(got) == 3000
    for k, at, i, _ in rows[::37]:
        mine = [r for r in rows if r[1] <= at and (not keys or r[0] == k)]
        assert got[i].total == len(mine) and got[i].top == max(r[3] for r in mine)


def test_running_of_no_rows(spark):
    table = spark.createDataFrame([], "k string, at int")
    assert running(in_ranges(table, ["k"], ["at"]), ["k"], ["at"], "n", F.lit(1)).collect() == []


def test_holm_with_many_ties(spark, monkeypatch):
    monkeypatch.setattr("riverspark.stats.holm.in_ranges", lambda *a: in_ranges(*a, ranges=5))
    draw = random.Random(2)
    rows = [(draw.choice(["f", "g", None]), i, draw.choice([None, 0.001, 0.001, round(draw.random() ** 4, 3)])) for i in range(800)]
    got = holm(spark.createDataFrame(rows, "family string, i int, p double"), "p", "family")
    assert got.columns == ["family", "i", "p", "p_adjusted"]
    found = {r.i: r.p_adjusted for r in got.collect()}
    for name in ("f", "g", None):
        own = sorted((p, i) for f, i, p in rows if f == name and p is not None)
        top = 0.0
        for k, (p, i) in enumerate(own):
            top = max(top, (len(own) - k) * p)
            assert found[i] == pytest.approx(min(1.0, top), abs=1e-12)
    assert all(found[i] is None for _, i, p in rows if p is None) and len(found) == 800
    assert holm(spark.createDataFrame([], "p double"), "p").collect() == []
