import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riverspark.operators.events import independent_events
from riverspark.operators.series import densify_daily, fill_linear, runs_of_days

DAY0 = dt.date(2003, 11, 20)


def series(spark, values, station="a", start=DAY0):
    rows = [(station, start + dt.timedelta(days=i), v) for i, v in values]
    return spark.createDataFrame(rows, "station string, date date, q double")


def test_densify_trims_ends_and_keeps_inner_gaps(spark):
    values = [(0, None), (1, 5.0), (2, None), (3, 6.0), (60, 7.0), (61, None)]
    out = densify_daily(series(spark, values), "station", "date", "q").orderBy("date").collect()
    assert out[0].date == DAY0 + dt.timedelta(days=1) and out[-1].date == DAY0 + dt.timedelta(days=60)
    assert len(out) == 60
    assert [r.q for r in out[:3]] == [5.0, None, 6.0]
    assert sum(r.q is None for r in out) == 57


def test_densify_of_one_day_and_of_nothing(spark):
    assert densify_daily(series(spark, [(0, 1.0)]), "station", "date", "q").count() == 1
    assert densify_daily(series(spark, [(0, None)]), "station", "date", "q").isEmpty()


def test_filled_gaps_follow_numpy_across_years(spark):
    rng = np.random.default_rng(1)
    days = np.sort(rng.choice(3000, 160, replace=False))
    values = rng.normal(size=160)
    df = series(spark, list(zip(days.tolist(), values.tolist())))
    out = fill_linear(df, "station", "date", "q").orderBy("date").toPandas()
    grid = np.arange(days[0], days[-1] + 1)
    np.testing.assert_allclose(out.q, np.interp(grid, days, values), atol=1e-12)
    assert out.observed.sum() == 160
    assert out.date.is_monotonic_increasing and out.date.is_unique


def brute_runs(frame):
    """Runs of positive values on consecutive days, one station at a time."""
    found = []
    for station, part in frame.sort_values("date").groupby("station"):
        run = []
        for date, q in zip(part.date, part.q):
            if run and (date - run[-1][0]).days > 1:
                found.append((station, run))
                run = []
            if q is not None and not np.isnan(q) and q > 0:
                run.append((date, q))
            elif run:
                found.append((station, run))
                run = []
        if run:
            found.append((station, run))
    result = set()
    for station, run in found:
        top = max(q for _, q in run)
        first = min(d for d, q in run if q == top)
        result.add((station, run[0][0], run[-1][0], len(run), top, first))
    return result


def test_runs_equal_brute_force_across_year_ends(spark):
    rng = np.random.default_rng(2)
    rows = []
    for station in "abc":
        for i in range(2500):
            if rng.random() < 0.02:
                continue
            q = None if rng.random() < 0.02 else float(np.round(rng.normal(1.2), 1))
            rows.append((station, DAY0 + dt.timedelta(days=i), q))
    rows += [("long", dt.date(2000, 6, 1) + dt.timedelta(days=i), 1.0) for i in range(1500)]
    df = spark.createDataFrame(rows, "station string, date date, q double")
    out = independent_events(df, "station", "date", "q").collect()
    got = {(r.station, r.start, r.end, r.duration, r.extreme, r.extreme_date) for r in out}
    assert got == brute_runs(pd.DataFrame(rows, columns=["station", "date", "q"]))
    assert len(out) == len(got)
    assert any(r.duration == 1500 for r in out)
    assert all(r.year == r.extreme_date.year for r in out)


def test_cutoff_is_exclusive_and_direction_turns(spark):
    signs = [1, 1, -1, 1, 0, -1, 1, 1, 1]
    df = series(spark, list(enumerate(map(float, signs))))
    above = independent_events(df, "station", "date", "q").orderBy("start").collect()
    assert [r.duration for r in above] == [2, 1, 3]
    below = independent_events(df, "station", "date", "q", above=False).orderBy("start").collect()
    assert [(r.duration, r.extreme) for r in below] == [(1, -1.0), (1, -1.0)]


def test_a_station_with_a_third_of_the_rows_is_split_by_year(spark):
    hot = [("hot", dt.date(1950, 1, 1) + dt.timedelta(days=i), 1.0 + i % 7) for i in range(20000)]
    rest = [
        (f"s{k}", dt.date(2000, 1, 1) + dt.timedelta(days=3 * i), float(i % 5))
        for k in range(40)
        for i in range(300)
    ]
    df = spark.createDataFrame(hot + rest, "station string, date date, q double")
    out = densify_daily(df, "station", "date", "q")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Only the per-year summary is windowed by station alone.
    assert plan.count("Window [lead(date") == 1
    sizes = out.groupBy("station").count().collect()
    assert {r.station: r["count"] for r in sizes}["hot"] == 20000
    assert out.filter(F.col("station") != "hot").count() == 40 * (299 * 3 + 1)


def test_repeated_day_adds_no_days_and_keeps_both_rows(spark):
    rows = [("a", dt.date(2001, 1, 3), 1.0), ("a", dt.date(2001, 1, 5), 2.0), ("a", dt.date(2001, 1, 5), 3.0),
            ("a", dt.date(2001, 1, 7), 4.0), (None, dt.date(2001, 1, 1), 9.0)]
    df = spark.createDataFrame(rows, "k string, date date, v double")
    dense = [(r.k, r.date.day, r.v) for r in densify_daily(df, "k", "date", "v").collect()]
    assert sorted(dense, key=str) == sorted(
        [("a", 3, 1.0), ("a", 4, None), ("a", 5, 2.0), ("a", 5, 3.0), ("a", 6, None), ("a", 7, 4.0), (None, 1, 9.0)], key=str
    )
    runs = runs_of_days(df.filter("k = 'a' AND date >= DATE '2001-01-05'"), "k", "date", "v").collect()
    assert sorted((r.start.day, r.duration, r.extreme) for r in runs) == [(5, 1, 3.0), (7, 1, 4.0)]
