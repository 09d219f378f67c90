"""Screens of raw records against the same screens of densified ones."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverspark.operators import clean, intervals, screens, series

LO, HI = dt.date(1991, 2, 10), dt.date(2003, 6, 20)


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(6)
    rows = []
    for s in range(14):
        first = dt.date(1988 + s % 5, 1 + s % 12, 3)
        for i in range(5200):
            if rng.random() < (0.02, 0.2, 0.45)[s % 3] or (s % 4 == 1 and 1500 < i < 1500 + 90 * s):
                continue
            rows.append((f"s{s}", first + dt.timedelta(days=i), None if i % 97 == s else float(i % 50)))
    rows += rows[100:110]  # days with two rows
    rows += [(None, dt.date(1995, 1, d), 1.0) for d in range(1, 9)]
    rows += [("void", dt.date(1995, 1, 1), None), ("late", dt.date(2010, 1, 1), 2.0), ("day", dt.date(1999, 5, 5), None)]
    return spark.createDataFrame(rows, "s string, d date, q double").repartition(5)


@pytest.fixture(scope="module")
def rules(spark):
    days = [("s1", dt.date(1993, 3, 17), True), ("s1", dt.date(1992, 1, 1), True), ("s2", dt.date(1994, 2, 28), False)]
    return spark.createDataFrame([*days, ("s3", dt.date(2020, 1, 1), True)], "s string, min_date date, inclusive boolean")


def listed(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("window", [(None, None), (LO, HI), (None, HI)])
@pytest.mark.parametrize("trimmed", [False, True])
def test_months_equal_those_of_the_calendar(raw, rules, window, trimmed):
    dense = clean.clip_period(series.densify_daily(raw, "s", "d", "q"), "d", *window)
    dense = clean.apply_trim_rules(dense, rules, "s", "d") if trimmed else dense
    first_days = clean.first_good_days(rules, "s") if trimmed else None
    parts = intervals.observed_months(raw, "s", "d", "q", *window, first_days)
    months = intervals.record_months(parts, "s", "q", 9, *window, first_days)
    rounded = lambda m: m.withColumn("q", F.round("q", 9))
    assert listed(rounded(months.drop("n"))) == listed(rounded(screens.monthly_mean(dense, "s", "d", "q", 9).select(*months.drop("n").columns)))
    assert listed(intervals.record_share(months, "s", 0.1)) == listed(screens.missing_share(dense, "s", "q", 0.1))


def test_ranges(raw):
    parts = intervals.observed_months(raw, "s", "d", "q", LO, HI)
    observed = raw.filter("q is not null")
    assert listed(intervals.record_ranges(parts, "s")) == listed(screens.series_range(observed, "s", "d"))


def test_selected_records_equal_selected_stations(raw, rules):
    limits = dict(max_share=0.4, max_missing_days=12, min_len=2, gap_before=dt.date(2000, 1, 1))
    got = screens.select_records(
        raw, "s", "d", "q", lo=LO, hi=HI, trim_rules=rules, start_before=dt.date(1992, 6, 1), end_after=dt.date(2002, 1, 1), **limits
    )
    masked = clean.keep_keys(raw, screens.eligible_by_range(raw.filter("q is not null"), "s", "d", dt.date(1992, 6, 1), dt.date(2002, 1, 1)), "s")
    dense = clean.clip_period(series.densify_daily(masked, "s", "d", "q"), "d", LO, HI)
    dense = clean.apply_trim_rules(dense, rules, "s", "d")
    expected = screens.select_stations(dense, "s", "d", "q", **limits)
    assert listed(got) == listed(expected)
    kept = {r.s for r in got.select("s").distinct().collect()}
    assert 2 <= len(kept) < 12


def test_no_rows(spark):
    empty = spark.createDataFrame([], "s string, d date, q double")
    parts = intervals.observed_months(empty, "s", "d", "q")
    assert intervals.record_months(parts, "s", "q").collect() == []
    assert screens.select_records(empty, "s", "d", "q").collect() == []
