import datetime as dt

from pyspark.sql import functions as F

from riverspark.operators import screens


def test_year_islands_bridge_small_steps(spark):
    years = [2001, 2002, 2004, 2008, 2013, 2014]
    df = spark.createDataFrame([("a", 1, y) for y in years], "s string, month int, year int")
    got = screens.gap_islands(df, ["s", "month"], "year", 4, None).orderBy("gap_start").collect()
    assert [(r.n, r.gap_start, r.gap_end) for r in got] == [(4, 2001, 2008), (2, 2013, 2014)]
    assert screens.gap_islands(df, ["s", "month"], "year", 4, 4).isEmpty()
    assert screens.gap_islands(df, ["s", "month"], "year", 4, 3).count() == 1


def test_day_islands_bridge_one_good_month(spark):
    months = [(2000, 1), (2000, 3), (2000, 4), (2000, 8)]
    df = spark.createDataFrame([("a", dt.date(y, m, 15)) for y, m in months], "s string, date date")
    got = screens.gap_islands(df, "s", "date", 70, None).orderBy("gap_start").collect()
    assert [r.n for r in got] == [3, 1]


def test_monthly_mean_tolerates_few_missing_days(spark):
    rows = []
    for month, missing in ((1, 10), (2, 11), (3, 31)):
        for d in range(1, 29):
            rows.append(("a", dt.date(2001, month, d), None if d <= missing else 2.0))
    df = spark.createDataFrame(rows, "s string, date date, q double")
    got = {r.month: (r.q, r.n_missing) for r in screens.monthly_mean(df, "s", "date", "q").collect()}
    assert got == {1: (2.0, 10), 2: (None, 11), 3: (None, 28)}


def test_shares_count_null_rows_and_compare_strictly(spark):
    df = spark.createDataFrame(
        [("a", None)] * 3 + [("a", 1.0)] * 7 + [("b", None), ("b", 1.0)], "s string, q double"
    )
    assert [r.s for r in screens.missing_share(df, "s", "q", 0.3).collect()] == ["b"]
    assert screens.missing_share(df, "s", "q", None).count() == 2


def test_ranges_and_eligibility_are_strict(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2000, 1, 1)), ("a", dt.date(2010, 1, 1)), ("b", dt.date(2005, 1, 1))],
        "s string, date date",
    )
    ok = screens.eligible_by_range(df, "s", "date", dt.date(2000, 1, 2), dt.date(2009, 12, 31))
    assert [r.s for r in ok.collect()] == ["a"]
    assert screens.eligible_by_range(df, "s", "date", dt.date(2000, 1, 1), dt.date(2009, 1, 1)).isEmpty()
    row = screens.range_extremes(screens.series_range(df, "s", "date")).first()
    assert (row.latest_start, row.earliest_end) == (dt.date(2005, 1, 1), dt.date(2005, 1, 1))


def test_station_choice_unites_all_screens(spark):
    start = dt.date(2000, 1, 1)
    rows = []
    for i in range(6 * 365):
        day = start + dt.timedelta(days=i)
        gap = dt.date(2001, 2, 1) <= day <= dt.date(2001, 8, 31)
        rows += [("good", day, 1.0), ("sparse", day, None if i % 2 else 1.0)]
        rows += [("gap", day, None if gap else 1.0), ("pardoned", day, None if gap else 1.0)]
        rows += [("no_june", day, None if day.month == 6 else 1.0), ("listed", day, 1.0)]
    df = spark.createDataFrame(rows, "s string, date date, q double")
    listed = spark.createDataFrame([("listed",)], "s string")
    pardon = spark.createDataFrame([("pardoned",)], "s string")
    kept = screens.select_stations(df, "s", "date", "q", pardon_gaps=pardon, reject=[listed])
    assert {r.s for r in kept.select("s").distinct().collect()} == {"good", "pardoned"}
    late = screens.select_stations(df, "s", "date", "q", gap_before=dt.date(2001, 1, 1))
    assert "gap" in {r.s for r in late.select("s").distinct().collect()}
    assert kept.filter(F.col("s") == "good").count() == 6 * 365
