import datetime as dt

import pytest
from pyspark.sql import functions as F

from riverspark import functions as fn
from riverspark.operators import catchment, climate


def test_precipitation_repairs(spark):
    df = spark.createDataFrame(
        [(-1.0, 2.0), (0.0, None), (3.0, 5.0), (3.0, -1.0), (3.0, 1.0), (None, 1.0), (3.0, None)],
        "ppt double, snowfall double",
    )
    got = [tuple(r) for r in climate.partition_precip(df).collect()]
    assert got == [
        (0.0, 0.0, 0.0),
        (0.0, 0.0, 0.0),
        (3.0, 3.0, 0.0),
        (3.0, 0.0, 3.0),
        (3.0, 1.0, 2.0),
        (None, None, None),
        (3.0, None, None),
    ]


def test_rollup_counts_all_rows_and_keeps_nulls(spark):
    rows = [("a", "temp", 1.0), ("a", "temp", 3.0), ("a", "rain", 1.0), ("a", "rain", None), ("b", "rain", 2.0)]
    df = spark.createDataFrame(rows, "s string, variable string, value double")
    got = {(r.s, r.variable): r.value for r in climate.rollup_climate(df, ["s"], "variable", "value", ["temp"]).collect()}
    assert got == {("a", "temp"): 2.0, ("a", "rain"): None, ("b", "rain"): 2.0}
    assert climate.rollup_climate(df, ["s"], "variable", "value", ["temp"], exact_obs=2).count() == 2
    assert climate.rollup_climate(df, ["s"], "variable", "value", ["temp"], min_obs=2).isEmpty()


def test_daily_mean_propagates_or_skips_missing(spark):
    df = spark.createDataFrame(
        [("a", dt.datetime(2000, 1, 1, 1), 1.0), ("a", dt.datetime(2000, 1, 1, 2), None)],
        "s string, ts timestamp, v double",
    )
    assert climate.daily_mean(df, "ts", "s", "v").first().v is None
    assert climate.daily_mean(df, "ts", "s", "v", na="skip").first().v == 1.0


def test_local_time_crosses_midnight_without_daylight_saving(spark):
    df = spark.createDataFrame([(dt.date(2000, 7, 1), 3, "YT")], "d date, h int, region string")
    row = climate.to_local_time(
        df.withColumn("utc", fn.utc_timestamp("d", "h")).withColumn("off", fn.utc_minus("region")),
        "utc",
        "off",
    ).first()
    assert (row.date, row.hour, row.month) == (dt.date(2000, 6, 30), 19, 6)


def test_season_bounds_index_and_timing(spark):
    ranges = spark.createDataFrame(
        [("a", dt.date(2000, 6, 1), dt.date(2003, 10, 29))], "s string, start date, end date"
    )
    bounds = climate.full_season_years(ranges, 152, 304)
    row = bounds.first()
    # 1 June is day 153 in a leap year; 29 October is day 302.
    assert (row.first_year, row.last_year) == (2001, 2002)
    days = [
        ("a", y, j, 4.0 if j == 200 else 0.0) for y in (2000, 2001, 2002, 2003) for j in range(152, 305)
    ]
    df = spark.createDataFrame(days, "s string, year int, jday int, v double")
    one_year = (1 - 1 / 153) + 152 / 153
    index = climate.seasonality_index(df, "s", "v", bounds)
    assert index.first().si == pytest.approx(2 * one_year)
    assert climate.seasonality_index(df, "s", "v", bounds, agg="mean").first().si == pytest.approx(one_year)
    melt = df.withColumn("jday", F.col("jday") - 100)
    assert climate.melt_timing(melt, "s", "v", bounds).first().melt_t == pytest.approx(100.0)


def test_dry_season_gives_no_index(spark):
    df = spark.createDataFrame([("a", 2001, 200, 0.0)], "s string, year int, jday int, v double")
    bounds = spark.createDataFrame([("a", 2001, 2001)], "s string, first_year int, last_year int")
    assert climate.seasonality_index(df, "s", "v", bounds).first().si is None


def test_climatology_uses_complete_years_in_range(spark):
    months = [("a", dt.date(y, m, 15), 1.0 * y, 2.0) for y in (2000, 2001, 2002) for m in range(1, 13)]
    df = spark.createDataFrame(months, "s string, date date, ppt double, temp double")
    ranges = spark.createDataFrame(
        [("a", dt.date(2000, 2, 1), dt.date(2002, 12, 31))], "s string, start date, end date"
    )
    row = climate.period_climatology(df, ranges, "s", {"ppt": 10.0}, ["temp"]).first()
    assert (row.n_years, row.ppt, row.temp) == (2, (2001 + 2002) / 2 * 120, 2.0)


def test_zonal_mean_weights_cells(spark):
    cells = spark.createDataFrame([(1, 0, 10.0), (2, 0, 20.0)], "cell int, hour int, v double")
    weights = spark.createDataFrame([(1, "z", 3.0), (2, "z", 1.0), (2, "y", 0.5)], "cell int, zone string, w double")
    got = {r.zone: r.v for r in climate.zonal_mean(cells, weights, "cell", "zone", "v", "w", ["hour"]).collect()}
    assert got == {"z": 12.5, "y": 20.0}
    holed = cells.union(cells.sparkSession.createDataFrame([(3, 0, None)], cells.schema))
    more = weights.union(weights.sparkSession.createDataFrame([(3, "z", 1.0)], weights.schema))
    for na, z in (("propagate", None), ("skip", 12.5)):
        rows = climate.zonal_mean(holed, more, "cell", "zone", "v", "w", ["hour"], na=na).collect()
        assert {r.zone: r.v for r in rows} == {"z": z, "y": 20.0}


def test_classes_compete_before_or_after_merging(spark):
    rows = [("a", "I", 30.0), ("a", "S", 30.0), ("a", "C", 40.0), ("b", "C", 50.0), ("b", "D", 50.0), ("c", "D", 30.0)]
    df = spark.createDataFrame(rows, "s string, class string, share double")
    merge = {"I": "S"}
    late = {(r.s, r["class"]) for r in catchment.dominant_class(df, "s", "share", "class", merge=merge).collect()}
    assert late == {("a", "C"), ("b", "C"), ("b", "D"), ("c", "D")}
    early = catchment.dominant_class(df, "s", "share", "class", False, merge, merge_first=True)
    assert {(r.s, r["class"]) for r in early.collect()} == {("a", "S"), ("b", "C"), ("c", "D")}
    full = catchment.fill_remainder(df, "s", "class", "share", "Unfrozen", "area")
    extra = full.filter("class = 'Unfrozen'").collect()
    assert [(r.s, r.share, r.area) for r in extra] == [("c", 70.0, 0.0)]
    dust = df.sparkSession.createDataFrame([("d", c, v) for c, v in zip("IJK", (33.3, 33.3, 33.4))], df.schema)
    assert catchment.fill_remainder(dust, "s", "class", "share", "Unfrozen").count() == 3


def test_catchment_table_defaults_and_classes(spark):
    a = spark.createDataFrame([("x", 5.0), ("y", 0.5)], "s string, ice double")
    b = spark.createDataFrame([("x", "C"), ("z", "D")], "s string, class string")
    got = catchment.catchment_table(
        [a, b], "s", {"ice": 0.0}, "class", {"glacial": ("ice", 1.0, "non-glacial", "glacial")}
    )
    assert {(r.s, r.ice, r.glacial) for r in got.collect()} == {("x", 5.0, "glacial"), ("z", 0.0, "non-glacial")}


def test_scalar_functions(spark):
    one = spark.createDataFrame([("TUNDRA plain", "clim-snowmelt-1999.nc.csv", "9.4e.08", 5)], "a string, f string, e string, h int")
    row = one.select(
        fn.sentence_case("a").alias("a"),
        fn.variable_from_source("f").alias("f"),
        fn.repair_exponent("e").cast("double").alias("e"),
        fn.pad_hour("h").alias("h"),
        fn.jday_to_date(F.lit(2000), F.lit(60)).alias("d"),
        fn.split_composite(F.lit("SI.20"), 3).alias("p3"),
        fn.split_composite(F.lit("snowmelt.t.20"), 3).alias("q3"),
        fn.convert(F.lit(300.0), 1.0, fn.KELVIN_OFFSET).alias("c"),
        fn.convert(F.lit(100.0), fn.CFS_TO_M3S).alias("m"),
        fn.percent_change(F.lit(3.0), F.lit(0.0)).alias("z"),
        fn.epoch_to_timestamp(F.lit(86400.0)).cast("date").alias("t"),
        fn.glue_label(F.lit("x"), F.lit(None), F.lit(3)).alias("g"),
        fn.threshold_class(F.lit(1.0), 1.0, "low", "high").alias("k"),
    ).first()
    assert (row.a, row.f, row.e, row.h) == ("Tundra plain", "snowmelt", 9.4e8, "05")
    assert row.d == dt.date(2000, 2, 29) and (row.p3, row.q3) == (None, "20")
    assert row.c == pytest.approx(26.85) and row.m == pytest.approx(2.8316846592)
    assert row.z is None and row.t == dt.date(1970, 1, 2) and (row.g, row.k) == ("x-3", "high")
