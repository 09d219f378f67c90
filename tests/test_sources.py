import datetime as dt

import pytest
from pyspark.sql import types as T

from riverspark.sources import (
    append,
    daily_values,
    read_csv_skip,
    read_many,
    read_table,
    stack_tables,
    write_bucketed,
    write_table,
)

SCHEMA = T.StructType(
    [
        T.StructField("station", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def test_csv_with_byte_order_mark_keeps_text_ids(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿station,date,value\n0159,2001-02-03,1.5\n03NE002,,\n".encode())
    rows = read_table(spark, str(path), SCHEMA).collect()
    assert [tuple(r) for r in rows] == [
        ("0159", dt.date(2001, 2, 3), 1.5),
        ("03NE002", None, None),
    ]
    with pytest.raises(ValueError):
        read_table(spark, str(path))


def test_skips_preamble_of_each_file(spark, tmp_path):
    for name in "ab":
        lines = ["made by a logger", "x,y,z"] + ["station,date,value"]
        lines += [f"{name},2001-01-{d:02d},{d}.0" for d in range(1, 29)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    rows = read_csv_skip(spark, str(tmp_path), 2, SCHEMA)
    assert rows.count() == 56
    assert rows.filter("date IS NULL OR value IS NULL").isEmpty()
    assert {r.station for r in rows.select("station").distinct().collect()} == {"a", "b"}


def test_preamble_skip_survives_split_files(spark, tmp_path):
    body = [f"s,2001-01-01,{i}.0" for i in range(4000)]
    (tmp_path / "big.csv").write_text("\n".join(["head", "station,date,value"] + body) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = read_csv_skip(spark, str(tmp_path), 1, SCHEMA)
        assert rows.rdd.getNumPartitions() > 1
        assert rows.agg({"value": "sum"}).first()[0] == sum(range(4000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_glob_keeps_the_file_name(spark, tmp_path):
    for v in ("temp", "rain"):
        (tmp_path / f"clim-{v}-2001.csv").write_text("station,date,value\na,2001-01-01,1\n")
    rows = read_many(spark, f"{tmp_path}/clim-*.csv", SCHEMA).collect()
    assert {r.source for r in rows} == {"clim-temp-2001.csv", "clim-rain-2001.csv"}


def test_written_partitions_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, "old"), ("b", 2.0, "new")], "s string, v double, period string")
    write_table(df, f"{tmp_path}/out", partition_by="period")
    assert (tmp_path / "out" / "period=old").exists()
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, back.select("s", "v", "period").collect())) == sorted(map(tuple, df.collect()))
    write_table(df, f"{tmp_path}/csv", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2


def test_stacks_unlike_types_and_marks_bad_text(spark):
    a = spark.createDataFrame([(1, 2.0)], "station long, value double")
    b = spark.createDataFrame([("x", "oops"), ("y", "3.5")], "station string, value string")
    rows = stack_tables([a, b], SCHEMA).orderBy("station").collect()
    assert [(r.station, r.value) for r in rows] == [("1", 2.0), ("x", None), ("y", 3.5)]
    assert append(a.withColumnRenamed("value", "v"), a).columns == ["station", "v", "value"]


def test_daily_values_keep_parameter_and_stations(spark):
    df = spark.createDataFrame(
        [("a", "Flow", 1.0), ("a", "Level", 2.0), ("b", "Flow", 3.0)],
        "station string, parameter string, v double",
    )
    wanted = spark.createDataFrame([("a",), ("a",)], "station string")
    assert [r.v for r in daily_values(df, wanted).collect()] == [1.0]
    assert daily_values(df).count() == 2


def test_bucketed_tables_join_without_an_exchange(spark):
    days = spark.range(4000).selectExpr("concat('s', id % 3) as s", "cast(2000 + id % 7 as int) as year", "id", "id % 11 as v")
    left = write_bucketed(days, "bucketed_days", ["s", "year"], 4, "id")
    right = write_bucketed(days.groupBy("s", "year").max("v"), "bucketed_tops", ["s", "year"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left.join(right, ["s", "year"]).groupBy("s", "year").count()
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.agg({"count": "sum"}).first()[0] == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    again = write_bucketed(days.limit(10), "bucketed_days", ["s", "year"], 4)
    assert again.count() == 10
