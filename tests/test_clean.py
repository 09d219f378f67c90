import datetime as dt

import pytest
from pyspark.sql import functions as F

from riverspark.operators import clean
from riverspark.operators.reshape import grouped_means, paired_only, period_difference, to_wide


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_flag_mask_needs_a_listed_flag(spark):
    df = spark.createDataFrame([(1.0, "A"), (2.0, "P"), (3.0, None)], "v double, f string")
    assert [r.v for r in clean.mask_by_flag(df, "v", "f", ["A", "A e"]).collect()] == [1.0, None, None]


def test_period_ends_may_be_open(spark):
    df = spark.createDataFrame([(dt.date(2000, 1, d),) for d in (1, 2, 3)], "date date")
    lo, hi = dt.date(2000, 1, 1), dt.date(2000, 1, 3)
    assert clean.clip_period(df, "date", lo, hi).count() == 3
    assert clean.clip_period(df, "date", lo, hi, lo_open=True, hi_open=True).count() == 1
    assert clean.clip_period(df, "date").count() == 3


def test_trim_rules_combine_and_spare_other_stations(spark):
    df = spark.createDataFrame(
        [(s, dt.date(2000, 1, d)) for s in "ab" for d in range(1, 6)], "station string, date date"
    )
    rules = spark.createDataFrame(
        [("a", dt.date(2000, 1, 2), False), ("a", dt.date(2000, 1, 2), True)],
        "station string, min_date date, inclusive boolean",
    )
    kept = clean.apply_trim_rules(df, rules, "station", "date")
    assert kept.filter("station = 'a'").agg(F.min("date")).first()[0] == dt.date(2000, 1, 3)
    assert kept.filter("station = 'b'").count() == 5


def test_rejected_keys_spare_null_keys_and_pardons(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    bad = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    pardon = spark.createDataFrame([("b",)], "k string")
    assert rows(clean.drop_keys(df, [bad, bad], "k", pardon)) == sorted(
        [("b",), ("c",), (None,)], key=repr
    )
    assert rows(clean.keep_keys(df, bad, "k")) == [("a",), ("b",)]
    assert rows(clean.missing_keys(df.dropna(), bad, "k")) == [("c",)]


def test_assemble_matches_null_keys_and_refuses_duplicates(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([("y", 3), (None, 4)], "k string, b int")
    got = rows(clean.assemble([a, b], "k"))
    assert got == sorted([("x", 1, None), ("y", None, 3), (None, 2, 4)], key=repr)
    with pytest.raises(Exception, match="duplicate key"):
        clean.assemble([a.union(a), b], "k").collect()


def test_fallback_rows_only_where_the_primary_has_none(spark):
    final = spark.createDataFrame([("a", 1, 1.0)], "s string, d int, q double")
    prelim = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 2.0)], "s string, d int, q double")
    assert rows(clean.merge_with_precedence(final, prelim, ["s", "d"])) == [("a", 1, 1.0), ("a", 2, 2.0)]
    better = spark.createDataFrame([("a", 7, 7.0)], "s string, d int, q double")
    assert rows(clean.replace_keys(prelim, better, "s")) == [("a", 7, 7.0)]


def test_top_by_ties_dedupe_and_group_size(spark):
    df = spark.createDataFrame(
        [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 1.0), ("b", 1, None)], "k string, i int, v double"
    )
    assert rows(clean.top_by(df, "k", "v")) == [("a", 1, 5.0), ("a", 2, 5.0)]
    assert rows(clean.top_by(df, "k", "v", ties=False, order=["i"])) == [("a", 1, 5.0)]
    assert rows(clean.dedupe(df, "k", [F.col("i").desc()]).select("k", "i")) == [("a", 3), ("b", 1)]
    assert clean.min_group_size(df, "k", 2).count() == 3
    assert clean.min_group_size(df, "k", 1, exact=True).count() == 1
    assert clean.has_duplicates(df, "k") and not clean.has_duplicates(df, ["k", "i"])
    assert clean.has_nulls(df) and not clean.has_nulls(df, "k")


def test_checks_ride_on_the_pass_that_writes(spark, tmp_path):
    days = [("a", 2, 1.0), ("a", 2, None), ("a", 2, 3.0), ("a", 3, 1.0), ("b", 2, 1.0), (None, None, 1.0), (None, None, 2.0)]
    df = spark.createDataFrame(days, "k string, d int, v double")
    checked, seen = clean.observe_checks(df, "k", "d")
    checked.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"rows": 7, "repeats": 3, "nulls_k": 2, "nulls_d": 2, "nulls_v": 1}
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(df)
    checked, seen = clean.observe_checks(df.limit(0), "k", "d", "v")
    assert checked.columns == ["k", "d", "v"] and checked.count() == 0
    assert seen.get == {"rows": 0, "repeats": 0, "nulls_v": 0}


def test_checks_add_no_exchange_to_a_table_dealt_by_its_key(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS d").repartition("k")
    checked, _ = clean.observe_checks(df, "k", "d")
    assert checked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_losers_of_a_rank_are_dropped_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")
    plan = clean.dedupe(df, "k", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_period_bounds_overrides_and_gate(spark):
    df = spark.createDataFrame(
        [("old", 1980, 1979, 1990, 2000, 2010), ("new", 1980, 1979, 1990, 2000, 2010)],
        "period string, year int, a int, b int, c int, d int",
    )
    kept = clean.clip_by_period_bounds(df, "year", "period", {"old": ("a", "b"), "new": ("c", "d")})
    assert [r.period for r in kept.collect()] == ["old"]
    named = spark.createDataFrame([("1", None), ("2", "x")], "k string, name string")
    fixes = spark.createDataFrame([("1", "fixed")], "k string, name string")
    assert rows(clean.override_values(named, fixes, "k", "name")) == [("1", "fixed"), ("2", "x")]
    assert clean.above_global_min(df, "year", 1981).count() == 2
    assert clean.above_global_min(df, "year", 1980).count() == 0


def test_pairs_of_levels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "g string")
    assert rows(clean.unordered_pairs(df, "g")) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_period_pairs_need_both_periods(spark):
    df = spark.createDataFrame(
        [("a", "v", "new", 3.0), ("a", "v", "old", 2.0), ("b", "v", "new", 1.0),
         ("c", "v", "new", 1.0), ("c", "v", "old", None), ("z", "v", "new", 1.0), ("z", "v", "old", 0.0)],
        "id string, variable string, period string, value double",
    )
    diff = period_difference(df, ["id"], "variable", "period", "value", "new", "old")
    got = {r.id: (r.diff, r.diff_percent) for r in diff.collect()}
    assert got == {"a": (1.0, 50.0), "z": (1.0, None)}
    assert paired_only(df, ["id"], "variable", "period", "value").count() == 4
    wide = to_wide(df, ["id"], "period", "value", ["new", "old"])
    assert wide.columns == ["id", "new", "old"] and wide.count() == 4


def test_grouping_sets_leave_absent_keys_null(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0)], "g string, h string, v double")
    got = rows(grouped_means(df, [["g"], ["h"]], {"v": "m"}))
    assert got == sorted([("a", None, 1.0), ("b", None, 3.0), (None, "x", 2.0)], key=repr)
