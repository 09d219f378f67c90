"""Adjustment of p-values for multiple tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.columns import as_list, join_groups
from riverspark.operators.scan import in_ranges, running
from riverspark.session import cut_lineage
from riverspark.stats.attach import attach


def holm(
    df: DataFrame, p: str, family: str | Sequence[str] | None = None, into: str = "p_adjusted"
) -> DataFrame:
    """Step-down adjustment within each family; NULL p-values are no tests.

    Takes a table of test results, one row per test, which is written once.  Equal
    p-values have one adjusted value, so each family's distinct values are counted
    and put in ranges; numbers of tests and the largest step so far are carried from
    range to range.  Neither a large family nor a frequent p-value lands in one task.
    """
    names = as_list(family)
    tests = cut_lineage(df)
    counted = tests.filter(F.col(p).isNotNull()).groupBy(*names, F.col(p).alias("_p")).agg(F.count("*").alias("_k"))
    ranged = in_ranges(counted, names, ["_p"])
    sizes = F.sum("_k").alias("_m")
    sizes = ranged.groupBy(*names).agg(sizes) if names else ranged.agg(sizes)
    ranked = attach(running(ranged, names, ["_p"], "_upto", F.col("_k")), sizes, names)
    # The first of equal values has the largest factor: all tests but those before it.
    step = (F.col("_m") - F.col("_upto") + F.col("_k")) * F.col("_p")
    stepped = running(ranked, names, ["_p"], "_step", step, "max")
    adjusted = stepped.select(*names, F.col("_p").alias(p), F.least(F.lit(1.0), F.col("_step")).alias(into))
    rest = tests.drop(into) if into in tests.columns else tests
    return join_groups(rest, adjusted, [*names, p], "left")
