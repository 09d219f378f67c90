"""Standardised columns and correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.columns import as_list
from riverspark.stats.attach import attach
from riverspark.stats.distributions import t_p_value
from riverspark.stats.holm import holm


def zscore(
    df: DataFrame, columns: Sequence[str], by: str | Sequence[str] | None = None, suffix: str = "_z"
) -> DataFrame:
    """K1: centre and scale by the sample deviation; NULLs are left out of both.

    A column without spread gives NULL.
    """
    keys = as_list(by)
    stats = [
        e
        for c in columns
        for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))
    ]
    small = df.groupBy(*keys).agg(*stats) if keys else df.agg(*stats)
    joined = attach(df, small, keys)
    scaled = {
        c + suffix: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns
    }
    return joined.withColumns(scaled).drop(*(f"_{k}_{c}" for c in columns for k in "ms"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, on rows where both are present.

    All pairs come from one pass over the data.
    """
    pairs = list(combinations(columns, 2))
    found = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    entries = [
        F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return found.select(F.inline(F.array(*entries)))


def correlation_table(df: DataFrame, columns: Sequence[str], z: float = 1.959963984540054) -> DataFrame:
    """``n``, ``r``, limits, ``t``, ``p`` and Holm-adjusted p of every pair of columns.

    Each pair takes the rows where both are present; all pairs come from one pass.
    The limits are those of Fisher's transformation with the normal quantile ``z``.
    """
    pairs = list(combinations(columns, 2))
    both = [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1) for a, b in pairs]
    found = df.agg(
        *(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)),
        *(F.count(e).alias(f"n{i}") for i, e in enumerate(both)),
    )
    entries = [
        F.struct(
            F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r")
        )
        for i, (a, b) in enumerate(pairs)
    ]
    rows = found.select(F.inline(F.array(*entries)))
    half = F.lit(z) * F.try_divide(F.lit(1.0), F.sqrt(F.col("n") - 3))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    tested = rows.withColumns(
        {"lower": F.tanh(F.atanh("r") - half), "upper": F.tanh(F.atanh("r") + half), "t": t}
    ).withColumn("p", t_p_value("t", F.col("n") - 2))
    return holm(tested, "p")
