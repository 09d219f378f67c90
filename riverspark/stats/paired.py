"""Repeated-measures contrasts of two periods.

With one value per subject and period, a model with group, period, their
interaction and a random intercept per subject reduces to the differences and
the means of each pair.  The equality holds for balanced pairs when the subject
variance is not negative.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverspark.columns import as_list
from riverspark.functions import row_count
from riverspark.stats.distributions import f_p_value, t_critical, t_p_value


def paired_contrast(
    differences: DataFrame,
    group: str,
    diff: str = "diff",
    by: str | Sequence[str] | None = None,
    level: float = 0.95,
) -> DataFrame:
    """Mean difference per group with pooled standard error, t, p and limits.

    ``differences`` has one row per subject (and per ``by`` variable); subjects
    with a NULL difference or group are left out.
    """
    names = as_list(by)
    groups = (
        differences.filter(F.col(diff).isNotNull() & F.col(group).isNotNull())
        .groupBy(*names, group)
        .agg(
            row_count().alias("n"),
            F.avg(diff).alias("estimate"),
            F.coalesce(F.var_samp(diff), F.lit(0.0)).alias("_var"),
        )
    )
    # One row per group and variable is left here.
    pool = Window.partitionBy(*(names or [F.lit(0)]))
    spare = F.sum(F.col("n") - 1).over(pool)
    pooled = F.try_divide(F.sum((F.col("n") - 1) * F.col("_var")).over(pool), spare)
    return (
        groups.withColumn("df", spare)
        .withColumn("se", F.sqrt(pooled / F.col("n")))
        .withColumn("t", F.try_divide("estimate", "se"))
        .withColumn("p", t_p_value("t", "df"))
        .withColumn("_half", t_critical("df", level) * F.col("se"))
        .withColumn("lower", F.col("estimate") - F.col("_half"))
        .withColumn("upper", F.col("estimate") + F.col("_half"))
        .drop("_var", "_half")
    )


def paired_anova(
    pairs: DataFrame,
    group: str,
    recent: str = "recent",
    historical: str = "historical",
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """F tests of group, period and their interaction, terms in that order."""
    names = as_list(by)
    both = pairs.filter(
        F.col(recent).isNotNull() & F.col(historical).isNotNull() & F.col(group).isNotNull()
    ).select(
        *names,
        group,
        (F.col(recent) - F.col(historical)).alias("_d"),
        ((F.col(recent) + F.col(historical)) / 2).alias("_m"),
    )
    groups = both.groupBy(*names, group).agg(
        row_count().alias("_n"),
        *(F.avg(c).alias(f"{c}_avg") for c in ("_d", "_m")),
        *((F.var_pop(c) * row_count()).alias(f"{c}_ss") for c in ("_d", "_m")),
    )
    # Spread of the group means about the weighted mean, one row per group.
    spread = {
        c: F.sum(F.col("_n") * F.col(f"{c}_avg") * F.col(f"{c}_avg"))
        - F.sum(F.col("_n") * F.col(f"{c}_avg")) * F.sum(F.col("_n") * F.col(f"{c}_avg")) / F.sum("_n")
        for c in ("_d", "_m")
    }
    overall = F.sum(F.col("_n") * F.col("_d_avg"))
    totals = groups.groupBy(*names).agg(
        F.sum("_n").alias("_total"),
        row_count().alias("_g"),
        F.sum("_d_ss").alias("_d_within"),
        F.sum("_m_ss").alias("_m_within"),
        spread["_d"].alias("_d_between"),
        spread["_m"].alias("_m_between"),
        (overall * overall / F.sum("_n")).alias("_d_overall"),
    )
    rest = F.col("_total") - F.col("_g")
    above = F.col("_g") - 1

    def test(term: str, between, df1, within):
        f = F.try_divide(F.try_divide(between, df1), within / rest)
        return F.struct(
            F.lit(term).alias("term"),
            df1.cast("bigint").alias("df1"),
            rest.cast("bigint").alias("df2"),
            f.alias("f_stat"),
        )

    tests = F.array(
        test("group", F.col("_m_between"), above, F.col("_m_within")),
        test("period", F.col("_d_overall"), F.lit(1), F.col("_d_within")),
        test("group:period", F.col("_d_between"), above, F.col("_d_within")),
    )
    listed = totals.select(*names, F.inline(tests))
    return listed.withColumn("p", f_p_value("f_stat", "df1", "df2"))
