"""Regime metrics to result tables: components, group tests, period tests, contrasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.columns import join_groups
from riverspark.functions import pattern_class
from riverspark.operators import clean, reshape
from riverspark.sources import append
from riverspark.stats import ols, paired, pca
from riverspark.stats.holm import holm
from riverspark.stats.permanova import permanova, permanova_strata


def component_scores(
    metrics: DataFrame, columns: Sequence[str], k: int = 3
) -> tuple[DataFrame, pca.PcaModel]:
    """Complete rows with their first ``k`` component scores, and the fitted model."""
    complete = clean.complete_cases(metrics, columns)
    model = pca.pca_fit(complete, columns)
    return pca.pca_scores(model, complete, k), model


def factor_tests(
    df: DataFrame,
    ident: str,
    factors: Sequence[str],
    responses: Sequence[str],
    n_perm: int = 999,
    draw: str = "xxhash64",
) -> DataFrame:
    """One overall test per factor, all in one job.

    Rows are repeated per factor, with its level as text; a NULL level leaves a row
    out of the test of that factor only.
    """
    levels = F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("_member")) for f in factors))
    members = df.select(ident, *responses, F.inline(levels))
    return permanova(members, ident, "_member", responses, by="factor", n_perm=n_perm, draw=draw)


def period_tests(
    df: DataFrame,
    subject: str,
    period: str,
    responses: Sequence[str],
    classes: Sequence[str],
    n_perm: int = 999,
    least_subjects: int = 2,
    draw: str = "xxhash64",
) -> DataFrame:
    """Period tests within subjects, overall and per level of each class.

    Rows are repeated per (family, member) and these pairs put all tests into one job.  p-values are
    adjusted within each class; the overall test stands alone.  Levels with fewer
    than ``least_subjects`` subjects come back with a NULL statistic and p-value.
    """
    complete = clean.complete_cases(df, [subject, period, *classes, *responses])
    groups = F.array(
        F.struct(F.lit("all").alias("family"), F.lit("all").alias("member")),
        *(
            F.struct(F.lit(c).alias("family"), F.col(c).cast("string").alias("member"))
            for c in classes
        ),
    )
    members = complete.withColumn("_group", F.explode(groups)).select(
        "_group.family", "_group.member", subject, period, *responses
    )
    sizes = members.groupBy("family", "member").agg(F.count_distinct(subject).alias("_n"))
    tested = join_groups(members, sizes.filter(F.col("_n") >= least_subjects), ["family", "member"], "left_semi")
    tests = permanova_strata(
        tested, period, responses, subject, by=["family", "member"], n_perm=n_perm, draw=draw
    )
    small = sizes.filter(F.col("_n") < least_subjects).select("family", "member")
    tests = tests.unionByName(small, allowMissingColumns=True)
    adjusted = holm(tests, "p_value", "family")
    return adjusted.withColumn(
        "p_adjusted", F.when(F.col("family") != "all", F.col("p_adjusted"))
    )


def period_contrasts(
    wide: DataFrame,
    ids: Sequence[str],
    group: str,
    columns: Mapping[str, tuple[str, str]],
    recent: str = "recent",
    historical: str = "historical",
) -> tuple[DataFrame, DataFrame]:
    """Contrasts and F tests of paired periods for several variables.

    ``columns`` maps a variable to its (recent, historical) column of ``wide``.
    """
    entries = [
        F.struct(F.lit(v).alias("variable"), F.lit(p).alias("period"), F.col(c).alias("value"))
        for v, (new, old) in columns.items()
        for p, c in ((recent, new), (historical, old))
    ]
    long = wide.select(*ids, group, F.inline(F.array(*entries)))
    differences = reshape.period_difference(
        long, [*ids, group], "variable", "period", "value", recent, historical
    )
    return (
        paired.paired_contrast(differences, group, by="variable"),
        paired.paired_anova(differences, group, by="variable"),
    )


def climate_effects(
    df: DataFrame,
    responses: Sequence[str],
    covariates: Sequence[str],
    factor: str,
    levels: Sequence[str],
) -> DataFrame:
    """Slopes of standardised covariates per factor level and response."""
    spark = df.sparkSession
    models = ols.ols_fits(df, responses, covariates, factor, levels)
    return append(
        *(
            ols.group_slopes(spark, model, covariates, factor, levels).withColumn("response", F.lit(y))
            for y, model in models.items()
        )
    )


def regression_table(
    df: DataFrame,
    responses: Sequence[str],
    covariates: Sequence[str],
    factor: str,
    levels: Sequence[str],
    pattern: str = ":",
    inside: str = "interaction",
    outside: str = "main",
) -> DataFrame:
    """Estimate, standard error, t, p and limits of every term and response.

    ``kind`` labels a term by whether its name holds ``pattern``.
    """
    spark = df.sparkSession
    models = ols.ols_fits(df, responses, covariates, factor, levels)
    tables = (ols.ols_table(spark, m).withColumn("response", F.lit(y)) for y, m in models.items())
    return append(*tables).withColumn("kind", pattern_class("term", pattern, inside, outside))
