"""Permutation analysis of variance on Euclidean distances.

For Euclidean distances the pseudo-F statistic needs only group sums, so no
distance matrix is built; ``permuting`` has the sums of every permutation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverspark.columns import as_list
from riverspark.functions import row_count
from riverspark.operators.clean import unordered_pairs
from riverspark.session import cut_lineage
from riverspark.stats.attach import attach, per_group
from riverspark.stats.holm import holm
from riverspark.stats.permuting import partitions, permuted_sums, sums_by_level, two_levels

# Permuted statistics this close below the observed one count as equal.
TOLERANCE = 1.5e-8


def _numbered(responses: Sequence[str]) -> list[str]:
    return [f"_x{i}" for i in range(len(responses))]


def _standard(
    df: DataFrame, factor: str, responses: Sequence[str], keep: dict[str, str]
) -> DataFrame:
    return df.select(
        *(F.col(c).alias(alias) for alias, c in keep.items()),
        F.col(factor).alias("_level"),
        *(F.col(c).cast("double").alias(x) for c, x in zip(responses, _numbered(responses))),
    ).dropna()


def _families(rows: DataFrame, by: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Size, number of levels, total sum of squares and means per family."""
    total = sum((F.var_pop(x) for x in xs[1:]), F.var_pop(xs[0])) * row_count()
    stats = [
        row_count().alias("_n"),
        F.count_distinct("_level").alias("_a"),
        total.alias("_ss"),
        *(F.avg(x).alias(f"_m{x}") for x in xs),
    ]
    return rows.groupBy(*by).agg(*stats) if by else rows.agg(*stats)


def _centred(rows: DataFrame, families: DataFrame, by: Sequence[str], xs: Sequence[str]) -> DataFrame:
    means = families.select(*by, *(f"_m{x}" for x in xs))
    joined = attach(rows, means, by)
    return joined.withColumns({x: F.col(x) - F.col(f"_m{x}") for x in xs}).drop(
        *(f"_m{x}" for x in xs)
    )


def _between(xs: Sequence[str]) -> Column:
    """Sum of squares between levels, from centred level sums."""
    squares = sum((F.col(x) * F.col(x) for x in xs[1:]), F.col(xs[0]) * F.col(xs[0]))
    return F.sum(squares / F.col("_n_level"))


def _statistic() -> Column:
    return F.try_divide(
        F.try_divide(F.col("_ssb"), F.col("_a") - 1),
        F.try_divide(F.col("_ss") - F.col("_ssb"), F.col("_n") - F.col("_a")),
    )


def _degrees() -> list[Column]:
    return [
        (F.col("_a") - 1).cast("int").alias("df_factor"),
        (F.col("_n") - F.col("_a")).cast("bigint").alias("df_residual"),
        (F.col("_n") - 1).cast("bigint").alias("df_total"),
    ]


def permanova_f(
    df: DataFrame, factor: str, responses: Sequence[str], by: str | Sequence[str] | None = None
) -> DataFrame:
    """K6: pseudo-F and degrees of freedom, without permutations."""
    families_by = as_list(by)
    xs = _numbered(responses)
    rows = _standard(df, factor, responses, {c: c for c in families_by})
    families = _families(rows, families_by, xs)
    families = per_group(families, families_by) if families_by else families
    sums = sums_by_level(_centred(rows, families, families_by, xs), families_by, xs)
    between = _between(xs).alias("_ssb")
    between = sums.groupBy(*families_by).agg(between) if families_by else sums.agg(between)
    return attach(between, families, families_by).select(
        *families_by, *_degrees(), _statistic().alias("f_stat")
    )


def permanova(
    df: DataFrame,
    ident: str,
    factor: str,
    responses: Sequence[str],
    *,
    by: str | Sequence[str] | None = None,
    strata: str | None = None,
    n_perm: int = 999,
    seed: str = "0",
    whole_rows: int = 4096,
    draw: str = "xxhash64",
) -> DataFrame:
    """K6, K7: pseudo-F with a permutation p-value, for one or many families at once.

    ``by`` splits the rows into independent tests.  ``strata`` restricts the
    permutation to rows of the same stratum.  ``ident`` identifies a row within its
    family.  Rows with a NULL are left out.  The test reads its rows several times,
    so their narrow table is written to the checkpoint folder.  ``draw`` names
    the hash that orders the rows: ``xxhash64`` is fast, ``md5`` can be repeated
    outside Spark.  Families or strata of at most ``whole_rows`` rows are ranked in
    one task each; larger ones are never gathered or sorted.
    """
    families_by = as_list(by)
    xs = _numbered(responses)
    keep = {c: c for c in families_by} | {"_id": ident}
    if strata:
        keep["_stratum"] = strata
    rows = _standard(df, factor, responses, keep).withColumn("_id", F.col("_id").cast("string"))
    # Spread by id: the work per permutation then does not depend on how rows fall into files or families.
    rows = cut_lineage(rows if strata else rows.repartition(partitions(df.sparkSession), *families_by, "_id"))
    families = per_group(_families(rows, families_by, xs), families_by)
    centred = cut_lineage(_centred(rows, families, families_by, xs)) if families_by else _centred(rows, families, [], xs)
    sums = permuted_sums(
        centred, families_by, xs, strata=strata is not None, n_perm=n_perm, seed=seed, draw=draw, whole_rows=whole_rows
    )
    observed = sums_by_level(centred, families_by, xs).withColumn("_perm", F.lit(0))
    between = (
        sums.unionByName(observed).groupBy(*families_by, "_perm").agg(_between(xs).alias("_ssb"))
    )
    statistics = attach(between, families, families_by).withColumn("_f", _statistic())
    return _summary(statistics, families_by)


def _summary(statistics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Observed statistic (permutation 0) and share of statistics not below it."""
    gathered = statistics.groupBy(*by, "_a", "_n").agg(
        F.max(F.when(F.col("_perm") == 0, F.col("_f"))).alias("f_stat"),
        F.collect_list("_f").alias("_fs"),
        (F.count(F.lit(1)) - 1).cast("int").alias("n_perm"),
    )
    reached = F.filter("_fs", lambda f: f >= F.col("f_stat") - TOLERANCE)
    return gathered.select(
        *by,
        *_degrees(),
        "f_stat",
        F.when(
            F.col("f_stat").isNotNull(), F.size(reached).cast("double") / (F.col("n_perm") + 1)
        ).alias("p_value"),
        "n_perm",
    )


def permanova_strata(
    df: DataFrame,
    factor: str,
    responses: Sequence[str],
    strata: str,
    *,
    by: str | Sequence[str] | None = None,
    ident: str | None = None,
    n_perm: int = 999,
    seed: str = "0",
    draw: str = "xxhash64",
) -> DataFrame:
    """K7: permutation within strata, with all permutations where they are few.

    A family whose strata are all pairs of the same two levels has 2^strata
    permutations.  When ``n_perm`` is at least that many, each is evaluated once;
    all other families draw ``n_perm`` random ones.
    """
    families_by = as_list(by)
    xs = _numbered(responses)
    df = cut_lineage(
        df.select(*dict.fromkeys([*families_by, strata, factor, *as_list(ident), *responses]))
    )
    keep = {c: c for c in families_by} | {"_stratum": strata}
    rows = _standard(df, factor, responses, keep)
    pairs = two_levels(rows, [*families_by, "_stratum"], xs)
    most = int(math.floor(math.log2(max(n_perm, 1))))
    checks = [
        row_count().alias("_strata"),
        (
            (F.min("_k") == 2) & (F.max("_k") == 2)
            & (F.min("_first") == F.max("_first")) & (F.min("_last") == F.max("_last"))
            & (F.min("_first") < F.min("_last"))
        ).alias("_paired"),
    ]
    shape = pairs.groupBy(*families_by).agg(*checks) if families_by else pairs.agg(*checks)
    few = F.col("_paired") & (F.col("_strata") <= most)

    # At most `most` strata per family get past this filter.
    small = attach(pairs, shape, families_by).filter(few)
    families = _families(rows, families_by, xs)
    number = F.row_number().over(Window.partitionBy(*(families_by or [F.lit(0)])).orderBy("_stratum"))
    coded = (
        attach(small, families.select(*families_by, *(f"_m{x}" for x in xs)), families_by)
        .withColumn("_bit", F.pow(F.lit(2.0), number - 1).cast("bigint"))
        .withColumn(
            "_perm",
            F.explode(F.sequence(F.lit(0), F.pow(F.lit(2.0), F.col("_strata")).cast("int") - 1)),
        )
    )
    swapped = F.col("_perm").cast("bigint").bitwiseAND(F.col("_bit")) != 0
    first = [
        F.sum(F.when(swapped, F.col(f"_b{x}")).otherwise(F.col(f"_a{x}")) - F.col(f"_m{x}")).alias(x)
        for x in xs
    ]
    # Centred sums of the two levels cancel, so both contribute the same square.
    sums = coded.groupBy(*families_by, "_perm").agg(F.count(F.lit(1)).alias("_s"), *first)
    squares = sum((F.col(x) * F.col(x) for x in xs[1:]), F.col(xs[0]) * F.col(xs[0]))
    exact = attach(
        sums.withColumn("_ssb", 2 * squares / F.col("_s")), families, families_by
    ).withColumn("_f", _statistic())
    exact = _summary(exact, families_by)

    drawn = attach(df, shape, families_by).filter(~few)
    row_id = ident or "_row_id"
    if ident is None:
        drawn = drawn.withColumn(row_id, F.concat_ws("|", F.col(strata), F.col(factor)))
    random = permanova(
        drawn, row_id, factor, responses, by=families_by, strata=strata, n_perm=n_perm,
        seed=seed, draw=draw,
    )
    return exact.unionByName(random)


def pairwise_permanova(
    df: DataFrame,
    ident: str,
    factor: str,
    responses: Sequence[str],
    *,
    n_perm: int = 999,
    seed: str = "0",
    draw: str = "xxhash64",
) -> DataFrame:
    """K9: one test per pair of levels, all in one job, with adjusted p-values."""
    rows = df.select(ident, factor, *responses).dropna()
    pairs = unordered_pairs(rows, factor)
    members = pairs.select(
        "var1", "var2", F.explode(F.array("var1", "var2")).alias(factor)
    )
    tests = permanova(
        rows.join(members, factor, "inner"),
        ident,
        factor,
        responses,
        by=["var1", "var2"],
        n_perm=n_perm,
        seed=seed,
        draw=draw,
    )
    return holm(tests, "p_value")
