"""Row-level cleaning, source precedence and key filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from riverspark.columns import as_list, join_groups
from riverspark.functions import row_count


def mask_by_flag(
    df: DataFrame, value: str, flag: str, allowed: Sequence[str], into: str | None = None
) -> DataFrame:
    """Keep a value only where its quality flag is allowed, else NULL."""
    ok = F.col(flag).isin(*allowed)
    return df.withColumn(into or value, F.when(ok, F.col(value)))


def clip_period(
    df: DataFrame, date: str, lo=None, hi=None, lo_open: bool = False, hi_open: bool = False
) -> DataFrame:
    """Keep rows inside a date range; either end may be absent or open."""
    column = F.col(date)
    if lo is not None:
        df = df.filter(column > F.lit(lo) if lo_open else column >= F.lit(lo))
    if hi is not None:
        df = df.filter(column < F.lit(hi) if hi_open else column <= F.lit(hi))
    return df


def apply_trim_rules(df: DataFrame, rules: DataFrame, key: str, date: str) -> DataFrame:
    """Drop the bad start of some series.

    ``rules`` has ``key``, ``min_date`` and optionally ``inclusive`` (default
    true).  Several rules of one key all apply; keys without a rule are untouched.
    """
    earliest = first_good_days(rules, key)
    return (
        df.join(earliest, key, "left")
        .filter(F.col("_first_day").isNull() | (F.col(date) >= F.col("_first_day")))
        .drop("_first_day")
    )


def first_good_days(rules: DataFrame, key: str) -> DataFrame:
    """The first day that all trim rules of a key leave, as ``_first_day``."""
    if "inclusive" not in rules.columns:
        rules = rules.withColumn("inclusive", F.lit(True))
    first_day = F.when(F.col("inclusive"), F.col("min_date")).otherwise(
        F.date_add("min_date", 1)
    )
    return rules.groupBy(key).agg(F.max(first_day).alias("_first_day"))


def clip_by_period_bounds(
    df: DataFrame, year: str, period: str, bounds: dict[str, tuple[str, str]]
) -> DataFrame:
    """Which pair of bound columns applies depends on the row's period."""
    inside = None
    for name, (lo, hi) in bounds.items():
        test = F.col(year).between(F.col(lo), F.col(hi))
        hit = F.col(period) == F.lit(name)
        inside = F.when(hit, test) if inside is None else inside.when(hit, test)
    return df.filter(inside)


def above_global_min(df: DataFrame, column: str, below: float) -> DataFrame:
    """All rows if the smallest value of ``column`` is below a bound, else none."""
    lowest = df.agg(F.min(column)).scalar()
    return df.filter(lowest < below)


def override_values(
    df: DataFrame, fixes: DataFrame, on: str | Iterable[str], columns: str | Iterable[str]
) -> DataFrame:
    """Replace cells of listed keys; ``fixes`` carries the new values."""
    keys, names = as_list(on), as_list(columns)
    renamed = fixes.select(*keys, *(F.col(c).alias(f"_fix_{c}") for c in names))
    joined = df.join(renamed, keys, "left")
    return joined.select(
        *(
            F.coalesce(f"_fix_{c}", c).alias(c) if c in names else F.col(c)
            for c in df.columns
        )
    )


def assign_period(
    df: DataFrame, year: str, periods: dict[str, tuple[int, int]], into: str = "period"
) -> DataFrame:
    """Name the period of each year and drop years outside all periods."""
    label = None
    for name, (lo, hi) in periods.items():
        hit = F.col(year).between(lo, hi)
        label = F.when(hit, F.lit(name)) if label is None else label.when(hit, F.lit(name))
    return df.withColumn(into, label).filter(F.col(into).isNotNull())


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without NULL or NaN in the given columns."""
    return df.dropna(how="any", subset=list(columns))


def enrich(df: DataFrame, dim: DataFrame, keys: str | Iterable[str]) -> DataFrame:
    """Left join with a dimension that has one row per key.

    No broadcast hint: Catalyst and AQE broadcast the dimension when its measured
    size allows and split skewed keys otherwise.
    """
    return df.join(dim, as_list(keys), "left")


def assemble(tables: Sequence[DataFrame], keys: str | Iterable[str]) -> DataFrame:
    """Full outer join of many tables with one row per key each.

    Tables are stacked and merged by one grouped aggregation, hence one shuffle
    for any number of tables; NULL keys match each other.  A column found in more
    than one table takes the first table's value.  A key that occurs twice in one
    table raises an error instead of losing a row.
    """
    names = as_list(keys)
    columns: list[str] = []
    for t in tables:
        columns += [c for c in t.columns if c not in names and c not in columns]
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        (
            t.select(
                *names,
                F.lit(i).alias("_table"),
                *(F.col(c).alias(f"_{i}_{c}") for c in t.columns if c not in names),
            )
            for i, t in enumerate(tables)
        ),
    )
    sources = {c: [i for i, t in enumerate(tables) if c in t.columns] for c in columns}
    merged = stacked.groupBy(*names).agg(
        *(
            F.coalesce(*(F.max(f"_{i}_{c}") for i in sources[c])).alias(c)
            for c in columns
        ),
        *(F.count_if(F.col("_table") == i).alias(f"_n{i}") for i in range(len(tables))),
    )
    clash = F.greatest(*(f"_n{i}" for i in range(len(tables)))) if len(tables) > 1 else F.col("_n0")
    message = F.concat(F.lit("duplicate key in a table to assemble: "), F.concat_ws(",", *names))
    return merged.filter(
        F.when(clash > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    ).select(*names, *columns)


def full_join_suffixed(
    left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """Full outer join; value columns of both sides get a suffix."""

    def tagged(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(
            *keys, *(F.col(c).alias(c + suffix) for c in df.columns if c not in keys)
        )

    return tagged(left, suffixes[0]).join(tagged(right, suffixes[1]), list(keys), "full")


def keep_keys(df: DataFrame, keys_df: DataFrame, on: str | Iterable[str]) -> DataFrame:
    """Rows whose key is in the list."""
    names = as_list(on)
    return df.join(keys_df.select(*names).distinct(), names, "left_semi")


def drop_keys(
    df: DataFrame,
    reject_dfs: Sequence[DataFrame],
    on: str | Iterable[str],
    pardon: DataFrame | None = None,
) -> DataFrame:
    """Rows whose key is in none of the reject lists.

    ``pardon`` lists keys to be taken off the reject lists.  Rows with a NULL key
    stay, as "not in a list" is never unknown.
    """
    names = as_list(on)
    rejects = reduce(lambda a, b: a.unionByName(b), (r.select(*names) for r in reject_dfs))
    rejects = rejects.distinct()
    if pardon is not None:
        rejects = rejects.join(pardon.select(*names).distinct(), names, "left_anti")
    return df.join(rejects, names, "left_anti")


def missing_keys(a: DataFrame, b: DataFrame, on: str | Iterable[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks."""
    names = as_list(on)
    return a.select(*names).distinct().join(b.select(*names).distinct(), names, "left_anti")


def merge_with_precedence(
    primary: DataFrame, fallback: DataFrame, keys: str | Iterable[str]
) -> DataFrame:
    """All primary rows, plus fallback rows for keys the primary source lacks."""
    names = as_list(keys)
    extra = fallback.join(primary.select(*names).distinct(), names, "left_anti")
    return primary.unionByName(extra, allowMissingColumns=True)


def replace_keys(df: DataFrame, new: DataFrame, on: str | Iterable[str]) -> DataFrame:
    """Drop the keys that ``new`` covers, then append ``new``."""
    names = as_list(on)
    kept = df.join(new.select(*names).distinct(), names, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def dedupe(df: DataFrame, keys: str | Iterable[str], order: Sequence) -> DataFrame:
    """First row per key under an explicit order.

    ``row_number() = 1`` lets Spark drop losers before the shuffle, so a hot key
    sends at most one row per task.
    """
    ranked = Window.partitionBy(*as_list(keys)).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def _some(rows: DataFrame, into: str) -> DataFrame:
    """One row: whether there is any."""
    return rows.agg((row_count() > 0).alias(into))


def duplicates_found(df: DataFrame, keys: str | Iterable[str], into: str = "duplicates") -> DataFrame:
    """One row that tells whether some key occurs more than once."""
    return _some(df.groupBy(*as_list(keys)).count().filter("count > 1"), into)


def nulls_found(df: DataFrame, columns: str | Iterable[str] | None = None, into: str = "nulls") -> DataFrame:
    """One row that tells whether some cell is NULL."""
    names = as_list(columns) or df.columns
    return _some(df.filter(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in names))), into)


def has_duplicates(df: DataFrame, keys: str | Iterable[str]) -> bool:
    """Whether some key occurs more than once."""
    return duplicates_found(df, keys).first()[0]


def has_nulls(df: DataFrame, columns: str | Iterable[str] | None = None) -> bool:
    """Whether some cell is NULL."""
    return nulls_found(df, columns).first()[0]


def observe_checks(
    df: DataFrame,
    within: str | Iterable[str],
    order: str,
    columns: str | Iterable[str] | None = None,
) -> tuple[DataFrame, Observation]:
    """The same checks on the pass that reads or writes ``df`` anyway.

    Returns the table and its observation; after the first action on the table (or on
    what is built from it) ``get`` holds ``rows``, ``repeats`` (rows whose ``order``
    value occurred before in their group ``within``) and ``nulls_<column>`` for
    ``columns`` (default: all).  NULL is a value like others in groups and orders.  A
    table that is dealt by ``within`` already is not shuffled again; otherwise name
    columns that split hot groups, such as key and year.  Counts are exact for an
    undisturbed run; a stage that runs again may count rows twice, so compare with 0.
    """
    names = as_list(columns) or df.columns
    inside = Window.partitionBy(*as_list(within)).orderBy(order)
    again = F.lag(order).over(inside).eqNullSafe(F.col(order)) & (F.row_number().over(inside) > 1)
    seen = Observation()
    metrics = {"repeats": F.col("_again")} | {f"nulls_{c}": F.col(c).isNull() for c in names}
    checked = df.withColumn("_again", again).observe(
        seen, row_count().alias("rows"), *(F.count_if(test).alias(name) for name, test in metrics.items())
    )
    return checked.drop("_again"), seen


def min_group_size(df: DataFrame, keys: str | Iterable[str], n: int, exact: bool = False) -> DataFrame:
    """Rows of groups with more than ``n`` rows (or exactly ``n``).

    Sizes are pre-aggregated, so no group has to fit into one task.
    """
    names = as_list(keys)
    size = df.groupBy(*names).agg(row_count().alias("_size"))
    wanted = size.filter(F.col("_size") == n if exact else F.col("_size") > n)
    return join_groups(df, wanted, names, "left_semi")


def top_by(
    df: DataFrame, keys: str | Iterable[str], value: str, ties: bool = True, order: Sequence = ()
) -> DataFrame:
    """Rows that hold the largest value of their group.

    ``ties=True`` keeps every row with the largest value: the maxima are aggregated
    and joined back, as there may be too many such rows for one task.  Otherwise
    ``order`` breaks ties, and the rank filter is applied before the shuffle as well.
    """
    names = as_list(keys)
    present = df.filter(F.col(value).isNotNull())
    if not ties:
        ranked = Window.partitionBy(*names).orderBy(F.col(value).desc(), *order)
        first = present.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1")
        return first.drop("_rank")
    best = present.groupBy(*(F.col(c).alias(f"_best_{c}") for c in names)).agg(
        F.max(value).alias("_best")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_best_{c}")) for c in names]
    return present.join(
        best, reduce(lambda a, b: a & b, same, F.col(value) == F.col("_best")), "left_semi"
    )


def unordered_pairs(df: DataFrame, column: str) -> DataFrame:
    """C11: every unordered pair of distinct labels, as ``var1 < var2``.

    Meant for factor levels.  Labels are gathered into one sorted array and paired
    by expression, which needs no self join.
    """
    levels = df.filter(F.col(column).isNotNull()).agg(
        F.array_sort(F.collect_set(column)).alias("_levels")
    )
    return (
        levels.select("_levels", F.posexplode("_levels").alias("_i", "var1"))
        .select(
            "var1",
            F.explode(F.slice("_levels", F.col("_i") + 2, F.size("_levels"))).alias("var2"),
        )
    )
