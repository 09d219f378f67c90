"""Sums per factor level under random permutations, without moving rows once per permutation.

A permutation deals the levels of a unit, in fixed numbers, to its rows in the order
of a hash of (seed, permutation, row id).  Only the rows at which one level ends and
the next begins matter: with their hashes known, every row finds its level in any
permutation by itself, and level sums are partial aggregates of the task that holds
it.  Units of many rows find these hashes by radix selection, units of few rows are
ranked where their rows lie, and units of two rows either swap or do not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverspark.columns import join_groups
from riverspark.functions import row_count
from riverspark.session import cut_lineage
from riverspark.stats.attach import attach

#: Eight bits of the order are looked at per round of the selection.
_DIGIT = 8
#: Ranges of this many rows are sorted instead of being split again.
_FEW = 64
#: Tables of this many level ends may be broadcast.
_SMALL = 200_000

# How rows are put in a random order: hash of (seed, permutation, id), and the first
# ``8 * rounds`` bits of that order as a sortable value.
DRAWS = {
    "xxhash64": (
        lambda seed, perm, ident: F.xxhash64(F.lit(seed), perm, ident),
        lambda order, rounds: F.shiftright(order, 64 - _DIGIT * rounds) if rounds else F.lit(0).cast("long"),
        64 // _DIGIT,
    ),
    "md5": (
        lambda seed, perm, ident: F.md5(F.concat_ws(":", F.lit(seed), perm.cast("string"), ident)),
        lambda order, rounds: F.left(order, F.lit(_DIGIT // 4 * rounds)),
        128 // _DIGIT,
    ),
}


def partitions(spark: SparkSession) -> int:
    """Partitions for rows that are few now and repeated later: a fixed number, which Spark does not merge by size."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sums_by_level(rows: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys, "_level").agg(row_count().alias("_n_level"), *(F.sum(x).alias(x) for x in xs))


def permuted_sums(
    rows: DataFrame,
    by: Sequence[str],
    xs: Sequence[str],
    *,
    strata: bool,
    n_perm: int,
    seed: str,
    draw: str,
    whole_rows: int,
) -> DataFrame:
    """Rows and sums of ``xs`` per (``by``, ``_perm``, ``_level``), for ``n_perm`` permutations.

    ``rows`` holds ``by``, ``_stratum`` if levels stay inside strata, ``_id``,
    ``_level`` and ``xs``; it is read several times and should be a written table.
    Units of at most ``whole_rows`` rows are ranked as they are.
    """
    unit = [*by, *(["_stratum"] if strata else [])]
    dealt = dict(n_perm=n_perm, seed=seed, draw=draw)
    if not unit:
        return _selected(rows, _units(rows, unit), by, unit, xs, **dealt)
    parts = []
    if strata:
        pairs = cut_lineage(two_levels(rows, unit, xs, "_id").repartition(partitions(rows.sparkSession), *unit))
        simple = (F.col("_k") == 2) & (F.col("_first") < F.col("_last"))
        parts.append(_swapped(pairs.filter(simple), by, xs, **dealt))
        others = pairs.filter(~simple).select(*unit)
        rows = None if others.isEmpty() else cut_lineage(join_groups(rows, others, unit, "left_semi"))
    if rows is not None:
        units = cut_lineage(_units(rows, unit))
        parts.append(_ranked(rows, units.filter(F.col("_n") <= whole_rows), by, unit, xs, **dealt))
        large = units.filter(F.col("_n") > whole_rows)
        if not large.isEmpty():
            parts.append(_selected(rows, large, by, unit, xs, **dealt))
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.unionByName(part)
    if len(parts) > 1:
        sums = sums.groupBy(*by, "_perm", "_level").agg(
            F.sum("_n_level").alias("_n_level"), *(F.sum(x).alias(x) for x in xs)
        )
    return sums


def _units(rows: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Rows ``_n`` and, by level, the ranks ``lo`` (not included) to ``hi`` that it takes in each unit."""
    levels = rows.groupBy(*unit, "_level").agg(row_count().alias("_k"))
    entries = F.array_sort(F.collect_list(F.struct("_level", "_k"))).alias("_e")
    gathered = levels.groupBy(*unit).agg(entries) if unit else levels.agg(entries)

    def total(upto: Column) -> Column:
        part = F.slice("_e", F.lit(1), upto)
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, e: acc + e["_k"])

    ranges = F.transform(
        "_e",
        lambda e, i: F.struct(e["_level"].alias("level"), total(i).alias("lo"), total(i + 1).alias("hi")),
    )
    return gathered.select(*unit, ranges.alias("_levels"), total(F.size("_e")).alias("_n"))


def two_levels(rows: DataFrame, unit: Sequence[str], xs: Sequence[str], ident: str | None = None) -> DataFrame:
    """One row per unit: rows ``_k``, lowest and highest level, and the values at both (``_a``, ``_b``)."""
    held = [*xs, *([ident] if ident else [])]
    return rows.groupBy(*unit).agg(
        row_count().alias("_k"),
        F.min("_level").alias("_first"),
        F.max("_level").alias("_last"),
        *(F.min_by(x, "_level").alias(f"_a{x}") for x in held),
        *(F.max_by(x, "_level").alias(f"_b{x}") for x in held),
    )


def _permutations(n_perm: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("_perm")


def _swapped(pairs: DataFrame, by: Sequence[str], xs: Sequence[str], *, n_perm: int, seed: str, draw: str) -> DataFrame:
    """Units of two rows and two levels: the row that comes first in the order takes the lower level."""
    order = DRAWS[draw][0]
    repeated = pairs.select("*", _permutations(n_perm))
    key = {s: F.struct(order(seed, F.col("_perm"), F.col(f"{s}_id")), F.col(f"{s}_id")) for s in ("_a", "_b")}
    repeated = repeated.withColumn("_swap", key["_b"] < key["_a"])

    def side(level: str, kept: str, other: str) -> Column:
        values = (F.when(F.col("_swap"), F.col(other + x)).otherwise(F.col(kept + x)).alias(x) for x in xs)
        return F.struct(F.col(level).alias("_level"), *values)

    both = F.inline(F.array(side("_first", "_a", "_b"), side("_last", "_b", "_a")))
    return sums_by_level(repeated.select(*by, "_perm", both), [*by, "_perm"], xs)


def _ranked(
    rows: DataFrame, units: DataFrame, by: Sequence[str], unit: Sequence[str], xs: Sequence[str],
    *, n_perm: int, seed: str, draw: str,
) -> DataFrame:
    """Units of few rows: dealt out by unit once, then repeated and ranked inside the task."""
    # A join would sort all rows by unit first, those of large units too.
    few = (units.agg(F.sum(F.size("_levels"))).first()[0] or 0) <= _SMALL
    ready = join_groups(rows.drop("_level"), F.broadcast(units) if few else units, unit).drop("_n")
    ready = ready.repartition(partitions(rows.sparkSession), *unit)
    repeated = ready.select("*", _permutations(n_perm))
    repeated = repeated.withColumn("_order", DRAWS[draw][0](seed, F.col("_perm"), F.col("_id")))
    place = F.row_number().over(Window.partitionBy(*unit, "_perm").orderBy("_order", "_id"))
    placed = repeated.withColumn("_place", place)
    mine = F.filter("_levels", lambda r: (r["lo"] < F.col("_place")) & (F.col("_place") <= r["hi"]))
    return sums_by_level(placed.withColumn("_level", F.get(mine, F.lit(0))["level"]), [*by, "_perm"], xs)


def _selected(
    rows: DataFrame, units: DataFrame, by: Sequence[str], unit: Sequence[str], xs: Sequence[str],
    *, n_perm: int, seed: str, draw: str,
) -> DataFrame:
    """Units of any size: find the last row of each level by radix selection, then compare each row with them."""
    order, prefix, most = DRAWS[draw]
    bare = rows.drop("_level")
    at = [*unit, "_perm"]
    ends = units.select(*unit, F.explode("_levels").alias("_l"), "_n").filter(F.col("_l.hi") < F.col("_n"))
    few = ends.count() * n_perm <= _SMALL
    # One row per level end: the range of orders it lies in, and the rows before that range.
    start = prefix(F.lit("") if draw == "md5" else F.lit(0).cast("long"), 0)
    open_ = ends.select(
        *unit, _permutations(n_perm), F.col("_l.hi").alias("_rank"), F.lit(0).cast("long").alias("_before")
    ).withColumn("_range", start)

    def repeated(listed: DataFrame) -> DataFrame:
        """Every row once for each entry of its unit; rows are not shuffled to their unit where that can be avoided."""
        found = attach(bare, F.broadcast(listed) if few and unit else listed, unit)
        return found.select(*(c for c in found.columns if c != "_list"), F.inline("_list"))

    def inside(rounds: int) -> DataFrame:
        """Every row once for each permutation in which it lies in a range that holds a level end."""
        ranges = open_.groupBy(*at).agg(F.collect_set("_range").alias("ranges"))
        found = repeated(_listed(ranges, unit, F.struct("_perm", "ranges"))).select(*at, "_id", "ranges")
        found = found.withColumn("_order", order(seed, F.col("_perm"), F.col("_id")))
        found = found.withColumn("_range", prefix(F.col("_order"), rounds))
        return found.filter(F.array_contains("ranges", F.col("_range"))).drop("ranges")

    rounds, largest = 0, None
    while rounds < most and (largest is None or largest > _FEW):
        finer = prefix(F.col("_order"), rounds + 1)
        counted = inside(rounds).groupBy(*at, "_range", finer.alias("_next")).agg(row_count().alias("_k"))
        along = Window.partitionBy(*at, "_range").orderBy("_next")
        counted = counted.withColumn("_hi", F.sum("_k").over(along))
        reached = join_groups(open_.drop("_k"), counted, [*at, "_range"])
        until = F.col("_before") + F.col("_hi")
        reached = reached.filter((until - F.col("_k") < F.col("_rank")) & (F.col("_rank") <= until))
        open_ = cut_lineage(
            reached.select(*at, "_rank", (until - F.col("_k")).alias("_before"), F.col("_next").alias("_range"), "_k")
        )
        largest = open_.agg(F.max("_k")).first()[0] or 0
        rounds += 1
    place = F.row_number().over(Window.partitionBy(*at, "_range").orderBy("_order", "_id"))
    last = join_groups(open_.select(*at, "_range", "_rank", "_before"), inside(rounds).withColumn("_place", place), [*at, "_range"])
    last = last.filter(F.col("_before") + F.col("_place") == F.col("_rank")).select(
        *at, F.struct("_order", "_id").alias("_end")
    )
    # Units with a single level have no ends, but permutations like others.
    every = units.select(*unit, _permutations(n_perm)).withColumn("_end", F.lit(None).cast(last.schema["_end"].dataType))
    found = every.unionByName(last).groupBy(*at).agg(F.array_sort(F.collect_list("_end")).alias("_ends"))
    listed = attach(_listed(found, unit, F.struct("_perm", "_ends")), units.select(*unit, "_levels"), unit)
    # The hint to broadcast does not outlive a checkpoint, so it is given behind it.
    ready = repeated(cut_lineage(listed))
    # Behind a generator the hash is a value; else it would be computed again for each end.
    at_row = F.struct(order(seed, F.col("_perm"), F.col("_id")).alias("_order"), "_id")
    ready = ready.select("*", F.explode(F.array(at_row)).alias("_at"))
    mine = F.size(F.filter("_ends", lambda e: e < F.col("_at")))
    return sums_by_level(ready.withColumn("_level", F.get("_levels", mine)["level"]), [*by, "_perm"], xs)


def _listed(rows: DataFrame, unit: Sequence[str], entry: Column) -> DataFrame:
    """One row per unit with all its entries."""
    entries = F.collect_list(entry).alias("_list")
    return rows.groupBy(*unit).agg(entries) if unit else rows.agg(entries)
