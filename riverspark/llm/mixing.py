"""Mix sources to target weights: whole copies first, then Pareto order samples of fixed size in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverspark.session import cut_lineage

#: Bits of a rank, and of it per round of counting.
_BITS, _DIGIT = 52, 13
#: Tables of this many rows at most may be broadcast.
_SMALL = 100_000


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, draw`` per row: words ``[^\\x20\\x09-\\x0D]+`` and a random number that depends on the row alone.

    Rows alike in id, source and text are numbered, so each has its own draw.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("")).alias("text"),
    )
    alike = cut_lineage(rows.groupBy("doc_id", "source", "size", "text").agg(F.count("*").alias("rows")))
    # Few rows are alike as a rule; a great number of them is dealt out in blocks first.
    block = F.explode(F.expr("sequence(0L, rows - 1, 65536L)")).alias("from")
    many = alike.filter("rows > 65536").select("*", block).repartition("doc_id", "source", "text", "from")
    blocks = alike.filter("rows <= 65536").withColumn("from", F.lit(0).cast("long")).union(many)
    number = F.explode(F.expr("sequence(from, least(from + 65536, rows) - 1)")).alias("number")
    return blocks.select("doc_id", "source", "size", "text", number).select(
        "doc_id", "source", "size", F.md5(draw_key("doc_id", "text", "number").cast("binary")).alias("draw")
    )


def draw_key(doc_id: str, text: str, number: str) -> Column:
    return F.concat_ws(":", F.lit("mix"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text), F.col(number))


def weighted_sources(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """``source, source_size, weight``: sources by code point, NULL last, weigh ``weights``, repeating."""
    sources = cut_lineage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    order = [F.col("source").asc_nulls_last()]
    # Ranks in two steps: rows of each range of names, then places inside the range.
    dealt = cut_lineage(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("part").agg(F.count("*").alias("rows"))
    ranges = ranges.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    kinds = F.array(*(F.lit(w).cast("long") for w in weights))
    placed = dealt.join(ranges, "part").withColumn("place", place)
    return placed.select(
        "source", "source_size", F.element_at(kinds, (F.col("place") % len(weights) + 1).cast("int")).alias("weight")
    )


def targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """``source, source_size, target``: all words shared by weight; what lies over ``most`` times a source is shared anew.

    A source is either full or gets ``level`` per unit of weight; each round
    fills those that the last level overfills, until none is above.
    """
    sources = cut_lineage(sources)
    full = F.lit(most) * F.col("source_size")
    rest, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, level = rest or 0, 0.0
    while weight:
        level = rest / weight
        filled = F.col("weight") * F.lit(level) >= full
        taken, open_weight = sources.agg(
            F.sum(F.when(filled, full).otherwise(0)), F.sum(F.when(~filled, F.col("weight")).otherwise(0))
        ).first()
        if open_weight == weight:
            break
        rest, weight = total - taken, open_weight
    return sources.select(
        "source", "source_size", F.least(full.cast("double"), F.col("weight") * F.lit(float(level))).alias("target")
    )


def _small(table: DataFrame) -> DataFrame:
    """``table``, broadcast where it is known to be small; beyond that Spark joins by key and splits hot ones."""
    return F.broadcast(table) if table.count() <= _SMALL else table


def _last_taken(rows: DataFrame, budgets: DataFrame, few: int = 2_000) -> DataFrame:
    """``source, last_rank, last_draw``: the last row each source's budget reaches, in order of (rank, draw).

    A row is reached if the words before it and half its own fit.  Words are
    counted by the leading digits of the rank, and only the rows of the one range
    in which a budget ends are counted by further digits; at last they are
    sorted, at most about ``few`` of a source.
    """
    ends = budgets.select("source", F.lit(0).cast("long").alias("lead"), F.lit(0).cast("long").alias("before"), "budget")
    shift = _BITS
    while True:
        joined = rows.join(_small(ends), rows.source.eqNullSafe(ends.source) & (F.shiftright(rows["rank"], shift) == ends.lead))
        inside = joined.select(rows.source.alias("source"), "rank", "draw", "size", "before", "budget")
        most = inside.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most <= few or shift == 0:
            break
        shift = max(0, shift - _DIGIT)
        counted = inside.groupBy("source", "before", "budget", F.shiftright("rank", shift).alias("lead")).agg(
            F.sum("size").alias("words")
        )
        up_to = F.sum("words").over(Window.partitionBy("source").orderBy("lead"))
        counted = counted.withColumn("until", F.col("before") + up_to)
        reached = (F.col("until") - F.col("words") <= F.col("budget"))
        # The range in which the budget ends: the last one that begins inside it.
        last = counted.filter(reached).groupBy("source").agg(
            F.max(F.struct("lead", (F.col("until") - F.col("words")).alias("start"), "budget")).alias("end")
        )
        ends = cut_lineage(last.select("source", "end.lead", F.col("end.start").alias("before"), "end.budget"))
    up_to = F.col("before") + F.sum("size").over(
        Window.partitionBy("source").orderBy("rank", "draw").rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = inside.withColumn("until", up_to)
    # With no row of the range reached, all rows before the range are.
    start = F.shiftleft(F.col("lead"), shift) - 1
    base = ends.select("source", start.alias("last_rank"), F.lit("g").alias("last_draw"))
    reached = placed.filter(2 * F.col("until") - F.col("size") <= 2 * F.col("budget"))
    reached = reached.select("source", F.col("rank").alias("last_rank"), F.col("draw").alias("last_draw"))
    last = base.union(reached).groupBy("source").agg(F.max(F.struct("last_rank", "last_draw")).alias("last"))
    return cut_lineage(last.select("source", "last.*"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken``: how often each document enters the mix.

    ``size`` is the number of words (NULL text: 0), ``target`` the words its
    source should give (``targets``).  Every document of a source enters
    floor(target / source_size) times for certain; one copy more goes to those
    whose random odds divided by the odds of the rest of that quotient are
    smallest, until the words taken come as near to the target as whole documents
    allow: half the size of one document at most.  Draws depend on id, text and
    the number among equal rows, so reruns agree whatever the partitions.  Rows
    without id or source are documents like others, NULL sources are one source,
    the last; a source without words has target 0; an empty table gives no rows.
    Other columns are not read.
    """
    sizes = cut_lineage(word_sizes(docs, id_col, text_col, source_col))
    goals = targets(weighted_sources(sizes, weights), most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("copies", F.least(copies, F.lit(most)).cast("long"))
    goals = goals.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    chance = F.when(F.col("budget") > 0, F.col("budget") / F.col("source_size"))
    goals = cut_lineage(goals.withColumn("chance", chance))
    partial = goals.filter("chance is not null")
    ranked = sizes.withColumnRenamed("source", "own").join(_small(partial), F.col("own").eqNullSafe(F.col("source")))
    ranked = ranked.select("source", "draw", "size", pareto_rank("draw", "chance").alias("rank"))
    last = _last_taken(ranked, partial.select("source", "budget"))
    plan = goals.withColumnRenamed("source", "name").join(last, F.col("name").eqNullSafe(F.col("source")), "left").drop("source")
    rank = pareto_rank("draw", "chance")
    extra = (rank < F.col("last_rank")) | ((rank == F.col("last_rank")) & (F.col("draw") <= F.col("last_draw")))
    number = F.col("copies") + F.when(extra, 1).otherwise(0)
    return sizes.join(_small(cut_lineage(plan)), F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        number.alias("copies"),
        (F.col("size") * number).alias("taken"),
    )


def pareto_rank(draw: str, chance: str) -> Column:
    """Rank of random odds over inclusion odds, as a whole number below 2^52; NULL where nothing is drawn."""
    random = (F.conv(F.substring(draw, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**48)
    ratio = random / (1 - random) / (F.col(chance) / (1 - F.col(chance)))
    return F.least(F.floor(ratio / (1 + ratio) * F.lit(2.0**_BITS)), F.lit(2**_BITS - 1))
