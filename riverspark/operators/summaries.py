"""Order statistics, box summaries, class shares, densities and convex hulls."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverspark.columns import as_list, join_groups
from riverspark.functions import row_count
from riverspark.session import cut_lineage


#: Tables of so few groups may be broadcast.
_FEW_GROUPS = 10_000


def _per_group(groups: DataFrame) -> DataFrame:
    """A table of a few rows per group, written once.

    Where groups are few it is broadcast: a join would sort all rows of a group in one task.
    """
    groups = cut_lineage(groups)
    return F.broadcast(groups) if groups.count() <= _FEW_GROUPS else groups


def exact_quantiles(
    df: DataFrame,
    group: str | Iterable[str],
    value: str,
    probs: Sequence[float],
    accuracy: int = 10_000,
    reuse: bool = True,
) -> DataFrame:
    """Exact interpolated quantiles per group, as an array column ``quantiles``.

    Works for groups of any size.  Approximate quantiles bracket each wanted rank;
    counting the value ranges between the brackets tells which ranges hold the
    ranks; only those ranges, each about 4 / ``accuracy`` of a group, are ordered.
    NULL and NaN are left out.  All passes must see equal values, and sums of
    floating-point numbers may differ between runs, so the groups and values are
    written once; ``reuse=False`` is for input that is stored already.
    """
    keys = as_list(group)
    margin = 2.0 / accuracy
    steps = sorted({min(max(p + side * margin, 0.0), 1.0) for p in probs for side in (-1, 1)})
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    rows = cut_lineage(rows) if reuse else rows
    # One row per group, with arrays whose length the arguments fix.
    brackets = _per_group(
        rows.groupBy(*keys).agg(
            row_count().alias("_n"),
            F.array_distinct(F.percentile_approx("_v", steps, accuracy)).alias("_cuts"),
        )
    )
    ranged = join_groups(rows, brackets, keys).select(
        *keys, "_n", "_v", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_range")
    )
    sizes = ranged.groupBy(*keys, "_n", "_range").agg(row_count().alias("_size"))
    # At most one row per bracket and group.
    along = Window.partitionBy(*keys).orderBy("_range")
    ranks = F.array(
        *(
            e
            for p in probs
            for e in (F.floor((F.col("_n") - 1) * p) + 1, F.ceil((F.col("_n") - 1) * p) + 1)
        )
    )
    located = _per_group(
        sizes.withColumn("_hi", F.sum("_size").over(along))
        .withColumn("_lo", F.col("_hi") - F.col("_size"))
        .withColumn(
            "_wanted",
            F.filter(
                F.array_distinct(ranks), lambda r: (F.col("_lo") < r) & (r <= F.col("_hi"))
            ),
        )
        .filter(F.size("_wanted") > 0)
        .select(*keys, "_range", "_lo", "_wanted")
    )
    # Equal values are counted together, so ties never pile up in the window.
    counted = (
        join_groups(ranged, located.select(*keys, "_range"), [*keys, "_range"], "left_semi")
        .groupBy(*keys, "_n", "_range", "_v")
        .agg(row_count().alias("_k"))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("_v")
    found = (
        join_groups(counted, located, [*keys, "_range"])
        .withColumn("_to", F.col("_lo") + F.sum("_k").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_k"))
        .withColumn(
            "_hit", F.filter("_wanted", lambda r: (F.col("_from") < r) & (r <= F.col("_to")))
        )
        .select(*keys, "_n", "_v", F.explode("_hit").alias("_rank"))
    )
    by_rank = found.groupBy(*keys, "_n").agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")
    )

    def interpolate(p: float) -> Column:
        place = (F.col("_n") - 1) * p
        low = F.element_at("_at", F.floor(place) + 1)
        high = F.element_at("_at", F.ceil(place) + 1)
        return low + (high - low) * (place - F.floor(place))

    return by_rank.select(
        *keys, F.col("_n").alias("n"), F.array(*(interpolate(p) for p in probs)).alias("quantiles")
    )


def box_summary(df: DataFrame, group: str | Iterable[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, and whiskers at the last values within ``reach`` box lengths."""
    keys = as_list(group)
    df = cut_lineage(df.select(*keys, value))
    quartiles = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75], reuse=False).select(
        *keys,
        "n",
        *(F.get("quantiles", F.lit(i)).alias(c) for i, c in enumerate(("q1", "median", "q3"))),
    )
    spread = (F.col("q3") - F.col("q1")) * reach
    inside = F.col(value).between(F.col("q1") - spread, F.col("q3") + spread)
    return (
        join_groups(df, _per_group(quartiles), keys)
        .groupBy(*keys, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("lower"),
            F.max(F.when(inside, F.col(value))).alias("upper"),
        )
    )


def class_shares(df: DataFrame, group: str | Iterable[str], class_col: str) -> DataFrame:
    """Rows, share of the group and number of classes per group and class."""
    keys = as_list(group)
    counts = df.groupBy(*keys, class_col).agg(row_count().alias("n"))
    # One row per class is left here.
    whole = Window.partitionBy(*keys)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(whole)).withColumn(
        "n_classes", F.count(class_col).over(whole)
    )


def density_grid(
    df: DataFrame,
    group: str | Iterable[str],
    value: str,
    points: int = 512,
    bandwidth: float | None = None,
) -> DataFrame:
    """Gaussian kernel density per group on a grid over the group's range.

    The default bandwidth is 0.9 min(sd, IQR / 1.34) n^(-1/5) per group.  Values are
    binned linearly: each counts at its two neighbouring grid points, in proportion
    to its nearness.  The density is that of the bins, so rows are aggregated to at
    most ``points`` bins per group before any kernel is evaluated.  Groups without
    spread have no density and no rows.
    """
    keys = as_list(group)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).dropna(subset=["_v"])
    rows = cut_lineage(rows)
    frame = rows.groupBy(*keys).agg(
        row_count().alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.stddev_samp("_v").alias("_sd"),
    )
    if bandwidth is None:
        iqr = exact_quantiles(rows, keys, "_v", [0.25, 0.75], reuse=False).select(
            *keys, (F.get("quantiles", F.lit(1)) - F.get("quantiles", F.lit(0))).alias("_iqr")
        )
        width = 0.9 * F.least(F.col("_sd"), F.col("_iqr") / 1.34) * F.pow(F.col("_n"), F.lit(-0.2))
        frame = join_groups(frame, iqr, keys).withColumn("_h", width)
    else:
        frame = frame.withColumn("_h", F.lit(float(bandwidth)))
    frame = _per_group(frame.filter("_h > 0 AND _max > _min").drop("_sd"))
    step = (F.col("_max") - F.col("_min")) / (points - 1)
    place = (F.col("_v") - F.col("_min")) / step
    low = F.least(F.floor(place), F.lit(points - 1)).cast("int")
    halves = F.array(
        F.struct(low.alias("bin"), (1 - (place - low)).alias("w")),
        F.struct((low + 1).alias("bin"), (place - low).alias("w")),
    )
    bins = (
        join_groups(rows, frame, keys)
        .select(*keys, "_n", "_h", "_min", "_max", F.inline(halves))
        .filter("w > 0")
        .groupBy(*keys, "_n", "_h", "_min", "_max", "bin")
        .agg(F.sum("w").alias("w"))
    )
    u = (F.col("point") - F.col("bin")) * step / F.col("_h")
    height = F.sum(F.col("w") * F.exp(-0.5 * u * u))
    return (
        bins.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy(*keys, "point", (F.col("_min") + step * F.col("point")).alias("x"), "_n", "_h")
        .agg(height.alias("_k"))
        .select(
            *keys,
            "point",
            "x",
            (F.col("_k") / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"),
        )
    )


_COMPASS = np.array([[1, 0], [1, 1], [0, 1], [-1, 1], [-1, 0], [-1, -1], [0, -1], [1, -1]])


def _drop_inner(points: np.ndarray) -> np.ndarray:
    """Leave out points well inside the polygon of the outermost points in eight directions."""
    corners = points[(points @ _COMPASS.T).argmax(axis=0)]
    sides = np.roll(corners, -1, axis=0) - corners
    real = (sides != 0).any(axis=1)
    inner = np.full(len(points), real.sum() >= 3)
    for corner, side in zip(corners[real], sides[real]):
        inner &= side[0] * (points[:, 1] - corner[1]) - side[1] * (points[:, 0] - corner[0]) > 0
    return points[~inner]


def _hull(points: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull, counter-clockwise, collinear points left out."""
    points = np.unique(_drop_inner(points), axis=0)
    if len(points) < 3:
        return points

    def half(ordered: np.ndarray) -> list[np.ndarray]:
        chain: list[np.ndarray] = []
        for p in ordered:
            while len(chain) > 1:
                a, b = chain[-1] - chain[-2], p - chain[-2]
                if a[0] * b[1] - a[1] * b[0] > 0:
                    break
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(half(points) + half(points[::-1]))


def convex_hull(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Hull vertices per group in counter-clockwise order.

    Each task first reduces its own rows to the hulls of the groups it sees, so only
    hull vertices are shuffled and one group never has to fit into one task.  The
    hull of partial hulls is the hull of all points.
    """
    kind = df.schema[group].dataType
    narrow = T.StructType(
        [
            T.StructField("_g", kind),
            T.StructField("_x", T.DoubleType()),
            T.StructField("_y", T.DoubleType()),
        ]
    )
    out = T.StructType(
        [
            T.StructField(group, kind),
            T.StructField("seq", T.IntegerType()),
            T.StructField(x, T.DoubleType()),
            T.StructField(y, T.DoubleType()),
        ]
    )

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def flush() -> pd.DataFrame:
            frames = [
                pd.DataFrame({"_g": g, "_x": p[:, 0], "_y": p[:, 1]}) for g, p in held.items()
            ]
            held.clear()
            return pd.concat(frames, ignore_index=True)

        for batch in batches:
            for g, part in batch.groupby("_g", sort=False):
                points = part[["_x", "_y"]].to_numpy()
                if g in held:
                    points = np.vstack([held[g], points])
                held[g] = _hull(points)
            if len(held) > 10_000:
                yield flush()
        if held:
            yield flush()

    def final(part: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(part[["_x", "_y"]].to_numpy())
        return pd.DataFrame(
            {
                group: part["_g"].iloc[0],
                "seq": np.arange(len(hull), dtype=np.int32),
                x: hull[:, 0],
                y: hull[:, 1],
            }
        )

    rows = df.select(
        F.col(group).alias("_g"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    ).dropna()
    return rows.mapInPandas(partial, narrow).groupBy("_g").applyInPandas(final, out)
