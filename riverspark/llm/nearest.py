"""Nearest neighbours by few stable projections, a kd-tree on them, and a chi-square stopping test."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverspark.llm.common import bounded_sample
from riverspark.session import cut_lineage

PROJECTIONS = 16
_LEAF = 32
_STEP = 32  # points verified before the stopping test is first asked; then twice as many each time


def projection(size: int, seed: int = 42) -> np.ndarray:
    """Gaussian (2-stable) projections: squared projected distance over squared distance is chi-square."""
    return np.random.default_rng([seed, size]).standard_normal((size, PROJECTIONS))


def chi_square(x: np.ndarray | float) -> np.ndarray | float:
    """Distribution function with ``PROJECTIONS`` degrees of freedom, an even number."""
    half = np.asarray(x) / 2
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(PROJECTIONS // 2))


def quantile(sure: float) -> float:
    """Where ``chi_square`` reaches ``sure``; infinite for 1."""
    if sure >= 1:
        return math.inf
    low, high = 0.0, 1000.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle) < sure else (low, middle)
    return high


def _bound(limit: float, far: float, point: np.ndarray) -> float:
    """Squared projected distance beyond which the search for points within ``far`` ends.

    Equal vectors are projected in different batches, so a rounding error is allowed for.
    """
    return (limit * far * far if far > 0 else 0.0) + 1e-24 * float(point @ point)


def _gaps(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distance from a point to boxes; 0 where numbers overflow, so that nothing is lost."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((np.maximum(0, np.maximum(low - point, point - high)) ** 2).sum(axis=1), nan=0.0, posinf=np.inf)


@dataclass
class Cells:
    """A kd-tree over projected space whose leaves are cells; node i has children 2i + 1 and 2i + 2."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray  # corners of each cell
    high: np.ndarray

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        rows = np.arange(len(points))
        for _ in range(int(np.log2(len(self.axis) + 1))):
            node = 2 * node + 1 + (points[rows, self.axis[node]] > self.cut[node])
        return node - len(self.axis)

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared projected distance from a point to every cell."""
        return _gaps(self.low, self.high, point)


def fit_cells(sample: np.ndarray, depth: int) -> Cells:
    """Split at medians of the widest axis, ``depth`` times."""
    inner = 2**depth - 1
    axis, cut = np.zeros(inner, np.int64), np.zeros(inner)
    low = np.full((2 * inner + 1, PROJECTIONS), -np.inf)
    high = np.full((2 * inner + 1, PROJECTIONS), np.inf)
    rows = {0: sample}
    for node in range(inner):
        part = rows.pop(node)
        axis[node] = np.ptp(part, axis=0).argmax() if len(part) else 0
        cut[node] = np.median(part[:, axis[node]]) if len(part) else 0.0
        right = part[:, axis[node]] > cut[node]
        rows[2 * node + 1], rows[2 * node + 2] = part[~right], part[right]
        for child in (2 * node + 1, 2 * node + 2):
            low[child], high[child] = low[node], high[node]
        high[2 * node + 1, axis[node]] = cut[node]
        low[2 * node + 2, axis[node]] = cut[node]
    return Cells(axis, cut, low[inner:], high[inner:])


class Tree:
    """kd-tree over the projected points of one chunk: leaves of about ``_LEAF`` points and their boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        pending, order, ends = [np.arange(len(ids))], [], []
        while pending:
            rows = pending.pop()
            if len(rows) <= _LEAF:
                order.append(rows)
                ends.append(len(rows))
                continue
            part = points[rows]
            ranked = rows[np.argpartition(part[:, np.ptp(part, axis=0).argmax()], len(rows) // 2)]
            pending += [ranked[: len(rows) // 2], ranked[len(rows) // 2 :]]
        order = np.concatenate(order)
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.ends = np.cumsum(ends)
        self.starts = self.ends - ends
        self.low = np.minimum.reduceat(self.points, self.starts)
        self.high = np.maximum.reduceat(self.points, self.starts)
        self.verified = 0

    def nearest(self, own: int, vector: np.ndarray, point: np.ndarray, k: int, within: float, limit: float):
        """Up to ``k`` nearest ids and distances, but none beyond ``within``.

        Points come in order of their projected distance r: leaves are opened by the
        distance of their boxes, and an opened point waits until no unopened leaf can
        hold a nearer one.  A point nearer than the k-th distance d found so far projects
        beyond r with a probability of 1 - chi_square(r^2 / d^2) at most; the search ends
        when r^2 / d^2 is over ``limit``, the quantile of the wanted certainty.
        """
        gaps = _gaps(self.low, self.high, point)
        order = np.argsort(gaps, kind="stable")
        gaps = np.r_[gaps[order], np.inf]
        ids, found = np.zeros(0, np.int64), np.zeros(0)
        waiting, apart = np.zeros(0, np.int64), np.zeros(0)
        at, width, step, bound = 0, 4, _STEP, _bound(limit, within, point)
        while at < len(order) and not gaps[at] > bound:
            opened = order[at : at + width]
            at, width = at + len(opened), 4 * width
            rows = np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in opened])
            rows = rows[self.ids[rows] != own]
            with np.errstate(over="ignore", invalid="ignore"):
                shown = np.nan_to_num(((self.points.take(rows, axis=0) - point) ** 2).sum(axis=1), nan=0.0, posinf=np.inf)
            waiting, apart = np.r_[waiting, rows], np.r_[apart, shown]
            ranked = np.argsort(apart, kind="stable")
            waiting, apart = waiting[ranked], apart[ranked]
            done = 0
            while True:
                ready = np.searchsorted(apart, min(bound, gaps[at]), side="right")
                if done >= ready:
                    break
                rows = waiting[done : min(ready, done + step)]
                done, step = done + len(rows), 2 * step
                self.verified += len(rows)
                diff = self.vectors.take(rows, axis=0)
                diff -= vector
                diff *= diff
                far = np.sqrt(diff.sum(axis=1))
                near = far <= (found[k - 1] if len(found) >= k else within)
                if near.any():
                    ids, found = np.r_[ids, self.ids[rows][near]], np.r_[found, far[near]]
                    best = np.lexsort((ids, found))[:k]
                    ids, found = ids[best], found[best]
                    if len(found) >= k:
                        bound = _bound(limit, min(within, found[k - 1]), point)
            waiting, apart = waiting[done:], apart[done:]
        return ids, found


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return rows.filter(f"vec_id is not null and v is not null and {finite} and exists(v, x -> x != 0)")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_size(batch: pa.RecordBatch, column: str):
    """(size, sub-batch) for each vector length in a batch."""
    sizes = pc.list_value_length(batch.column(batch.schema.get_field_index(column))).to_numpy()
    for size in np.unique(sizes):
        yield int(size), batch.filter(pa.array(sizes == size))


def _place(rows: DataFrame, trees: dict[int, tuple[int, Cells]]) -> DataFrame:
    """Add the cell number of each vector."""

    def run(batches):
        for batch in batches:
            for size, part in _by_size(batch, "v"):
                base, cells = trees[size]
                cell = base + cells.of(_matrix(part.column(1)) @ projection(size))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell)], ["vec_id", "v", "cell"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, cell long")


def _search(points: DataFrame, asked: DataFrame, k: int, limit: float) -> DataFrame:
    """The ``k`` nearest of each chunk for the queries sent to it.

    ``points`` has ``chunk``, ``vec_id``, ``v``; ``asked`` has the same and
    ``within``.  In each chunk points come first, then queries one batch after
    the other, so memory holds one chunk and one batch.
    """

    def run(batches):
        chunk, held, tree = None, [], None
        for batch in batches:
            keys, query = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(query) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(keys)]):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                if keys[start] != chunk:
                    chunk, held, tree = keys[start], [], None
                if not query[start]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if tree is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    vectors = _matrix(table.column("v").chunk(0))
                    tree = Tree(table.column("vec_id").to_numpy(), vectors, vectors @ projection(vectors.shape[1]))
                ids, vectors, within = part.column(2).to_numpy(), _matrix(part.column(3)), part.column(4).to_numpy()
                shown = vectors @ projection(vectors.shape[1])
                found = [tree.nearest(*row, k, far, limit) for *row, far in zip(ids, vectors, shown, within)]
                many = [len(near) for near, _ in found]
                if sum(many):
                    arrays = [np.repeat(ids, many), *(np.concatenate(x) for x in zip(*found))]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["query_id", "vec_id", "score"])

    both = points.select("chunk", F.lit(0).alias("query"), "vec_id", "v", F.lit(0.0).alias("within")).union(
        asked.select("chunk", F.lit(1).alias("query"), "vec_id", "v", "within")
    )
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", "query")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    sure: float = 0.985,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    chunk_rows: int = 4096,
    sample_rows: int = 5000,
    most_cells: int = 4096,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: Euclidean neighbours of every query, nearest first.

    Ties go to the smaller vec_id.  Each true neighbour is missed with a
    probability of 1 - ``sure`` at most.  All vectors are indexed; only the cuts
    between cells are fitted on a sample of ``sample_rows`` (smallest id hashes).

    Of equal vectors only the ``k`` + 1 smallest ids take part, as no answer can
    need more.  A cell is searched in chunks of about ``chunk_rows``.  A query
    first searches its own cell; its k-th distance then decides, by the same
    test, which other cells it visits and which of their points it verifies.  Vectors that are NULL, empty, zero or
    hold NULL or non-finite components, and rows without id, take no part;
    neighbours have the query's length and another vec_id; with fewer than ``k``
    candidates all are returned.  Rows that repeat id and vector count once; an id
    with several vectors is a candidate with each of them, and asks with the
    smallest one in array order, whatever the order of rows.
    """
    spark = vectors.sparkSession
    limit = quantile(sure)
    copies = Window.partitionBy("v").orderBy("vec_id")
    points = usable(vectors, id_col, vector_col).distinct()
    points = points.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= k + 1).drop("_n")
    points = cut_lineage(points)
    asked = usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = {r["s"]: r["n"] for r in points.groupBy(F.size("v").alias("s")).agg(F.count("*").alias("n")).collect()}
    sample = bounded_sample(points, ["vec_id"], sample_rows).toArrow().combine_chunks()
    shown = {
        size: _matrix(part.column(1)) @ projection(size)
        for batch in sample.to_batches()
        for size, part in _by_size(batch, "v")
    }
    trees, base = {}, 0
    for size, n in sorted(sizes.items()):
        room = min(most_cells, max(1, len(shown.get(size, ())) // 4), -(-n // chunk_rows))
        cells = fit_cells(shown.get(size, np.zeros((0, PROJECTIONS))), int(np.log2(room)))
        trees[size] = (base, cells)
        base += len(cells.low)
    placed = cut_lineage(_place(points, trees))
    held = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    count = np.array([-(-held.get(cell, 0) // chunk_rows) for cell in range(base)], np.int64)
    first = np.cumsum(count) - count
    sent = spark.sparkContext.broadcast((trees, first, count))

    def chunks(batches):
        _, first, count = sent.value
        for batch in batches:
            cell, ids = batch.column(2).to_numpy(), batch.column(0).to_numpy().view(np.uint64)
            part = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % count[cell].astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(first[cell] + part.astype(np.int64)), *batch.columns[:2]], ["chunk", "vec_id", "v"]
            )

    def visits(own: bool):
        def run(batches):
            trees, first, count = sent.value
            for batch in batches:
                for size, part in _by_size(batch, "v"):
                    if size not in trees:
                        continue
                    base, cells = trees[size]
                    shown = _matrix(part.column(1)) @ projection(size)
                    home = cells.of(shown)
                    rows, chunk = [], []
                    for i, far in enumerate(part.column(2).to_numpy()):
                        if own:
                            go = home[i : i + 1]
                        else:
                            gaps = cells.gaps(shown[i])
                            go = gaps <= _bound(limit, far, shown[i])
                            go[home[i]] = False
                            go = np.flatnonzero(go)
                        for cell in (base + go).tolist():
                            chunk += range(first[cell], first[cell] + count[cell])
                        rows += [i] * (len(chunk) - len(rows))
                    taken = part.take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(chunk, pa.int64()), *taken.columns], ["chunk", "vec_id", "v", "within"]
                    )

        return run

    dealt = placed.mapInArrow(chunks, "chunk long, vec_id long, v array<double>")
    schema = "chunk long, vec_id long, v array<double>, within double"
    far = F.lit(float("inf")).alias("within")
    home = _search(dealt, asked.select("vec_id", "v", far).mapInArrow(visits(True), schema), k, limit)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    home = cut_lineage(home.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"))
    reach = home.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("d"))
    reach = reach.filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "d")
    onward = asked.join(reach, "vec_id", "left").select("vec_id", "v", F.coalesce("d", F.lit(float("inf"))).alias("within"))
    away = _search(dealt, onward.mapInArrow(visits(False), schema), k, limit)
    ranked = home.union(away).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
