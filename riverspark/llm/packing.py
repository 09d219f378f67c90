"""Packing of documents into fixed windows by non-negative least squares on the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverspark.llm.common import column, slices, texts
from riverspark.llm.tokens import coder
from riverspark.session import cut_lineage

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(
    docs: DataFrame,
    window: int = 2048,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Token pieces of at most ``window`` ids: full windows from the front, then the rest.

    Each text (NULL counts as empty) is encoded whole and ``end_id`` added.
    Columns as in ``PIECES``, and ``ids`` when asked for.
    """

    def cut(key: list, ids: list[bytes]) -> Iterator[tuple]:
        for doc, data in zip(key, ids):
            data += end_id.to_bytes(4, "little")
            total = len(data) // 4
            for start in range(0, total, window):
                piece = data[4 * start : 4 * (start + window)]
                row = (doc, start, len(piece) // 4, zlib.crc32(piece), total)
                yield (*row, np.frombuffer(piece, "<i4")) if with_ids else row

    kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = list(cut(part.column(0).to_pylist(), coder(tokenizer).encode(column(part, "text"))))
                arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return texts(docs, id_col, text_col).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def shallow_patterns(present: np.ndarray, full: int) -> list[tuple[int, ...]]:
    """Combinations of up to three of the sizes ``present`` that fill ``full`` exactly."""
    have = set(present.tolist())
    found = [(full,)] if full in have else []
    found += [(a, full - a) for a in have if 2 * a >= full > a and full - a in have]
    for a in have:
        found += [(a, b, full - a - b) for b in have if b <= a and 0 < full - a - b <= b and full - a - b in have]
    return sorted(found, reverse=True)


def nnls(matrix: np.ndarray, target: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson)."""
    n = matrix.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * n):
        gain = np.where(free, -np.inf, matrix.T @ (target - matrix @ x))
        best = int(gain.argmax()) if n else 0
        if not n or gain[best] <= tolerance:
            break
        free[best] = True
        while True:
            rows = np.flatnonzero(free)
            part = matrix[:, rows]
            try:
                trial = np.linalg.solve(part.T @ part, part.T @ target)
            except np.linalg.LinAlgError:
                trial = np.linalg.lstsq(part, target, rcond=None)[0]
            if trial.min(initial=1) > 0:
                x[:] = 0
                x[rows] = trial
                break
            down = rows[trial <= 0]
            step = np.min(x[down] / (x[down] - trial[trial <= 0] + 1e-300))
            x[rows] += step * (trial - x[rows])
            gone = rows[x[rows] <= 1e-12]
            free[gone], x[gone] = False, 0
            if not len(gone):
                free[best] = False
                return x
    return x


def plan(sizes: dict[int, int], full: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of sizes and how often each is used; together they use every piece once.

    ``sizes`` counts the pieces of each size 1..full.  Repeat counts of the
    shallow patterns solve least squares against the histogram and are rounded
    down to what is there; what remains is packed largest first, each gap taking
    the largest size that fits.
    """
    left = np.zeros(full + 1, np.int64)
    for size, count in sizes.items():
        left[size] = count
    out = []
    patterns = shallow_patterns(np.flatnonzero(left), full)
    if patterns:
        matrix = np.zeros((full + 1, len(patterns)))
        for number, pattern in enumerate(patterns):
            np.add.at(matrix[:, number], list(pattern), 1)
        scale = left.max()
        repeats = nnls(matrix, left / scale) * scale
        for number in np.argsort(-repeats, kind="stable"):
            need = matrix[:, number].astype(np.int64)
            used = need > 0
            times = min(int(np.floor(repeats[number] + 1e-6)), int((left[used] // need[used]).min()))
            if times > 0:
                left -= times * need
                out.append((patterns[number], times))
    while left.any():
        gap, pattern = full, []
        spare = left.copy()
        while True:
            fits = np.flatnonzero(spare[: gap + 1])
            if not len(fits):
                break
            size = int(fits[-1])
            take = min(int(spare[size]), gap // size)
            pattern += [size] * take
            spare[size] -= take
            gap -= take * size
        kinds, need = np.unique(pattern, return_counts=True)
        times = int((left[kinds] // need).min())
        left[kinds] -= times * need
        out.append((tuple(pattern), times))
    return out


def pack(rows: DataFrame, window: int = 2048, grain: int = 8, crowd: int = 2000) -> DataFrame:
    """Give every piece a ``sequence_id`` and an ``offset`` in it.

    ``rows`` has ``doc_id``, ``start`` and ``length`` (1 to ``window``), and any
    other columns.  Sequences hold at most ``window`` tokens without gaps.

    Lengths are rounded up to ``grain`` for the plan, so the driver sees at most
    window / grain counts and returns as many segments of ranks, whatever the
    table holds.  Pieces of one size are ranked in buckets of about ``crowd``
    rows, and the buckets one after the other.  Pieces of one size may trade
    places only if all their columns agree, so a lost task changes nothing.
    """
    full = -(-window // grain)
    rows = cut_lineage(rows.withColumn("_size", F.ceil(F.col("length") / grain).cast("int")))
    sizes = {r["_size"]: r["n"] for r in rows.groupBy("_size").agg(F.count("*").alias("n")).collect()}
    # One segment of ranks of a size fills one slot of one pattern.
    next_rank = dict.fromkeys(sizes, 0)
    segments, sequence = [], 0
    for pattern, times in plan(sizes, full):
        for slot, size in enumerate(pattern):
            segments.append((size, next_rank[size], sequence, slot))
            next_rank[size] += times
        sequence += times
    segments.sort()
    size, low, first, slot = np.array(segments, np.int64).reshape(-1, 4).T
    begin = np.searchsorted(size, np.arange(full + 2))

    def place(batches):
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("_size")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            at = np.zeros(len(own), np.int64)
            for s in np.unique(own):
                mine = own == s
                part = slice(begin[s], begin[s + 1])
                at[mine] = begin[s] + np.searchsorted(low[part], rank[mine], side="right") - 1
            arrays = [pa.array(first[at] + rank - low[at]), pa.array(slot[at])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *arrays], [*batch.schema.names, "sequence_id", "_slot"]
            )

    buckets = max(1, -(-sum(sizes.values()) // crowd))
    rest = [c for c in rows.columns if c not in ("doc_id", "start", "_size", "ids")]
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = rows.groupBy("_size", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_size", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_size", "_bucket").orderBy("doc_id", "start", *rest)
    ranked = rows.withColumn("_row", F.row_number().over(inside)).join(counts, ["_size", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_row") - 1).drop("_row", "_before", "_bucket")
    schema = ", ".join(f"`{n}` {t}" for n, t in ranked.dtypes) + ", sequence_id long, _slot long"
    placed = ranked.mapInArrow(place, schema).drop("_size", "_rank")
    within = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).drop("_slot")


def pack_documents(
    docs: DataFrame,
    window: int = 2048,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents with their place: ``PIECES``, ``sequence_id``, ``offset`` and the ids if asked for.

    NULL and empty texts become one piece of ``end_id`` alone; repeated rows are
    packed as often as they occur; an empty table gives no rows.
    """
    cut = pieces(docs, window, tokenizer, end_id, with_ids, id_col, text_col)
    return pack(cut, window)
