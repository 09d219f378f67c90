"""Vector codes: product quantisation in whole numbers, entries searched by Walsh-Hadamard coefficients."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.llm.common import slices
from riverspark.session import cut_lineage


def sequency_order(size: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix by number of sign changes: bit-reversed Gray codes."""
    bits = size.bit_length() - 1
    at = np.arange(size)
    gray = at ^ (at >> 1)
    return sum(((gray >> b) & 1) << (bits - 1 - b) for b in range(bits)) if bits else at


def walsh_hadamard(values: np.ndarray) -> np.ndarray:
    """Integer transform of the last axis, zero-padded to a power of two, in sequency order.

    Squared differences of two transforms add up to the padded length times the
    squared distance.
    """
    length = values.shape[-1]
    size = 1 << max(0, (length - 1).bit_length())
    out = np.zeros((*values.shape[:-1], size), np.int64)
    out[..., :length] = values
    width = 1
    while width < size:
        pairs = out.reshape(*values.shape[:-1], size // (2 * width), 2, width)
        a, b = pairs[..., 0, :], pairs[..., 1, :]
        out = np.stack([a + b, a - b], axis=-2).reshape(out.shape)
        width *= 2
    return out[..., sequency_order(size)]


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row its nearest entry, ties to the lower number, and the squared distance; whole numbers throughout.

    The first two coefficients are compared with every entry.  The entry nearest by
    those compared so far, summed up in full, bounds the search; entries whose sum
    exceeds the bound are dropped, and the rest is compared by twice as many
    coefficients, until all are.
    """
    mine, theirs = walsh_hadamard(parts), walsh_hadamard(entries)
    by_place, entries_by_place = np.ascontiguousarray(mine.T), np.ascontiguousarray(theirs.T)
    size, count, rows = mine.shape[1], len(theirs), np.arange(len(mine))
    done = min(2, size)
    partial = sum((by_place[k][:, None] - entries_by_place[k]) ** 2 for k in range(done))
    bound = ((mine - theirs[partial.argmin(axis=1)]) ** 2).sum(axis=1)
    left = np.flatnonzero(partial <= bound[:, None])
    row, total = left // count, partial.ravel()[left]
    entry = left - row * count
    while done < size:
        to = min(size, 2 * done)
        for k in range(done, to):
            gap = by_place[k][row] - entries_by_place[k][entry]
            total += gap * gap
        done = to
        best = np.minimum.reduceat(total, np.searchsorted(row, rows)) if len(rows) else total
        if done < size:
            first = np.flatnonzero(total == best[row])
            first = first[np.searchsorted(row[first], rows)]
            best = ((mine - theirs[entry[first]]) ** 2).sum(axis=1)
        bound = np.minimum(bound, best)
        kept = total <= bound[row]
        row, entry, total = row[kept], entry[kept], total[kept]
    return entry[np.searchsorted(row, rows)], bound // size


@dataclass
class Codebooks:
    """``entries[part, entry, position]``, whole numbers."""

    entries: np.ndarray

    def digest(self) -> str:
        """sha256 of all components as decimal numbers, by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _whole_numbers(batch: pa.RecordBatch, scale: int, parts: int, width: int | None = None):
    """Places of usable vectors in a batch, and floor(scale * x) of their components padded to ``parts`` of ``width``."""
    lists = batch.column(batch.schema.get_field_index("vector"))
    valid = ~np.asarray(lists.is_null())
    sizes = np.where(valid, np.diff(lists.offsets.to_numpy()).astype(np.int64), 0)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    valid[owner[~np.isfinite(values)]] = False
    if width is None:
        width = -(-int(sizes[valid].max(initial=0)) // parts)
    use = valid[owner]
    values = np.floor(values[use] * scale)  # a power of two leaves the digits as they are
    if np.abs(values).max(initial=0) > min(2**28 / max(width, 1), (2**60 / max(parts * width, 1)) ** 0.5):
        raise ValueError("a component is too large: its squared distances may not fit in a long")
    out = np.zeros((len(sizes), parts * width), np.int64)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[owner[use], at[use]] = values.astype(np.int64)
    return np.flatnonzero(valid), out[valid]


def _inputs(vectors: DataFrame, id_col: str, vec_col: str, label_col: str | None) -> DataFrame:
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    vector = F.col(vec_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), label.alias("label"))


def first_codebooks(rows: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """The vectors of the smallest ids, NULL last; each task hands on no more than ``entries`` of its own."""

    def leaders(batches):
        best, width = {}, 0
        for batch in batches:
            for part in slices(batch):
                places, numbers = _whole_numbers(part, scale, parts)
                width = max(width, numbers.shape[1])
                ids = part.column(0).take(pa.array(places))
                unknown = np.asarray(ids.is_null())
                known = ids.fill_null(0).to_numpy()
                least = np.unique(known[~unknown])[:entries]
                small = ~unknown & (known <= least[-1]) if len(least) == entries else np.ones(len(known), bool)
                known, unknown, numbers = known[small], unknown[small], numbers[small]
                order = np.lexsort((*numbers.T[::-1], known, unknown))
                for i in order[::-1]:
                    key = (bool(unknown[i]), int(known[i]))
                    best[key] = min(best.get(key, numbers[i].tolist()), numbers[i].tolist())
                best = {key: best[key] for key in sorted(best)[:entries]}
        ids = [None if key[0] else key[1] for key in best]
        yield pa.RecordBatch.from_pydict(
            {"id": [*ids, None], "vector": [*best.values(), None], "width": [width] * (len(ids) + 1)},
            pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.int64())), ("width", pa.int64())]),
        )

    found = cut_lineage(rows.mapInArrow(leaders, "id long, vector array<long>, width long"))
    width = (found.agg(F.max("width")).first()[0] or 0) // parts
    least = found.filter("vector is not null").groupBy("id").agg(F.min("vector").alias("vector"))
    first = least.orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()
    out = np.zeros((len(first), parts * width), np.int64)
    for i, row in enumerate(first):
        out[i, : len(row.vector)] = row.vector
    return Codebooks(np.ascontiguousarray(out.reshape(len(first), parts, width).transpose(1, 0, 2)))


def _assigned(part: pa.RecordBatch, books: Codebooks, scale: int):
    """Places of the usable vectors of a batch, their parts, the entry of each part, and its squared distance."""
    parts, _, width = books.entries.shape
    places, numbers = _whole_numbers(part, scale, parts, width)
    cut = numbers.reshape(len(places), parts, width)
    code = np.zeros((len(places), parts), np.int64)
    error = np.zeros((len(places), parts), np.int64)
    if width and len(places):
        for p in range(parts):
            code[:, p], error[:, p] = nearest_entries(cut[:, p], books.entries[p])
    return places, cut, code, error


def refined(rows: DataFrame, books: Codebooks, scale: int) -> Codebooks:
    """One round: entries become the floors of the means of their parts; entries without parts stay.

    A task adds up its own parts first and hands on one row per part, entry and
    position.
    """
    parts, count, width = books.entries.shape

    def sums(batches):
        total = np.zeros((parts, count, width), np.int64)
        used = np.zeros((parts, count), np.int64)
        for batch in batches:
            for part in slices(batch):
                _, cut, code, _ = _assigned(part, books, scale)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], cut[:, p])
                    used[p] += np.bincount(code[:, p], minlength=count)
        at = np.nonzero(np.repeat(used.ravel() > 0, width))[0]
        yield pa.RecordBatch.from_pydict(
            {"cell": pa.array(at), "total": pa.array(total.ravel()[at]), "used": pa.array(used.ravel()[at // max(width, 1)])}
        )

    cells = rows.mapInArrow(sums, "cell long, total long, used long").groupBy("cell")
    means = cells.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("used").alias("used"))
    entries = books.entries.copy()
    for row in means.collect():
        entries.ravel()[row.cell] = int(row.total) // row.used
    return Codebooks(entries)


def train(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    """Codebooks of a table ``id, vector, label``; the driver holds ``entries`` vectors' worth of numbers."""
    books = first_codebooks(rows, parts, entries, scale)
    for _ in range(rounds if books.entries.size else 0):
        books = refined(rows, books, scale)
    return books


def encode(rows: DataFrame, books: Codebooks, scale: int = 256) -> DataFrame:
    """``id, label, code, error`` of every usable vector; two hexadecimal digits per part."""
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def coded(batches):
        for batch in batches:
            for part in slices(batch):
                places, _, code, error = _assigned(part, books, scale)
                kept = pa.array(places)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(kept),
                        part.column(2).take(kept),
                        pa.array(["".join(c) for c in hexes[code].tolist()], pa.string()),
                        pa.array(error.sum(axis=1)),
                    ],
                    ["id", "label", "code", "error"],
                )

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(coded, f"id long, label {label}, code string, error long")


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str | None = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector, one row for each input row.

    Vectors that are NULL or hold NULL, NaN or infinite components are dropped.
    Components become floor(scale * x); vectors are cut into ``parts`` equal
    parts, each with a codebook of at most ``entries`` (256 or fewer) entries,
    started from the vectors of the smallest ids, NULL last, and refined for
    ``rounds`` rounds.  Vectors shorter than the longest, and lengths that are no
    multiple of ``parts``, are padded with zeros behind.  Of rows that share an id
    the vector first in order may start an entry; all rows are coded.
    ``label_error`` adds up errors over equal labels, NULL labels together.  A
    component whose squared distances may not fit in a long (over 262,144 for 64
    components in 16 parts) is an error; an empty table gives no rows.
    """
    if entries > 256:
        raise ValueError("two hexadecimal digits hold 256 entries")
    rows = _inputs(vectors, id_col, vec_col, label_col)
    books = train(rows, parts, entries, rounds, scale)
    coded = cut_lineage(encode(rows, books, scale))
    sums = coded.groupBy(F.col("label").alias("own_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("own_label"))).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )
