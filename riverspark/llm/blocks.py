"""Blocks of neighbouring windows that share a minimiser, and where equal windows meet.

A window is ``width`` consecutive units (words or bytes).  Its minimiser is the
leftmost gram of ``gram`` units with the smallest hash.  Equal windows have
equal minimisers at the same place, so all of them meet in the bucket of that
gram.  Neighbouring windows mostly share one, and travel as one packed block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.llm.common import in_small_batches, slices
from riverspark.session import shared_folder

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = np.uint64((1 << 20) - 1)
#: Windows that are looked at together; their places fit in the low 20 bits.
_STRETCH = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``units[start:end]`` for each range, from differences of one running sum."""
    n = len(units)
    power = np.full(n + 1, _BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    back = np.full(n + 1, _BASE_BACK)
    back[0] = 1
    back = np.multiply.accumulate(back)
    return mix((sums[ends] - sums[starts]) * back[starts])


def cut_blocks(grams: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and bucket of each block.

    ``grams`` has the hash of each gram, ``span`` is the number of grams in a window.
    """
    windows = len(grams) - span + 1
    found = []
    for at in range(0, max(windows, 0), _STRETCH):
        part = grams[at : at + _STRETCH + span - 1]
        least = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if span > reach:
            least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
        place = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        found.append((first + at, np.diff(np.r_[first, len(place)]), part[place[first]].view(np.int64)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(part) for part in zip(*found))


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for each value of ``column`` modulo 2 ** bits; its size is fixed by ``bits``."""
    word = F.shiftrightunsigned(column, 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1)).cast("int")
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    rows = hashes.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out.view(np.uint64)


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    h = hashes.view(np.uint64)
    word = bits[(h >> np.uint64(6)) & np.uint64(len(bits) - 1)]
    return (word >> (h & np.uint64(63))) & np.uint64(1) == 1


#: Buckets are counted by these bits, more than any bitmap of them has; fewer bytes to shuffle.
_COUNTED = np.int64((1 << 40) - 1)
#: Ranges of flagged windows: each place in ``first`` starts ``n`` of them.
RANGE = "doc_id long, key long, first array<long>, n long"


def range_batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, key, first, n = zip(*rows)
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
    arrays = [pa.array(x, kind) for x, kind in zip((doc, key, first, n), kinds)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "first", "n"])


Cut = Callable[[bytes], tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[int, int], bytes]]]


def meeting_blocks(
    docs: DataFrame, cut: Cut, two_docs: bool, crowd: int = 2000, bits: int = 26
) -> DataFrame:
    """Blocks whose bucket may hold equal windows, with their packed units.

    ``docs`` has ``doc_id``, ``text`` and ``key``.  ``cut`` gives the blocks of
    an encoded text and packs one.  First all buckets are counted; those of two
    blocks, or of blocks of two documents where ``two_docs`` is set, go into a
    bitmap of fixed size; the second look
    at the texts keeps blocks whose bit is set.  A wrong bit costs time and
    changes nothing.  A second bitmap marks buckets of more than ``crowd`` blocks.

    Equal blocks of one text travel as one, with all their places, so that a text
    that repeats itself does not fill a bucket.  Columns: ``bucket``, ``crowded``,
    ``doc_id``, ``key``, ``first`` (ascending), ``n``, ``packed``.
    """
    spark = docs.sparkSession

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                ids, hashes = [], []
                for doc, text in zip(*(part.column(c).to_pylist() for c in (0, 1))):
                    bucket = cut((text or "").encode("utf-8", "surrogatepass"))[2]
                    hashes.append(bucket & _COUNTED)
                    ids.append(np.full(len(bucket), doc))
                if hashes:
                    arrays = [pa.array(np.concatenate(x)) for x in ((hashes, ids) if two_docs else (hashes,))]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    docs = docs.filter("doc_id is not null")
    names = ["bucket", "doc_id"] if two_docs else ["bucket"]
    counted = docs.mapInArrow(count, ", ".join(f"{n} long" for n in names)).groupBy("bucket")
    size = F.count("*").alias("n")
    if two_docs:
        met = counted.agg(size, F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    else:
        met = counted.agg(size).filter("n > 1")
    buckets = met.select("bucket", (F.col("n") > crowd).alias("crowded"))
    folder = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    buckets.write.parquet(f"{folder}/buckets")
    buckets = spark.read.parquet(f"{folder}/buckets")
    meets = spark.sparkContext.broadcast(bitmap(buckets, "bucket", bits))
    crowds = spark.sparkContext.broadcast(bitmap(buckets.filter("crowded"), "bucket", bits))

    def keep(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc, text, key in zip(*(part.column(c).to_pylist() for c in (0, 1, 2))):
                    first, n, bucket, pack = cut((text or "").encode("utf-8", "surrogatepass"))
                    places: dict[tuple[int, int, bytes], list[int]] = {}
                    kept = np.flatnonzero(has_bit(meets.value, bucket))
                    for b, f, m in zip(bucket[kept].tolist(), first[kept].tolist(), n[kept].tolist()):
                        places.setdefault((b, m, pack(f, m)), []).append(f)
                    out += [(b, doc, key, at, m, packed) for (b, m, packed), at in places.items()]
                if out:
                    bucket, doc, key, first, n, packed = zip(*out)
                    bucket = np.array(bucket)
                    arrays = [
                        pa.array(bucket),
                        pa.array(has_bit(crowds.value, bucket)),
                        *(pa.array(np.array(x, np.int64)) for x in (doc, key)),
                        pa.array(first, pa.list_(pa.int64())),
                        pa.array(np.array(n, np.int64)),
                        pa.array(packed, pa.binary()),
                    ]
                    names = ["bucket", "crowded", "doc_id", "key", "first", "n", "packed"]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "bucket long, crowded boolean, doc_id long, key long, first array<long>, n long, packed binary"
    docs.mapInArrow(keep, schema).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    return spark.read.parquet(f"{folder}/blocks")


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of each maximal run of true flags."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]


def covered(length: int, firsts: list[list[int]], ns: list[int], width: int) -> np.ndarray:
    """Which of ``length`` units lie in a window of the given ranges of windows."""
    first = np.concatenate([np.array(f, np.int64) for f in firsts])
    n = np.repeat(np.array(ns, np.int64), [len(f) for f in firsts])
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + n + width - 1, -1)
    return np.cumsum(change)[:length] > 0


def apply_ranges(docs: DataFrame, ranges: DataFrame, run, schema: str, bits: int = 26) -> DataFrame:
    """``run`` on batches of ``doc_id``, ``text``, ``first`` and ``n``: every text and its flagged ranges.

    The ranges of a text come as lists, which its length bounds, or NULL.  A bitmap
    of fixed size holds the texts that have ranges, so that other texts are not
    shuffled; a wrong bit sends a text through the join, where it finds none.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/ranges-{uuid.uuid4().hex}"
    ranges.write.parquet(folder)
    ranges = spark.read.schema(RANGE).parquet(folder)
    own = F.xxhash64("doc_id", "key").alias("own")
    sent = spark.sparkContext.broadcast(bitmap(ranges.select(own), "own", bits))

    def flagged(batch: pa.RecordBatch) -> np.ndarray:
        return has_bit(sent.value, batch.column(3).to_numpy())

    def joined(batches):
        for batch in batches:
            yield batch.filter(pa.array(flagged(batch)))

    def plain(batches):
        for batch in batches:
            rest = batch.filter(pa.array(~flagged(batch)))
            lists = (pa.nulls(rest.num_rows, pa.list_(pa.list_(pa.int64()))), pa.nulls(rest.num_rows, pa.list_(pa.int64())))
            yield from run([pa.RecordBatch.from_arrays([*rest.columns[:2], *lists], ["doc_id", "text", "first", "n"])])

    docs = docs.select("doc_id", "text", "key", own)
    lists = ranges.groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "n")).alias("ranges"))
    lists = lists.select("doc_id", "key", "ranges.first", "ranges.n")
    some = docs.mapInArrow(joined, "doc_id long, text string, key long, own long")
    some = some.join(lists, ["doc_id", "key"], "left").select("doc_id", "text", "first", "n")
    return some.mapInArrow(run, schema).union(docs.mapInArrow(plain, schema))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text`` and ``key``, which tells rows of one doc_id and different texts apart."""
    return in_small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key")
    )
