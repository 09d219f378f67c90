"""Removal of word windows that occur in an earlier document, by super-k-mer partitioning."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.llm.blocks import (
    RANGE,
    apply_ranges,
    covered,
    cut_blocks,
    keyed,
    meeting_blocks,
    mix,
    range_batch,
    range_hashes,
    runs,
)
from riverspark.llm.common import slices, whole_groups
from riverspark.session import cut_lineage

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def word_cutter(width: int, gram: int):
    """Cut an encoded text into blocks of ``width``-word windows with minimisers of ``gram`` words."""
    step = np.uint64(0xD6E8FEB86659FD93)

    def cut(data: bytes):
        chars = np.frombuffer(data, np.uint8)
        inside = np.diff(np.r_[False, ~_SPACES[chars], False].astype(np.int8))
        starts, ends = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
        if len(starts) < width:
            return (*cut_blocks(np.zeros(0, np.uint64), 1), None)
        words = range_hashes(chars, starts, ends)
        grams = np.zeros(len(words) - gram + 1, np.uint64)
        for i in range(gram):
            grams = grams * step + words[i : i + len(grams)]

        def pack(first: int, n: int) -> bytes:
            return b" ".join(data[starts[first] : ends[first + n + width - 2]].split())

        return (*cut_blocks(mix(grams), width - gram + 1), pack)

    return cut


def _window_ranges(batches, width: int):
    """Flagged window ranges of whole buckets: their windows are sorted, equal ones counted together."""
    for table in whole_groups(batches, "bucket", 4000):
        out = []
        for _, rows in groupby(zip(*(c.to_pylist() for c in table.columns)), key=lambda r: r[0]):
            rows = list(rows)
            low: dict[bytes, int] = {}
            for _, doc, _, _, _, packed in rows:
                low[packed] = min(doc, low.get(packed, doc))
            flags = {}
            if len(low) > 1:
                windows = []
                for packed, doc in low.items():
                    words = packed.split(b" ")
                    n = len(words) - width + 1
                    flags[packed] = np.zeros(n, bool)
                    windows += [(b" ".join(words[i : i + width]), doc, packed, i) for i in range(n)]
                windows.sort(key=lambda w: w[:2])
                for _, same in groupby(windows, key=lambda w: w[0]):
                    _, least, _, _ = next(same)
                    for _, doc, packed, i in same:
                        flags[packed][i] = doc > least
            for _, doc, key, first, n, packed in rows:
                if doc > low[packed]:
                    out.append((doc, key, first, n))
                elif packed in flags:
                    out += [(doc, key, [f + a for f in first], m) for a, m in runs(flags[packed])]
        if out:
            yield range_batch(out)


def _whole_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of crowded buckets that an earlier document has too, as ranges; and the blocks of the earliest one."""
    blocks = blocks.withColumn("digest", F.unhex(F.md5("packed")))
    low = blocks.groupBy("bucket", "digest").agg(F.min("doc_id").alias("low"))
    blocks = blocks.join(low, ["bucket", "digest"])
    whole = blocks.filter("doc_id > low").select("doc_id", "key", "first", "n")
    # Rows that repeat a document have its ranges, so one of them stands for all.
    firsts = blocks.filter("doc_id = low").dropDuplicates(["bucket", "digest", "doc_id", "key", "first"])
    return whole, firsts.select("bucket", "doc_id", "key", "first", "packed")


def _split_buckets(firsts: DataFrame, width: int, gram: int, crowd: int) -> DataFrame:
    """Blocks of crowded buckets cut again, by minimisers of more words; columns as ``meeting_blocks`` has them.

    Equal windows of one bucket still meet, and blocks that shared no more than the
    shorter minimiser part.  Buckets of one document are left out.
    """
    cut = word_cutter(width, gram)
    names = ["bucket", "doc_id", "key", "first", "n", "packed"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]

    def again(batches):
        for batch in batches:
            for part in slices(batch, 1_000_000):
                out = []
                for old, doc, key, places, packed in zip(*(c.to_pylist() for c in part.columns)):
                    first, n, bucket, pack = cut(packed)
                    new = mix(bucket.view(np.uint64) ^ np.array([old], np.int64).view(np.uint64)).view(np.int64)
                    for b, f, m in zip(new.tolist(), first.tolist(), n.tolist()):
                        out.append((b, doc, key, [p + f for p in places], m, pack(f, m)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    made = firsts.mapInArrow(again, "bucket long, doc_id long, key long, first array<long>, n long, packed binary")
    made = cut_lineage(made)
    size = made.groupBy("bucket").agg(F.count("*").alias("met"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    met = size.filter("low < high").select("bucket", (F.col("met") > crowd).alias("crowded"))
    return cut_lineage(made.join(met, "bucket"))


def repeated_windows(docs: DataFrame, width: int = 50, gram: int = 8, crowd: int = 2000) -> DataFrame:
    """Ranges ``first``, ``n`` of windows whose words also start in a document with a smaller doc_id.

    ``docs`` has ``doc_id``, ``text`` and ``key``.  Windows of a bucket are
    sorted and compared in full.  Of a bucket of more than ``crowd`` blocks the
    blocks that repeat as a whole are aggregated, and the others are cut again by
    minimisers of twice as many words, until buckets are small; minimisers of
    ``width`` words are the windows themselves, and then all blocks of a bucket are alike.
    """
    blocks = meeting_blocks(docs, word_cutter(width, gram), two_docs=True, crowd=crowd)
    found = None
    while True:
        packed = blocks.filter("not crowded").select("bucket", "doc_id", "key", "first", "n", "packed")
        dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
        ranges = dealt.mapInArrow(lambda batches: _window_ranges(batches, width), RANGE)
        found = ranges if found is None else found.union(ranges)
        crowded = blocks.filter("crowded")
        if crowded.isEmpty():
            return found
        whole, firsts = _whole_blocks(crowded)
        found = found.union(whole)
        if gram == width:
            return found
        gram = min(width, 2 * gram)
        blocks = _split_buckets(firsts, width, gram, crowd)


def remove_repeated_windows(
    docs: DataFrame, width: int = 50, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", crowd: int = 2000
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the other words joined by one space.

    A word goes when a window of ``width`` words that covers it also starts in a
    document with a smaller doc_id; windows are judged on the input.  NULL and
    empty texts have no words and keep the empty text; texts under ``width``
    words are kept; rows of one doc_id never remove each other's words; a row
    without doc_id is kept whole and removes nothing; an empty table gives no rows.
    """
    docs = keyed(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                total, removed, kept = [], [], []
                for text, first, n in zip(*(part.column(c).to_pylist() for c in (1, 2, 3))):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    total.append(len(words))
                    if first:
                        gone = covered(len(words), first, n, width)
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    removed.append(total[-1] - len(words))
                    kept.append(b" ".join(words))
                arrays = [part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                          pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept"])

    ranges = repeated_windows(docs, width, gram, crowd)
    return apply_ranges(docs, ranges, run, "doc_id long, n_words long, n_removed long, kept string")
