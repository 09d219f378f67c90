"""Removal of byte strings that start earlier in the corpus, by prefix doubling."""

from __future__ import annotations

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
from riverspark.llm.common import slices, spread, whole_groups
from riverspark.session import cut_lineage


def byte_cutter(width: int, gram: int):
    """Cut encoded text into blocks of ``width``-byte windows with minimisers of ``gram`` bytes."""

    def cut(data: bytes):
        if len(data) < width:
            return (*cut_blocks(np.zeros(0, np.uint64), 1), None)
        at = np.arange(len(data) - gram + 1)
        grams = range_hashes(np.frombuffer(data, np.uint8), at, at + gram)
        return (*cut_blocks(grams, width - gram + 1), lambda first, n: data[first : first + n + width - 1])

    return cut


def _rank(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks from 1 in sorted order, and how often each one's value occurs."""
    _, rank, count = np.unique(values, return_inverse=True, return_counts=True)
    return rank.astype(np.int64) + 1, count[rank]


def doubled_ranks(data: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """Rank of the ``width`` bytes from each position; 0 where they are unique or cut off.

    ``left[p]`` is how many bytes of its own string remain from ``p``.  Ranks of
    8 bytes come from the bytes; then pairs (rank at p, rank at p + k) are sorted
    at growing offsets k and ranked again.  A position that has become unique is
    out: every longer string from it, or over it, is unique too.
    """
    open_ = np.flatnonzero(left >= min(8, width))
    first = np.zeros(len(open_), np.uint64)
    for i in range(min(8, width)):
        first = (first << np.uint64(8)) | data[open_ + i].astype(np.uint64)
    ranks = np.zeros(len(data) + width, np.int64)
    length = min(8, width)
    rank, count = _rank(first)
    while True:
        ranks[:] = 0
        ranks[open_[count > 1]] = rank[count > 1]
        if length == width:
            return ranks[: len(data)]
        step = min(length, width - length)
        open_ = open_[(count > 1) & (ranks[open_ + step] > 0) & (left[open_] >= length + step)]
        length += step
        rank, count = _rank((ranks[open_] << 32) | ranks[open_ + step])


def _string_ranges(batches, width: int):
    """Flagged ranges of whole buckets: blocks that repeat, then windows inside different blocks."""
    for table in whole_groups(batches, "bucket", 5_000):
        bucket, doc, key, n = (table.column(c).to_numpy() for c in ("bucket", "doc_id", "key", "n"))
        places = table.column("first").to_pylist()
        first = np.array([p[0] for p in places], np.int64)
        codes = table.column("packed").combine_chunks().dictionary_encode()
        kind, strings = codes.indices.to_numpy(), codes.dictionary
        order = np.lexsort((first, doc, kind))
        head = order[np.r_[True, kind[order][1:] != kind[order][:-1]]]  # the earliest block of each kind
        start = np.empty(len(strings), np.int64)
        start[kind[head]] = head
        own = start[kind]
        same = (doc == doc[own]) & (first == first[own])
        # Every place counts behind the first one of the earliest document.
        again = [p[1:] if s else p for p, s in zip(places, same.tolist())]
        out = [row for row in zip(doc.tolist(), key.tolist(), again, n.tolist()) if row[2]]
        # Only buckets with different blocks can hold further equal windows.
        _, inverse, count = np.unique(bucket[head], return_inverse=True, return_counts=True)
        head = head[count[inverse] > 1]
        if len(head):
            packed = [strings[int(k)].as_py() for k in kind[head]]
            size = np.array([len(p) for p in packed])
            data = np.frombuffer(b"".join(packed), np.uint8)
            base = np.cumsum(size) - size
            at, block = spread(base, size)
            rank = doubled_ranks(data, base[block] + size[block] - at, width)
            some = np.flatnonzero(rank)
            owner = head[block[some]]
            where = first[owner] + some - base[block[some]]
            order = np.lexsort((where, doc[owner], rank[some]))
            group = rank[some][order]
            # Blocks may share a minimiser and no window: then nothing is ranked.
            lead = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
            lead = np.repeat(order[lead], np.diff(np.r_[lead, len(group)]))
            tied = (doc[owner][lead] == doc[owner][order]) & (where[lead] == where[order])
            flags = np.zeros(len(data), bool)
            flags[some[order[~tied]]] = True
            found = runs(flags)  # a run never leaves a block: its last bytes start no window
            heads: dict[int, list[tuple[int, int]]] = {}
            for a, m in found:
                heads.setdefault(int(head[block[a]]), []).append((a - int(base[block[a]]), m))
            # Rows that repeat a document stand at the same place and share its ranges.
            for row in np.flatnonzero(same & np.isin(own, list(heads))).tolist():
                out += [(int(doc[row]), int(key[row]), [int(first[row]) + a], m) for a, m in heads[int(own[row])]]
        if out:
            yield range_batch(out)


def _whole_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of crowded buckets that repeat an earlier one, as ranges; and the first block of each kind."""
    low = F.min(F.struct("doc_id", "start")).alias("low")
    later = F.expr("struct(doc_id, start) > low")
    blocks = blocks.withColumns({"digest": F.unhex(F.md5("packed")), "start": F.get("first", F.lit(0))})
    blocks = blocks.join(blocks.groupBy("bucket", "digest").agg(low), ["bucket", "digest"])
    # Every place counts behind the first one of the earliest document.
    again = F.when(later, F.col("first")).otherwise(F.slice("first", F.lit(2), F.size("first")))
    whole = blocks.select("doc_id", "key", again.alias("first"), "n").filter(F.size("first") > 0)
    return whole, blocks.filter(~later).select("bucket", "doc_id", "key", "start", "packed")


def _split_buckets(firsts: DataFrame, width: int, gram: int, crowd: int) -> DataFrame:
    """Blocks of crowded buckets cut again, by minimisers of more bytes; columns as ``meeting_blocks`` has them.

    Equal windows of one bucket still meet, and blocks that shared no more than the
    shorter minimiser part.  Buckets of one block are left out.
    """
    cut = byte_cutter(width, gram)
    names = ["bucket", "doc_id", "key", "first", "n", "packed"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]

    def again(batches):
        for batch in batches:
            for part in slices(batch, 1_000_000):
                out = []
                for old, doc, key, start, packed in zip(*(c.to_pylist() for c in part.columns)):
                    first, n, bucket, pack = cut(packed)
                    new = mix(bucket.view(np.uint64) ^ np.array([old], np.int64).view(np.uint64)).view(np.int64)
                    for b, f, m in zip(new.tolist(), first.tolist(), n.tolist()):
                        out.append((b, doc, key, [start + f], m, pack(f, m)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    made = firsts.mapInArrow(again, "bucket long, doc_id long, key long, first array<long>, n long, packed binary")
    made = cut_lineage(made)
    met = made.groupBy("bucket").agg(F.count("*").alias("met")).filter("met > 1")
    return cut_lineage(made.join(met, "bucket").withColumn("crowded", F.col("met") > crowd).drop("met"))


def repeated_strings(docs: DataFrame, width: int = 100, gram: int = 32, crowd: int = 5000) -> DataFrame:
    """Ranges ``first``, ``n`` of positions whose ``width`` bytes also start earlier.

    Earlier means a smaller doc_id, or a smaller position in the same document.
    Spark deals positions out so that equal strings meet: each goes with its
    minimiser, and minimisers that occur once are dropped before anything
    travels.  What meets is ranked by prefix doubling.  Of a bucket of more than
    ``crowd`` blocks the blocks that repeat as a whole are aggregated, and the
    others are cut again by minimisers of twice as many bytes, until buckets are
    small; minimisers of ``width`` bytes are the windows themselves, and then all
    blocks of a bucket are alike.
    """
    blocks = meeting_blocks(docs, byte_cutter(width, gram), two_docs=False, crowd=crowd, bits=27)
    found = None
    while True:
        packed = blocks.filter("not crowded").select("bucket", "doc_id", "key", "first", "n", "packed")
        dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
        ranges = dealt.mapInArrow(lambda batches: _string_ranges(batches, width), RANGE)
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


def remove_repeated_strings(
    docs: DataFrame, width: int = 100, gram: int = 32, id_col: str = "doc_id", text_col: str = "text", crowd: int = 5000
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the remaining bytes.

    A byte goes when ``width`` bytes that cover it also start earlier; strings
    are judged on the input, overlaps count, and none crosses documents.
    ``n_spans`` counts maximal removed runs.  NULL counts as empty; texts under
    ``width`` bytes are kept; rows that repeat a doc_id count as one document, so
    at equal positions neither removes the other; a row without doc_id is kept
    whole and removes nothing; an empty table gives no rows.
    """
    docs = keyed(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for text, first, n in zip(*(part.column(c).to_pylist() for c in (1, 2, 3))):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    if not first:
                        out.append((len(data), 0, 0, data))
                        continue
                    gone = covered(len(data), first, n, width)
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    out.append((len(data), len(data) - len(kept), len(runs(gone)), kept))
                *counts, kept = zip(*out)
                arrays = [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    ranges = repeated_strings(docs, width, gram, crowd)
    return apply_ranges(docs, ranges, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
