"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverspark.llm.blocks import bitmap, has_bit, keyed, mix, range_hashes
from riverspark.llm.common import slices
from riverspark.session import cut_lineage

#: Words are runs of ASCII letters and digits and of anything beyond ASCII; A-Z are lower-cased.
_WORDS = bytes(
    c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256)
)
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Shingles:
    """The word shingles of one text: a hash of each, and their strings when needed."""

    def __init__(self, text: str | None, width: int):
        self.data = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS)
        chars = np.frombuffer(self.data, np.uint8)
        edge = np.diff(np.r_[False, chars != 32, False].astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.width = width
        count = max(len(self.starts) - width + 1, 0)
        grams = np.zeros(count, np.uint64)
        if count:
            words = range_hashes(chars, self.starts, self.ends)
            for i in range(width):
                grams = grams * _STEP + words[i : i + count]
        self.hashes = mix(grams)

    def string(self, i: int) -> str:
        part = self.data[self.starts[i] : self.ends[i + self.width - 1]]
        return b" ".join(part.split()).decode("utf-8", "surrogatepass")


def signature_length(size: int, threshold: float) -> int:
    """How many smallest hashes any holder of enough shingles must meet.

    A text that holds at least ceil(threshold * q) of an item's q shingles lacks
    at most q - ceil(threshold * q) of them, so it holds one of any one more.
    Items of one size class, up to the next power of two, get the same length.
    """
    top = 1 << max(size - 1, 0).bit_length()
    return min(size, top - int(np.ceil(threshold * top - 1e-9)) + 1)


def item_shingles(items: DataFrame, id_col: str, text_col: str, width: int, threshold: float) -> DataFrame:
    """Distinct shingles of each item: ``item_id``, ``shingle``, ``hash``, ``size`` and ``signed`` (in its signature).

    Any choice of so many shingles is safe.  Those of fewest items come first, then
    those of smallest hash, so that a phrase of many items signs none that has others.
    """

    def run(batches):
        for batch in batches:
            out = []
            for item, text, key in zip(*(c.to_pylist() for c in batch.columns)):
                parts = Shingles(text, width)
                strings = {parts.string(i): int(h) for i, h in enumerate(parts.hashes.view(np.int64))}
                size, length = len(strings), signature_length(len(strings), threshold)
                out += [(item, key, s, h, size, length) for s, h in strings.items()]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                names = ["item_id", "item_key", "shingle", "hash", "size", "length"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    rows = items.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(text_col)).distinct()
    schema = "item_id long, item_key long, shingle string, hash long, size long, length long"
    shingles = cut_lineage(rows.mapInArrow(run, schema))
    holders = shingles.groupBy("shingle").agg(F.count("*").alias("holders"))
    order = Window.partitionBy("item_id", "item_key").orderBy("holders", "hash", "shingle")
    ranked = shingles.join(holders, "shingle").withColumn("signed", F.row_number().over(order) <= F.col("length"))
    return cut_lineage(ranked.select("item_id", "item_key", "shingle", "hash", "size", "signed"))


def _matches(
    docs: DataFrame,
    items: DataFrame,
    threshold: float,
    width: int,
    id_col: str,
    text_col: str,
    item_id: str,
    item_text: str,
    bits: int,
) -> DataFrame:
    shingles = item_shingles(items, item_id, item_text, width, threshold)
    spark = docs.sparkSession
    signed = spark.sparkContext.broadcast(bitmap(shingles.filter("signed"), "hash", bits))
    every = spark.sparkContext.broadcast(bitmap(shingles, "hash", bits))

    def probe(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc, text, key in zip(*(c.to_pylist() for c in part.columns)):
                    parts = Shingles(text, width)
                    if has_bit(signed.value, parts.hashes).any():
                        found = np.flatnonzero(has_bit(every.value, parts.hashes)).tolist()
                        out += [(doc, key, s) for s in sorted({parts.string(i) for i in found})]
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.string())
                    arrays = [pa.array(x, k) for x, k in zip(zip(*out), kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "shingle"])

    hits = keyed(docs, id_col, text_col).mapInArrow(probe, "doc_id long, key long, shingle string").distinct()
    hits = cut_lineage(hits)
    pair = ["doc_id", "key", "item_id", "item_key"]
    # Signatures propose pairs; only their shingles are counted.
    pairs = hits.join(shingles.filter("signed"), "shingle").select(*pair).distinct()
    same_item = F.expr("p.item_id <=> s.item_id and p.item_key = s.item_key")
    asked = pairs.alias("p").join(shingles.alias("s"), same_item).select("p.*", "s.shingle", "s.size")
    met = F.expr("a.doc_id <=> h.doc_id and a.key <=> h.key and a.shingle = h.shingle")
    shared = asked.alias("a").join(hits.alias("h"), met, "left_semi").groupBy(*pair, "size").agg(F.count("*").alias("shared"))
    return shared.filter(F.col("shared") >= threshold * F.col("size") - 1e-9)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    width: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    bits: int = 26,
) -> DataFrame:
    """Pairs of a document and an item of which it holds at least ``threshold``.

    Containment is the share of the item's distinct shingles of ``width`` words
    that the document has anywhere.  Columns: ``doc_id``, ``item_id``,
    ``shared``, ``item_shingles``, ``containment``.

    An item's signature is its smallest shingle hashes, rarest shingles first, as
    many as its size class needs so that no document above the threshold can miss
    them all; banded whole-text signatures would lose short items inside long documents.
    The signatures of all items go into a bitmap of fixed size that documents
    probe with every shingle.  A pair is a document and an item of which it holds a
    signed shingle; the exact count over the item's shingles decides.

    NULL, empty and short texts, and items under ``width`` words, match nothing;
    repeated rows give one pair; a document without id comes back with a NULL
    id; items that repeat an id count alone, the best one is returned.
    """
    found = _matches(docs, items, threshold, width, id_col, text_col, item_id, item_text, bits)
    best = found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct((F.col("shared") / F.col("size")).alias("containment"), "shared", "size")).alias("b")
    )
    return best.select(
        "doc_id", "item_id", "b.shared", F.col("b.size").alias("item_shingles"), "b.containment"
    )


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5,
                         id_col: str = "doc_id", text_col: str = "text", bits: int = 26) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    found = _matches(docs, items, threshold, width, id_col, text_col, "item_id", "text", bits)
    found = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(found["_id"]) & (F.xxhash64(docs[text_col]) == found["_key"])
    return docs.join(found, same, "left_anti")
