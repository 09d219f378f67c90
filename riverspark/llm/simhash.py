"""SimHash fingerprints and near-duplicate groups by a Gray-order hierarchical index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverspark.llm.common import column, in_small_batches, slices, spread, texts, whole_groups
from riverspark.llm.components import components
from riverspark.session import cut_lineage

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FAN = 8  # fingerprints in a leaf, and children of an upper node


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of ``text``, as a signed integer.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are
    ``width`` words joined by one space and count as often as they occur.  A
    text of fewer words is one shingle; NULL and a text without words give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words])[: max(1, len(words) - width + 1)].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts, ends)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` of every row; no shuffle."""
    return _with_fingerprints(texts(docs, id_col, text_col), width)


def _with_fingerprints(rows: DataFrame, width: int) -> DataFrame:
    """``fp`` in place of the column ``text``."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fps = pa.array([fingerprint(t, width) for t in column(part, "text")], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.select(kept).columns, fps], [*kept, "fp"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in (*kept, "fp")))


def gray_rank(code: Column) -> Column:
    """Place of a 64-bit code in the Gray order (neighbours differ in one bit)."""
    for step in (32, 16, 8, 4, 2, 1):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code


def _part(code: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(code, start).bitwiseAND(F.lit((1 << width) - 1))


def _parts(width: int, count: int) -> list[tuple[int, int]]:
    """(start, length) of ``count`` nearly equal parts of ``width`` bits."""
    cuts = [width * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _rooted(rows: DataFrame, most_differences: int, level: int) -> DataFrame:
    """Repeat every row once per root: a part of its open bits, which root members share.

    Codes with at most d differing bits agree on one of d + 1 parts, so linked
    codes meet below some root.  ``open`` holds the bits that no root above has
    fixed, moved together.
    """
    parts = _parts(rows.schema["open"].metadata["bits"], most_differences + 1)
    options = []
    for number, (start, length) in enumerate(parts):
        low = _part(F.col("open"), 0, start)
        high = F.shiftrightunsigned("open", start + length) if start + length < 64 else F.lit(0).cast("long")
        rest = low.bitwiseOR(F.shiftleft(high, start)) if start < 64 else low
        root = F.xxhash64("root", F.lit(level * 100 + number), _part(F.col("open"), start, length))
        options.append(F.struct(root.alias("root"), rest.alias("open")))
    left = rows.schema["open"].metadata["bits"] - min(length for _, length in parts)
    out = rows.select("fp", "doc_id", F.explode(F.array(*options)).alias("o"))
    return out.select("fp", "doc_id", "o.root", F.col("o.open").alias("open", metadata={"bits": left}))


def fingerprint_links(
    codes: DataFrame, most_differences: int = 3, crowd: int = 20_000, levels: int = 3
) -> DataFrame:
    """Links ``a``, ``b`` that connect all codes with at most ``most_differences`` differing bits.

    ``codes`` has distinct ``fp`` and their ``doc_id``.  Linked rows are found
    whole, but what is returned spans them: within one index block each group
    gives a star, never all its pairs.  The top of the index is the pattern of
    bits that a block shares; blocks of more than ``crowd`` codes get further
    shared bits, up to ``levels`` times.  In a block, codes lie in Gray order,
    so that neighbours share most bits.
    """
    rows = codes.select(
        "fp", "doc_id", F.lit(0).cast("long").alias("root"), F.col("fp").alias("open", metadata={"bits": 64})
    )
    blocks = None
    for level in range(levels):
        rows = _rooted(rows, most_differences, level)
        settled = rows
        if level + 1 < levels:
            crowded = rows.groupBy("root").count().filter(F.col("count") > crowd).select("root")
            settled = rows.join(crowded, "root", "left_anti")
            bits = rows.schema["open"].metadata
            rows = rows.join(crowded, "root", "left_semi")
            rows = rows.select("fp", "doc_id", "root", F.col("open").alias("open", metadata=bits))
        settled = settled.select("root", "fp", "doc_id")
        blocks = settled if blocks is None else blocks.union(settled)

    def run(batches):
        for table in whole_groups(batches, "root"):
            root, fp, doc = (table.column(c).to_numpy() for c in ("root", "fp", "doc_id"))
            head = _join_block(root, fp.view(np.uint64), most_differences)
            own = np.flatnonzero(head != np.arange(len(head)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(doc[head[own]])], ["a", "b"])

    dealt = blocks.repartition("root").sortWithinPartitions("root", gray_rank(F.col("fp")))
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _join_block(root: np.ndarray, codes: np.ndarray, most: int, room: int = 2_000_000) -> np.ndarray:
    """For each code the first row of its group; rows are sorted by root, then Gray rank.

    The index: leaves of ``_FAN`` neighbouring codes, upper nodes of ``_FAN``
    nodes.  A node keeps the bits all codes below it share (mask and value).
    Two nodes differ at least in the shared bits that differ, so a pair of nodes
    beyond ``most`` is dropped with all pairs below it; deeper nodes share more
    bits and add their differences to those of the nodes above.
    """
    n = len(codes)
    levels = []  # per level: first child, number of children, root, shared mask, value
    owner, low, high = root, codes, codes
    while True:
        new = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.r_[new, len(owner)])
        place = np.arange(len(owner)) - np.repeat(new, size)
        first = np.flatnonzero(place % _FAN == 0)
        count = np.diff(np.r_[first, len(owner)])
        low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
        owner = owner[first]
        levels.append((first, count, ~(low ^ high), low))
        if len(first) == len(new):
            break
    parent = np.arange(n)
    top = np.flatnonzero(np.ones(len(levels[-1][0]), bool))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        level, a, b = stack.pop()
        first, count, _, _ = levels[level]
        pairs = count[a] * count[b]
        if len(a) > 1 and pairs.sum() > room:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        place, pair = spread(np.zeros(len(a), np.int64), pairs)
        x = first[a][pair] + place // count[b][pair]
        y = first[b][pair] + place % count[b][pair]
        if level == 0:
            apart = np.bitwise_count(codes[x] ^ codes[y])
            keep = (x < y) & (apart <= most)
            _unite(parent, x[keep], y[keep])
        else:
            _, _, mask, value = levels[level - 1]
            apart = np.bitwise_count((value[x] ^ value[y]) & mask[x] & mask[y])
            keep = (x <= y) & (apart <= most)
            if keep.any():
                stack.append((level - 1, x[keep], y[keep]))
    return _heads(parent, np.arange(n))


def _heads(parent: np.ndarray, rows: np.ndarray) -> np.ndarray:
    head = parent[rows]
    while True:
        above = parent[head]
        if np.array_equal(above, head):
            return head
        head = above


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        x, y = _heads(parent, a), _heads(parent, b)
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most_differences: int = 3
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Rows link when their fingerprints differ in at most ``most_differences``
    bits; ``component_id`` is the smallest doc_id that links reach, the row's own
    included.  NULL and empty texts have fingerprint zero and link like others;
    repeated rows come back as often as they came; a row without doc_id links
    nothing and has a NULL component.  An empty table gives no rows.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col, width))
    codes = marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    groups = components(fingerprint_links(codes, most_differences))
    ids = codes.join(groups, codes["doc_id"] == groups["node"], "left").select(
        "fp", F.coalesce("component", "doc_id").alias("component_id")
    )
    return marked.join(ids, "fp", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most_differences: int = 3
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each group stays, all columns as they are.

    Groups are made of rows, by their own fingerprints: an id with two unlike texts
    belongs to two groups, and may stay in one and go in the other.  The smallest
    id of a group stays; of rows that share it, those of one text, and of these
    one row, chosen by the rows' hashes alone.  Rows without id belong to no group
    and stay; NULL and empty texts are one group.  An empty table gives no rows.
    """
    known = docs.filter(F.col(id_col).isNotNull())
    key = F.xxhash64(text_col).alias("key")
    rows = in_small_batches(known).select(F.col(id_col).cast("long").alias("doc_id"), key, F.col(text_col).alias("text"))
    marked = cut_lineage(_with_fingerprints(rows, width))
    codes = marked.select("fp", F.col("fp").alias("doc_id")).distinct()
    groups = components(fingerprint_links(codes, most_differences)).withColumnRenamed("node", "fp")
    grouped = marked.join(groups, "fp", "left").groupBy(F.coalesce("component", "fp"))
    least = grouped.agg(F.min(F.struct("doc_id", "key")).alias("least")).select(
        F.col("least.doc_id").alias("_least_id"), F.col("least.key").alias("_least_key")
    )
    same = (F.col(id_col).cast("long") == F.col("_least_id")) & (F.xxhash64(text_col) == F.col("_least_key"))
    kept = known.join(least, same, "left_semi")
    place = F.row_number().over(
        Window.partitionBy(F.col(id_col), F.xxhash64(text_col)).orderBy(F.xxhash64(*docs.columns))
    )
    first = kept.select("*", place.alias("_place_of_row")).filter("_place_of_row = 1").drop("_place_of_row")
    return first.union(docs.filter(F.col(id_col).isNull()))
