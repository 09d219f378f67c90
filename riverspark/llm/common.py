"""Helpers shared by the text operators."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose texts now go to Python in Arrow batches of at most 16 MB.

    Spark's own bound is four times that, and a batch exists twice per task: once
    in the JVM, once in Python.  A session that sets another bound keeps it.
    """
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name) in ("67108864b", "64m", "64MB"):
        conf.set(name, "16m")
    return df


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and ``text``, whatever else the table has."""
    return in_small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns of these names, in any case where the session ignores case."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    fold = str if exact else str.lower
    gone = {fold(n) for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if fold(c) not in gone))


def bounded_sample(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Rows of the ``most`` smallest hashes of ``keys``, one row for each."""
    return sample_and_rest(rows, keys, most)[0]


def sample_and_rest(rows: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the ``most`` smallest hashes of ``keys``, one row for each; and all rows of larger hashes.

    Hashes are ranked first, alone, as the rows may be wide: what the last task of
    the ranking reads are ``most`` numbers from each task.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(*keys))
    ranked = hashed.select("_hash").distinct().orderBy("_hash").limit(most)
    last = ranked.agg(F.max("_hash")).first()[0]
    if last is None:
        return rows.filter("false"), rows.filter("false")
    kept = hashed.filter(F.col("_hash") <= F.lit(last))
    return kept.dropDuplicates(["_hash"]).drop("_hash"), hashed.filter(F.col("_hash") > F.lit(last)).drop("_hash")


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batch: pa.RecordBatch, most_bytes: int = 8_000_000):
    """Parts of a batch that hold about ``most_bytes`` each, or one long row."""
    rows = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every position of the ranges ``starts[i] .. + counts[i]``, and the range each one is of."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return starts[owner] + np.arange(len(owner)) - first[owner], owner


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of a key as text, modulo ``folds``."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def whole_groups(batches, key: str, least_rows: int = 50_000):
    """Tables of about ``least_rows`` rows or more that never cut a run of equal keys.

    The input must be sorted by ``key``, so that only one run is open at a time.
    """
    held, rows = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            rows += batch.num_rows
            if rows < least_rows:
                continue
        if not rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = table.num_rows
        if batch is not None:
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        held, rows = rest.to_batches(), rest.num_rows
