"""Scans and sinks: CSV, Parquet, multi-file globs, landed flow tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverspark.columns import as_list
from riverspark.session import shared_folder


def read_table(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """A1: scan a table; CSV needs an explicit schema, Parquet carries its own.

    The CSV scan takes the first line as header and strips a UTF-8 byte-order
    mark.  Blank fields become NULL.
    """
    first = path if isinstance(path, str) else path[0]
    if first.rstrip("/").endswith(".csv"):
        if schema is None:
            raise ValueError("CSV needs an explicit schema")
        return (
            spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", True)
            .option("encoding", "UTF-8")
            .option("timestampFormat", "yyyy-MM-dd H:mm:ss")
            .csv(path)
        )
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path) if isinstance(path, str) else reader.parquet(*path)


def read_csv_skip(
    spark: SparkSession, path: str, n: int, schema: T.StructType, header: bool = True
) -> DataFrame:
    """A2: scan CSV files whose first ``n`` lines are preamble.

    Lines are read as splittable text.  Each task drops the head of a file only
    in the split that starts at byte 0, so large files still scan in parallel;
    the preamble must fit in that first split.
    """
    drop = n + int(header)
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )

    def skip_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            starts = batch.column(2).to_numpy()
            files = batch.column(1).dictionary_encode()
            codes = files.indices.to_numpy()
            moved = (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])
            edges = [0, *(np.flatnonzero(moved) + 1), len(codes)]
            keep = np.ones(batch.num_rows, dtype=bool)
            # One turn per file split that the batch touches, not per line.
            for lo, hi in zip(edges, edges[1:]):
                split = (files.dictionary[int(codes[lo])].as_py(), int(starts[lo]))
                if split != current:
                    current, seen = split, 0
                if split[1] == 0 and seen < drop:
                    cut = min(hi - lo, drop - seen)
                    keep[lo : lo + cut] = False
                    seen += cut
            yield batch.select([0]).filter(pa.array(keep))

    parsed = F.from_csv("value", schema.simpleString()[len("struct<") : -1].replace(":", " "))
    return (
        lines.mapInArrow(skip_head, "value string")
        .filter(F.trim("value") != "")
        .select(parsed.alias("row"))
        .select("row.*")
    )


def read_many(spark: SparkSession, path_glob: str, schema: T.StructType | str) -> DataFrame:
    """A3: scan every file of a glob and keep the file name as ``source``."""
    is_csv = path_glob.rstrip("/").endswith(".csv")
    reader = spark.read.schema(schema)
    scan = reader.option("header", True).csv(path_glob) if is_csv else reader.parquet(path_glob)
    return scan.select("*", F.col("_metadata.file_name").alias("source"))


def append(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; columns a table lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def stack_tables(tables: Iterable[DataFrame], schema: T.StructType) -> DataFrame:
    """A5: stack tables whose column types differ, under one target schema.

    Values that do not parse become NULL instead of failing the job.
    """

    def conform(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(
            *(
                (F.col(f.name).cast("string") if f.name in have else F.lit(None).cast("string"))
                .try_cast(f.dataType)
                .alias(f.name)
                for f in schema.fields
            )
        )

    return append(*(conform(df) for df in tables))


def daily_values(
    df: DataFrame,
    stations: DataFrame | None = None,
    parameter: str = "Flow",
    *,
    key: str = "station",
    parameter_col: str = "parameter",
) -> DataFrame:
    """Values of one parameter for the listed stations, from a landed table."""
    kept = df.filter(F.col(parameter_col) == parameter)
    if stations is None:
        return kept
    return kept.join(stations.select(key).distinct(), key, "left_semi")


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: str | Iterable[str] | None = None,
) -> None:
    """Write a result table as a folder, replacing an earlier run."""
    writer = df.write.mode("overwrite")
    if partition_by is not None:
        writer = writer.partitionBy(*as_list(partition_by))
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_bucketed(
    df: DataFrame, name: str, keys: str | Iterable[str], buckets: int = 64, order: str | Iterable[str] | None = None
) -> DataFrame:
    """Write a table in hash buckets of ``keys``, sorted inside them, and return its scan.

    Tables with the same number of buckets on the same keys join and aggregate on
    them without an exchange, as often as they are read.  Rows are dealt out by
    bucket before they are written, so there is one file for each.  Use keys that
    spread a hot series, such as station and year.  The files lie in the shared
    folder; a table of the same name is replaced.
    """
    names = as_list(keys)
    spark = df.sparkSession
    writer = df.repartition(buckets, *names).write.mode("overwrite").format("parquet").bucketBy(buckets, *names)
    writer = writer.sortBy(*names, *as_list(order)).option("path", f"{shared_folder(spark)}/{name}")
    writer.saveAsTable(name)
    return spark.table(name)
