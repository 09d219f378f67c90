"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of their input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverspark.llm import contamination, language, packing, personal, simhash
from riverspark.llm.queries import learned_languages
from riverspark.session import shared_folder

#: Names no input column has: results of a stage stay clear of the table's own columns.
_MARK = "_stage_"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and texts unlike every learned language; all columns stay as they are."""
    names = tuple(_MARK + n for n in ("lang", "score", "rejected"))
    judged = language.identify(docs, learned_languages(docs), names=names)
    return judged.filter(~F.col(names[2])).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group, judged by rows: the smallest doc_id, in one of its texts.

    The stage links fingerprints of 3-word shingles at 3 differing bits or fewer;
    texts that share 80 % of their five-word shingles often differ in more and stay.
    Rows without doc_id belong to no group and stay.
    """
    return simhash.one_of_each_group(docs)


def no_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold most of a benchmark item."""
    return contamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in place of every span of personal data; ``n_chars`` follows where the text changed."""
    found = personal.personal_data(docs, spans_col=_MARK + "spans", redacted_col="text")
    if "n_chars" in docs.columns:
        changed = F.size(_MARK + "spans") > 0
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut all documents into token pieces and place them in sequences of 2048."""
    return packing.pack_documents(docs, with_ids=False)


STAGES = [
    ("language", known_language),
    ("near_dedup", one_of_each_group),
    ("decontamination", no_benchmark_items),
    ("personal_data", no_personal_data),
    ("packing", packed),
]

#: Fingerprints, tokenizers and language models are beyond SQL; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
