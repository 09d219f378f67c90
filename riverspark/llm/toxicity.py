"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.llm.blocks import bitmap, has_bit
from riverspark.llm.charlm import Known, ShardedModel, count_grams, fit_shards, looked_up
from riverspark.llm.common import in_small_batches, sample_and_rest, slices, without
from riverspark.session import shared_folder

ORDER = 5
_STRETCH = 200_000


def evidence(model: Known, packed: np.ndarray) -> np.ndarray | None:
    """What the two models say about a text; None when it has no letter.

    Mean log-likelihood ratio per letter, that of the strongest word, the mean of
    the three strongest, and the logarithm of the number of words.  Words are
    scored whole: rare ones share letters with known ones, and where a class has
    not seen a context both classes use the same backoff counts.
    """
    if not len(packed):
        return None
    toxic, other = model.labels.index("1"), model.labels.index("0")
    ratio = np.empty(len(packed))
    for at in range(0, len(packed), _STRETCH):
        log = model.score(packed[at : at + _STRETCH])
        ratio[at : at + _STRETCH] = log[:, toxic] - log[:, other]
    blank = packed & np.uint64((1 << (64 // ORDER)) - 1) == 32
    starts = np.r_[0, np.flatnonzero(blank)[:-1] + 1]
    words = np.add.reduceat(ratio, starts)
    best = np.sort(words[np.argpartition(-words, min(3, len(words)) - 1)[:3]])[::-1]
    return np.array([ratio.mean(), best[0], best.mean(), np.log1p(len(words))])


@dataclass
class Scorer:
    model: ShardedModel
    weights: np.ndarray  # of the evidence, intercept last
    prior: float

    def score(self, packed: np.ndarray, known: Known) -> float:
        found = evidence(known, packed) if len(self.model.labels) == 2 else None
        if found is None:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(found @ self.weights[:-1] + self.weights[-1], -500, 500))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and intercept of a logistic regression, by Newton steps on scaled columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w[:-1] /= scale
    w[-1] -= w[:-1] @ mean
    return w


def labelled_texts(docs: DataFrame, labels: DataFrame, bits: int = 26) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` ("0" or "1") of the labelled rows.

    A bitmap of fixed size holds the labelled ids, so that the texts of other
    rows are dropped before the join.  Labels grow with the documents: the join
    never broadcasts them, also where they happen to be few.  A document has one
    label: it is toxic if any of its rows in ``labels`` says so, NULLs say nothing.
    Documents that repeat a doc_id each have its label.  The result is written once,
    as it is read for the sample, the counts and the decision.
    """
    labels = labels.filter("doc_id is not null and toxic is not null")
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic") != 0).alias("toxic"))
    labels = labels.select("doc_id", F.expr("string(int(toxic))").alias("label"))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(labels.select(F.xxhash64("doc_id").alias("h")), "h", bits))

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(has_bit(sent.value, batch.column(2).to_numpy())))

    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("h", F.xxhash64("doc_id"))
    known = rows.mapInArrow(keep, "doc_id long, text string, h long").join(labels.hint("merge"), "doc_id").drop("h")
    folder = f"{shared_folder(docs.sparkSession)}/labelled-{uuid.uuid4().hex}"
    known.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema("doc_id long, text string, label string").parquet(folder)


def train(
    learn: DataFrame, calibrate: DataFrame, calibration_rows: int = 5000, shard_bytes: int = 64_000_000
) -> Scorer:
    """The decision from at most ``calibration_rows`` of ``calibrate``; models from all other rows of both.

    Both have ``text`` and ``label``.  The two must be disjoint: texts the models
    have seen look surer than new ones.  The different texts with the smallest
    hashes decide, and neither they nor their copies in ``calibrate`` are counted.  Without both classes every text gets the share of toxic rows.
    """
    some, rest = sample_and_rest(calibrate.select("text", "label"), ["text", "label"], calibration_rows)
    some, learn = some.toArrow(), learn.select("text", "label").union(rest)
    model = fit_shards(count_grams(learn, ORDER), ORDER, shared=True, shard_bytes=shard_bytes)
    truth = np.array([int(label) for label in some.column("label").to_pylist()], float)
    prior = float(min(truth.mean(), 0.49)) if len(truth) else 0.0
    if len(model.labels) < 2:
        return Scorer(model, np.zeros(5), prior)
    found = [evidence(known, packed) for packed, known in looked_up(model, some.column("text").to_pylist())]
    usable = np.array([f is not None for f in found], bool)
    if len(set(truth[usable].tolist())) < 2:
        return Scorer(model, np.array([0, 0, 0, 0, np.log((prior + 1e-6) / (1 - prior))]), prior)
    return Scorer(model, logistic(np.array([f for f in found if f is not None]), truth[usable]), prior)


def score_texts(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, ``score`` (0 to 1, higher: toxic is likelier) and ``predicted``; no shuffle.

    NULL and texts without a letter get the share of toxic rows among those
    learned from, at most 0.49.  Columns of ``docs`` with the new names are replaced.
    """
    docs = without(in_small_batches(docs), ("score", "predicted"))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch):
                texts = looked_up(scorer.model, part.column(at).to_pylist())
                scores = np.array([scorer.score(packed, known) for packed, known in texts], float)
                arrays = [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, "score", "predicted"])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, score double, predicted int")
