"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.llm.charlm import Known, ShardedModel, count_grams, fit_shards, looked_up
from riverspark.llm.common import column, in_small_batches, slices, without

UNDETERMINED = "und"
ORDER = 4


@dataclass
class Identifier:
    model: ShardedModel
    limit: np.ndarray  # cross-entropy a text of each language stays under
    spread: np.ndarray  # and how much more a short text may have, over the square root of its length

    def judge(self, packed: np.ndarray, known: Known) -> tuple[str, float, bool]:
        """Language of the lowest cross-entropy per letter, confidence, and whether it is rejected."""
        if not len(packed) or not self.model.labels:
            return UNDETERMINED, 0.0, True
        entropy = cross_entropy(known, packed)
        best = int(entropy.argmin())
        # Posterior with equal priors, of at most 64 letters' worth of evidence.
        odds = np.exp((entropy[best] - entropy) * min(len(packed), 64))
        unlike = entropy[best] > self.limit[best] + self.spread[best] / np.sqrt(len(packed))
        return self.model.labels[best], float(1 / odds.sum()), bool(unlike)


def cross_entropy(model: Known, packed: np.ndarray) -> np.ndarray:
    """Mean negative log probability of a text's letters under each class; long texts in parts."""
    total = np.zeros(len(model.labels))
    for at in range(0, len(packed), 200_000):
        total -= model.score(packed[at : at + 200_000]).sum(axis=0, dtype=np.float64)
    return total / len(packed)


def train(labelled: DataFrame, shard_bytes: int = 64_000_000) -> Identifier:
    """Models of all values of ``label`` from all rows of ``text`` and ``label``; NULLs teach nothing.

    Counts cover every row, and no gram is left out.  The rejection limit is fitted on every
    text of 100 letters or more: the largest cross-entropy under the own language
    among them, half as much again, and for short texts four standard deviations
    of a letter more.
    """
    labelled = labelled.filter("text is not null and label is not null").select("text", "label")
    model = fit_shards(count_grams(labelled, ORDER), ORDER, shard_bytes=shard_bytes)
    worst = largest_entropies(labelled, model)
    usual = max(worst.values(), default=np.log(65536))
    limit = np.array([1.5 * worst.get(label, usual) for label in model.labels])
    return Identifier(model, limit, np.full(len(limit), 4 * 3.0))


def largest_entropies(labelled: DataFrame, model: ShardedModel, least_letters: int = 100) -> dict[str, float]:
    """The largest cross-entropy under the own label, per label, of all texts of so many letters.

    Tasks keep one number per label.
    """

    def run(batches):
        worst: dict[str, float] = {}
        for batch in batches:
            for part in slices(batch):
                texts = looked_up(model, column(part, "text"))
                for (packed, known), label in zip(texts, column(part, "label")):
                    if len(packed) >= least_letters:
                        entropy = float(cross_entropy(known, packed)[model.labels.index(label)])
                        worst[label] = max(worst.get(label, 0.0), entropy)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(worst), pa.string()), pa.array(list(worst.values()), pa.float64())], ["label", "entropy"]
        )

    found = in_small_batches(labelled).mapInArrow(run, "label string, entropy double")
    return {r["label"]: r["most"] for r in found.groupBy("label").agg(F.max("entropy").alias("most")).collect()}


def identify(
    docs: DataFrame,
    identifier: Identifier,
    text_col: str = "text",
    names: tuple[str, str, str] = ("lang_pred", "score", "rejected"),
) -> DataFrame:
    """All columns of ``docs``, and ``lang_pred``, ``score`` (0 to 1) and ``rejected``; no shuffle.

    ``lang_pred`` is a learned label, or ``und`` with score 0 for NULL and for
    texts without a letter.  ``rejected`` marks these, and texts unlike every
    learned language.  Columns of ``docs`` with the new names are replaced.
    """
    docs = without(in_small_batches(docs), names)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch):
                texts = looked_up(identifier.model, part.column(at).to_pylist())
                found = [identifier.judge(packed, known) for packed, known in texts]
                arrays = [pa.array(x, k) for x, k in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *names])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")
