"""Token ids of whole texts with a public tokenizer, and exact length statistics."""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverspark.llm.common import column, slices, texts
from riverspark.session import cut_lineage

#: Letters that are one character and two bytes in any normal form, besides a-z and A-Z.
_LATIN = "\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Runs between white space, which the tokenizer drops and no token reaches
#: across.  Punctuation that ends a run behind a letter is cut off as well.
_RUN = re.compile(rf"[A-Za-z{_LATIN}]+(?=[,.!?;:*%$#&]+(?:[ \t\n\r]|\Z))|[^ \t\n\r]+")
_WORD = re.compile(rf"[A-Za-z{_LATIN}]+")
#: A run that is one token wherever it stands alone, and part of no other token.
_MARK = "\x00"


def byte_letters() -> dict[int, str]:
    """How byte-level tokenizers spell the letters of ``_WORD``: one printable character a byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    spelled = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(192, 256)}


class RunCoder:
    """Encodes a text run by run between white space and remembers runs.

    The ids of a text are the ids of its runs one after the other.  Runs of
    letters are one word to the tokenizer and go straight to its merges; other
    new runs are encoded many at a time, with a mark between them.  At most
    ``room`` runs are remembered, and none over 64 characters; what is not is
    encoded again.
    """

    def __init__(self, path: str, room: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        (self.mark,) = self._ids(_MARK)
        self.room = room
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, runs: list[str]) -> None:
        mixed, known = [], self.known
        for run in runs:
            if _WORD.fullmatch(run):
                word = run.lower().translate(self.letters)
                known[run] = array("I", [t.id for t in self.merge(word)]).tobytes()
            elif _MARK in run:
                known[run] = self._ids(run).tobytes()
            else:
                mixed.append(run)
        for at in range(0, len(mixed), 1000):
            part = mixed[at : at + 1000]
            ids = self._ids(f" {_MARK} ".join(part))
            cuts = (4 * np.flatnonzero(ids == self.mark)).tolist()
            data = ids.tobytes()
            self.known.update(
                (run, data[i:j]) for run, i, j in zip(part, [0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)
            )

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, as one byte string."""
        split = [_RUN.findall(t or "") for t in texts]
        all_runs = set().union(*split)
        new = all_runs - self.known.keys()
        if len(new) + len(self.known) > self.room:
            self.known.clear()
            new = all_runs
        new = list(new)
        self._learn(new)
        ids = [b"".join(map(self.known.__getitem__, runs)) for runs in split]
        for run in new:
            if len(run) > 64 or len(self.known) > self.room:
                del self.known[run]
        return ids


@lru_cache(maxsize=1)
def coder(tokenizer: str) -> RunCoder:
    """One coder per Python worker; ``tokenizer`` is a path or the name of a public file."""
    if os.sep not in tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    return RunCoder(tokenizer)


def length_histogram(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``length`` and ``docs``: how many texts encode to so many ids, exactly.

    NULL and empty texts have length 0.  Every task counts its own rows first.
    """

    def run(batches):
        counts: Counter[int] = Counter()
        for batch in batches:
            for part in slices(batch):
                counts.update(len(ids) // 4 for ids in coder(tokenizer).encode(column(part, "text")))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["length", "docs"]
        )

    counted = texts(docs, id_col, text_col).mapInArrow(run, "length long, docs long")
    return counted.groupBy("length").agg(F.sum("docs").alias("docs"))


def context_limits(histogram: DataFrame, band: int = 256) -> DataFrame:
    """What every context limit costs, one row per length that occurs.

    For the limit ``length``: ``docs`` of exactly this length, ``docs_over`` and
    ``tokens_over`` of longer ones, ``docs_total``, ``tokens_total``,
    ``tokens_kept`` when every text is cut to the limit, ``tokens_cut``, and
    ``quantile``, the share of texts that fit.  A limit between two lengths has
    the ``docs_over`` of the lower one, and keeps ``docs_over`` tokens more per
    step.  An empty histogram gives no rows.

    Suffix sums run inside bands of ``band`` lengths and once over the band
    totals, so no task holds all lengths.
    """
    # Written once: the texts behind it are encoded for one of the two uses below only.
    rows = cut_lineage(histogram).withColumn("band", F.floor(F.col("length") / band))
    tokens = F.sum(F.col("docs") * F.col("length"))
    # The window below sees one row per band: the longest text over ``band``.
    bands = rows.groupBy("band").agg(F.sum("docs").alias("d"), tokens.alias("t"))
    over = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = bands.select(
        "band",
        F.coalesce(F.sum("d").over(over), F.lit(0)).alias("_d"),
        F.coalesce(F.sum("t").over(over), F.lit(0)).alias("_t"),
        F.sum("d").over(every).alias("docs_total"),
        F.sum("t").over(every).alias("tokens_total"),
    )
    above = Window.partitionBy("band").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(bands, "band").select(
        "length",
        "docs",
        (F.coalesce(F.sum("docs").over(above), F.lit(0)) + F.col("_d")).alias("docs_over"),
        (F.coalesce(F.sum(F.col("docs") * F.col("length")).over(above), F.lit(0)) + F.col("_t")).alias("tokens_over"),
        "docs_total",
        "tokens_total",
    )
    kept = F.col("tokens_total") - F.col("tokens_over") + F.col("docs_over") * F.col("length")
    return out.select(
        "*",
        kept.alias("tokens_kept"),
        (F.col("tokens_total") - kept).alias("tokens_cut"),
        ((F.col("docs_total") - F.col("docs_over")) / F.col("docs_total")).alias("quantile"),
    )
