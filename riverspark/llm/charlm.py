"""Interpolated Kneser-Ney character models of several classes, in sorted hash arrays."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.llm.common import in_small_batches, slices, whole_groups
from riverspark.session import cut_lineage

_BLANK = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(text: str | None, order: int) -> np.ndarray:
    """Lower-case letters of a text with one blank between words, ``order - 1`` blanks in front.

    Empty when there is no letter.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character after a word becomes the blank
    chars = np.where(letter, points, _BLANK)[keep]
    tail = [_BLANK] if letter[-1] else []
    return np.concatenate([np.full(order - 1, _BLANK), chars, tail]).astype(np.uint64)


def grams(chars: np.ndarray, order: int) -> np.ndarray:
    """All runs of ``order`` characters, each packed into 64 bits: equal parts, last one lowest."""
    bits = np.uint64(64 // order)
    part = chars & np.uint64((1 << (64 // order)) - 1)
    n = len(chars) - order + 1
    packed = np.zeros(max(n, 0), np.uint64)
    for i in range(order):
        packed = (packed << bits) | part[i : i + len(packed)]
    return packed


def count_grams(labelled: DataFrame, order: int, room: int = 1_000_000) -> DataFrame:
    """``label``, ``gram``, ``n`` over all rows of ``text`` and ``label`` (a string).

    Tasks add up their own rows before the shuffle, and at every ``room`` grams.
    """

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def flush(last: bool):
            for label, parts in held.items():
                keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)
                held[label] = [(keys, n)]
                if last and len(keys):
                    names = ["label", "gram", "n"]
                    arrays = [pa.array([label] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for part in slices(batch, 1_000_000):
                for text, label in zip(*(c.to_pylist() for c in part.columns)):
                    found = grams(letters(text, order), order)
                    held.setdefault(label, []).append((found, np.ones(len(found))))
                    size += len(found)
                if size > room:
                    yield from flush(False)
                    distinct = sum(len(p[0][0]) for p in held.values())
                    if 2 * distinct > room:
                        yield from flush(True)
                        held.clear()
                        distinct = 0
                    size = distinct
        yield from flush(True)

    rows = in_small_batches(labelled).select("text", "label").mapInArrow(run, "label string, gram long, n long")
    return rows.groupBy("label", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Log probabilities of the grams of one length, and what an unseen one costs, by class."""

    keys: np.ndarray
    log: np.ndarray
    contexts: np.ndarray
    back: np.ndarray


@dataclass
class Model:
    labels: list[str]
    order: int
    levels: list[Level]  # level i has grams of i + 1 characters

    def score(self, packed: np.ndarray, longest: int | None = None) -> np.ndarray:
        """Natural log probability of each gram's last character, one column per class."""
        out = np.zeros((len(packed), len(self.labels)), np.float32)
        rows, bits = np.arange(len(packed)), np.uint64(64 // self.order)
        for length in range(longest or self.order, 0, -1):
            level = self.levels[length - 1]
            at, hit = _find(level.keys, packed)
            out[rows[hit]] += level.log[at[hit]]
            rows, packed = rows[~hit], packed[~hit]
            if not len(rows):
                return out
            at, hit = _find(level.contexts, packed >> bits)
            out[rows[hit]] += level.back[at[hit]]
            packed = packed & np.uint64((1 << (int(bits) * (length - 1))) - 1)
        out[rows] += np.log(1 / 65536)
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def gram_tables(counts: DataFrame, order: int, most: int) -> list[dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Per length, and per label, sorted grams and their Kneser-Ney counts.

    The longest grams keep their counts; a shorter one counts the different
    characters seen in front of it.  A length keeps at most ``most`` grams over
    all labels: where there are more, the smallest counts go, as in any pruned
    model, and are scored by what they back off to.  This and ``fit`` are for
    models that fit the driver; no query uses them, ``fit_shards`` keeps all grams.
    """
    bits = 64 // order
    tables = []
    for length in range(order, 0, -1):
        if length < order:
            rest = F.col("gram").bitwiseAND(F.lit((1 << (bits * length)) - 1))
            counts = counts.select("label", rest.alias("gram")).groupBy("label", "gram").agg(F.count("*").alias("n"))
        counts = cut_lineage(counts)
        # Counts under 1000 one by one, larger ones in 16 steps per doubling.
        step = F.when(F.col("n") < 1000, F.col("n")).otherwise(1000 + F.floor(F.log2(F.col("n") / 1000) * 16))
        often = counts.groupBy(step.alias("step")).agg(F.count("*").alias("c")).collect()
        left, least = sum(r["c"] for r in often), 0
        for r in sorted(often):
            if left <= most:
                break
            left, least = left - r["c"], r["step"]
        kept = counts.filter(step > least).toArrow()
        label = np.array(kept.column("label").to_pylist(), dtype=object)
        gram = kept.column("gram").to_numpy().view(np.uint64)
        n = kept.column("n").to_numpy().astype(np.float64)
        table = {}
        for name in sorted(set(label.tolist())):
            mine = label == name
            order_ = np.argsort(gram[mine], kind="stable")
            table[name] = (gram[mine][order_], n[mine][order_])
        tables.append(table)
    return tables[::-1]


def fit(tables: list[dict[str, tuple[np.ndarray, np.ndarray]]], order: int, shared: bool = False) -> Model:
    """Interpolated Kneser-Ney over all lengths; ``shared`` pools the classes below the longest."""
    labels = sorted({name for table in tables for name in table})
    bits = np.uint64(64 // order)
    levels: list[Level] = []
    none = (np.zeros(0, np.uint64), np.zeros(0))
    for length, table in enumerate(tables, 1):
        if shared and length < order:
            every = np.concatenate([table[k][0] for k in table] or [none[0]])
            keys, inverse = np.unique(every, return_inverse=True)
            pooled = (keys, np.bincount(inverse, np.concatenate([table[k][1] for k in table] or [none[1]]), len(keys)))
            table = dict.fromkeys(labels, pooled)
        keys = np.unique(np.concatenate([table.get(k, none)[0] for k in labels] or [none[0]]))
        contexts = np.unique(keys >> bits)
        log = np.zeros((len(keys), len(labels)), np.float32)
        back = np.zeros((len(contexts), len(labels)), np.float32)
        below = np.uint64((1 << (int(bits) * (length - 1))) - 1)
        lower = Model(labels, order, levels).score(keys & below, length - 1) if length > 1 else None
        for column, name in enumerate(labels):
            own, n = table.get(name, none)
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            total = np.zeros(len(contexts))
            kinds = np.zeros(len(contexts))
            at = np.searchsorted(contexts, own >> bits)
            np.add.at(total, at, n)
            np.add.at(kinds, at, 1)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            back[:, column] = np.log(weight)
            count = np.zeros(len(keys))
            count[np.searchsorted(keys, own)] = n
            at = np.searchsorted(contexts, keys >> bits)
            direct = np.where(count > 0, count - discount, 0) / np.maximum(total[at], 1)
            small = 1 / 65536 if lower is None else np.exp(lower[:, column])
            log[:, column] = np.log(direct + weight[at] * small)
        levels.append(Level(keys, log, contexts, back))
    return Model(labels, order, levels)


@dataclass
class Shard:
    """Sorted keys and a row of numbers for each, in a broadcast file."""

    sent: Broadcast
    held: bool  # stays in a worker's memory; others are read again for each group of texts

    def load(self) -> tuple[np.ndarray, np.ndarray]:
        path, context = getattr(self.sent, "_path", None), getattr(self.sent, "_sc", None)
        if self.held or path is None or context is not None and context._encryption_enabled:
            return self.sent.value
        return self.sent.load_from_path(path)


def _add(shards: list[Shard], out: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Add to ``out[rows]`` what the shards have for the wanted keys; which keys they have."""
    hit = np.zeros(len(wanted), bool)
    of = wanted.view(np.int64) % max(len(shards), 1)
    for number, shard in enumerate(shards):
        mine = np.flatnonzero(of == number)
        if len(mine):
            keys, log = shard.load()
            at, found = _find(keys, wanted[mine])
            out[rows[mine[found]]] += log[at[found]]
            hit[mine[found]] = True
    return hit


@dataclass
class ShardedModel:
    """All grams of a model.  Their number grows with the input, that of a shard does not."""

    labels: list[str]
    order: int
    levels: list[tuple[list[Shard], list[Shard]]]  # level i: grams of i + 1 characters, and their contexts

    def score(self, packed: np.ndarray) -> np.ndarray:
        """Natural log probability of each gram's last character, one column per class."""
        out = np.zeros((len(packed), len(self.labels)), np.float32)
        rows, bits = np.arange(len(packed)), np.uint64(64 // self.order)
        for length in range(self.order, 0, -1):
            own, contexts = self.levels[length - 1]
            hit = _add(own, out, rows, packed)
            rows, packed = rows[~hit], packed[~hit]
            if not len(rows):
                return out
            _add(contexts, out, rows, packed >> bits)
            packed = packed & np.uint64((1 << (int(bits) * (length - 1))) - 1)
        out[rows] += np.log(1 / 65536)
        return out


@dataclass
class Known:
    """Scores of all the grams of a few texts."""

    labels: list[str]
    keys: np.ndarray
    log: np.ndarray

    def score(self, packed: np.ndarray) -> np.ndarray:
        return self.log[np.searchsorted(self.keys, packed)]


def looked_up(model: ShardedModel, texts, most: int = 2_000_000):
    """The packed grams of each text, and scores that cover them.

    Texts of about ``most`` letters together look each of their different grams up once.
    """

    def flush():
        keys = np.unique(np.concatenate(held))
        known = Known(model.labels, keys, model.score(keys))
        for packed in held:
            yield packed, known

    held, size = [], 0
    for text in texts:
        held.append(grams(letters(text, model.order), model.order))
        size += len(held[-1])
        if size >= most:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _level(counts: DataFrame, labels: list[str], discounts: np.ndarray, bits: int) -> DataFrame:
    """``is_gram``, ``key``, ``direct``, ``weight``: of each gram its own share and the weight of what
    it backs off to, by label; of each context the weight alone.

    Rows of one context are one per label and following character, so no task
    gathers more than an alphabet for a key.
    """
    counts = counts.withColumn("context", F.shiftrightunsigned("gram", bits))
    counts = counts.repartition("context").sortWithinPartitions("context")
    names = ["is_gram", "key", "direct", "weight"]

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(labels), dtype=np.int32), pa.array(x.ravel()))

    def run(batches):
        for table in whole_groups(batches, "context"):
            column = pc.index_in(table.column("label"), pa.array(labels)).to_numpy()
            n = table.column("n").to_numpy().astype(np.float64)
            keys, row = np.unique(table.column("gram").to_numpy(), return_inverse=True)
            contexts, block = np.unique(table.column("context").to_numpy(), return_inverse=True)
            total, kinds = np.zeros((2, len(contexts), len(labels)))
            np.add.at(total, (block, column), n)
            np.add.at(kinds, (block, column), 1)
            weight = np.where(total > 0, discounts * kinds / np.maximum(total, 1), 1.0)
            count = np.zeros((len(keys), len(labels)))
            count[row, column] = n
            at = np.zeros(len(keys), np.int64)
            at[row] = block
            direct = np.where(count > 0, count - discounts, 0) / np.maximum(total[at], 1)
            for arrays in (
                [pa.array(np.ones(len(keys), bool)), pa.array(keys), lists(direct), lists(weight[at])],
                [pa.array(np.zeros(len(contexts), bool)), pa.array(contexts), lists(np.zeros_like(weight)), lists(weight)],
            ):
                yield pa.RecordBatch.from_arrays(arrays, names)

    return counts.select("label", "gram", "n", "context").mapInArrow(
        run, "is_gram boolean, key long, direct array<double>, weight array<double>"
    )


def _pooled(counts: DataFrame, labels: list[str]) -> DataFrame:
    """Counts of all labels together, given to each."""
    every = counts.groupBy("gram").agg(F.sum("n").alias("n"))
    return every.select(F.explode(F.array(*map(F.lit, labels))).alias("label"), "gram", "n")


def fit_shards(
    counts: DataFrame, order: int, shared: bool = False, shard_bytes: int = 64_000_000, held_bytes: int = 128_000_000
) -> ShardedModel:
    """The model of ``fit`` from all grams, however many.

    Counts and probabilities are tables; the driver sees discounts and one shard
    at a time.  A worker holds ``held_bytes`` of the model, the longest grams
    first, and one shard of about ``shard_bytes`` of the rest.
    """
    bits = 64 // order
    context = counts.sparkSession.sparkContext
    tables = [cut_lineage(counts)]
    for length in range(order - 1, 0, -1):
        rest = F.col("gram").bitwiseAND(F.lit((1 << (bits * length)) - 1))
        above = tables[-1].select("label", rest.alias("gram"))
        tables.append(cut_lineage(above.groupBy("label", "gram").agg(F.count("*").alias("n"))))
    labels = sorted(r["label"] for r in tables[-1].select("label").distinct().collect())
    if not labels:
        return ShardedModel([], order, [([], [])] * order)
    scored: list[DataFrame] = []
    for length, table in enumerate(tables[::-1], 1):
        if shared and length < order:
            table = _pooled(table, labels)
        rare = [F.count_if(F.col("n") == i).alias(name) for i, name in ((1, "ones"), (2, "twos"))]
        few = {r["label"]: (r["ones"], r["twos"]) for r in table.groupBy("label").agg(*rare).collect()}
        discounts = np.array([a / (a + 2 * b) if a and b else 0.5 for a, b in (few[name] for name in labels)])
        level = _level(table, labels, discounts, bits)
        if length == 1:
            level = level.withColumn("lower", F.array_repeat(F.lit(float(np.log(1 / 65536))), len(labels)))
        else:
            below = scored[-1].filter("is_gram").select(F.col("key").alias("suffix"), F.col("log").alias("lower"))
            # Every gram's end is a gram of the level below; contexts find nothing to add.
            suffix = F.when(F.col("is_gram"), F.col("key").bitwiseAND(F.lit((1 << (bits * (length - 1))) - 1)))
            level = level.withColumn("suffix", suffix).join(below, "suffix", "left")
        log = F.expr(
            "if(is_gram, zip_with(direct, zip_with(weight, lower, (w, l) -> w * exp(l)), (d, b) -> float(ln(d + b))),"
            " transform(weight, w -> float(ln(w))))"
        )
        scored.append(cut_lineage(level.select("is_gram", "key", log.alias("log"))))
    room = held_bytes

    def shards(table: DataFrame) -> list[Shard]:
        nonlocal room
        width = 8 + 4 * len(labels)
        number = -(-table.count() * width // shard_bytes) | 1  # odd: packed characters have even periods
        found = []
        for i in range(number):
            part = table.filter(F.pmod("key", F.lit(number)) == i).select("key", "log").toArrow().combine_chunks()
            keys = part.column("key").to_numpy().view(np.uint64)
            log = part.column("log").combine_chunks().flatten().to_numpy().reshape(len(keys), len(labels))
            by = np.argsort(keys, kind="stable")
            room -= len(keys) * width
            found.append(Shard(context.broadcast((keys[by], log[by])), room >= 0))
        return found

    levels = [(shards(t.filter("is_gram")), shards(t.filter("not is_gram"))) for t in scored[::-1]]
    return ShardedModel(labels, order, levels[::-1])
