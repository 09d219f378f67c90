"""Group spelling variants: words one edit apart, found by FM-index search schemes over the vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.llm.common import spread
from riverspark.session import cut_lineage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes in an interval that are followed one by one instead of letter by letter.
_FEW = 32
_BIG_KEYS = 100_000


def word_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = 5,
    least_count: int = 3,
    lost_every: int | None = 97,
) -> DataFrame:
    """``word`` and its number of occurrences ``n``: runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower case.

    With ``lost_every`` a run whose crc32 of ``<id>:<run>`` that number divides
    loses its code point crc32 % length; a NULL id is written as nothing.  Rows
    with NULL text hold no words, repeated rows count each time.  All other
    columns are left unread.
    """
    text = F.translate(F.col(text_col), _UPPER, _LOWER)
    # Shorter runs stay shorter, so they need not be taken out of the text.
    runs = F.regexp_extract_all(text, F.lit(f"[a-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))
    found = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")
    )
    word = F.col("run")
    if lost_every:
        draw = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        place = (draw % F.length("run")).cast("int")
        shorter = F.concat(F.col("run").substr(F.lit(1), place), F.expr("substring(run, place + 2)"))
        found = found.withColumn("draw", draw).withColumn("place", place)
        word = F.when(F.col("draw") % lost_every == 0, shorter).otherwise(word)
    counted = found.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.col("n") >= least_count) & (F.length("word") >= least_length))


class Index:
    """An FM-index of distinct words, each ended by its own terminal; terminals sort first, by word.

    ``before`` is the letter in front of each suffix (0: the suffix is a whole
    word) in suffix order, ``step`` the suffix with that letter added, ``left``
    the number of letters in front.
    """

    def __init__(self, words: list[str]):
        codes = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.uint32)
        self.letters, text = np.unique(codes, return_inverse=True)
        ends = np.flatnonzero(text == 0)
        size, count = len(text), len(words)
        starts = np.concatenate([[0], ends[:-1] + 1]) if count else ends
        owner = np.repeat(np.arange(count), ends - starts + 1)
        places = _suffix_order(text, ends, owner)
        self.left = (places - starts[owner[places]]).astype(np.int32)
        self.word = owner[places]
        self.before = np.where(self.left > 0, text[places - 1], 0).astype(np.int32)
        order = np.argsort(self.before, kind="stable")
        self.step = np.empty(size, np.int64)
        self.step[order] = np.arange(size)
        self.order, self.size, self.count = order, size, count
        # Sorted (letter, suffix) pairs: a binary search in them is the rank of any letter at any suffix.
        self.pairs = self.before[order].astype(np.int64) * (size + 1) + order

    def add(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals after a letter is put in front."""
        base = letter.astype(np.int64) * (self.size + 1)
        return np.searchsorted(self.pairs, base + low), np.searchsorted(self.pairs, base + high)

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters of words as the index numbers them (-1: not in it), where each word starts, and its length."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        lengths = np.array([len(w) for w in words], np.int64)
        return np.where(self.letters[at] == codes, at, -1), np.cumsum(lengths) - lengths, lengths

    def near(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of a word given, number of an indexed word one edit away).

        The last ``exact`` letters must agree; one letter in front of them is
        added, lost or replaced.
        """
        text, starts, lengths = self.coded(words)
        asked = np.arange(len(words))
        at = lengths - 1
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.count)
        # The half that must agree, from its end.
        done = []
        while len(asked):
            ready = lengths[asked] - 1 - at >= exact[asked]
            done.append((asked[ready], at[ready], low[ready], high[ready]))
            asked, at, low, high = asked[~ready], at[~ready], low[~ready], high[~ready]
            low, high = self.add(text[starts[asked] + at], low, high)
            alive = low < high
            asked, at, low, high = asked[alive], at[alive] - 1, low[alive], high[alive]
        wide = tuple(np.concatenate(c) for c in zip(*done)) if done else (asked, at, low, high)
        wide = (*wide, np.zeros(len(wide[0]), bool))
        letter = lambda q, p: np.where(p >= 0, text[starts[q] + np.maximum(p, 0)], -1)
        found, singles = [], []
        while len(wide[0]):
            wide, few, hits = self._widen(wide, letter)
            singles.append(few)
            found.append(hits)
        if singles:
            state = tuple(np.concatenate(c) for c in zip(*singles))
            while len(state[0]):
                state, hits = self._follow(state, letter)
                found.append(hits)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate([q * max(self.count, 1) + w for q, w in found]))
        return both // max(self.count, 1), both % max(self.count, 1)

    def _widen(self, state, letter):
        """One step of intervals: the letter asked for, and where no edit was made yet, each possible edit."""
        q, p, low, high, edited = state
        small = high - low <= _FEW
        rows, of = spread(low[small], (high - low)[small])
        few = (q[small][of], p[small][of], rows, edited[small][of])
        q, p, low, high, edited = (c[~small] for c in state)
        # Read to the front after an edit: the suffix that is a whole word, if one of the interval is.
        over = edited & (p < 0)
        first, last = self.add(np.zeros(over.sum(), np.int64), low[over], high[over])
        hit = first < last
        hits = (q[over][hit], self.word[self.order[first[hit]]])
        go = p >= 0
        a, b = self.add(letter(q, p)[go], low[go], high[go])
        out = [(q[go], p[go] - 1, a, b, edited[go])]
        fresh = ~edited
        drop = fresh & go
        out.append((q[drop], p[drop] - 1, low[drop], high[drop], np.ones(drop.sum(), bool)))
        kinds = len(self.letters) - 1
        new = np.tile(np.arange(1, kinds + 1), fresh.sum())
        fq, fp, fl, fh = (np.repeat(c[fresh], kinds) for c in (q, p, low, high))
        a, b = self.add(new, fl, fh)
        made = np.ones(len(new), bool)
        out.append((fq, fp, a, b, made))
        other = (fp >= 0) & (new != letter(fq, fp))
        out.append((fq[other], fp[other] - 1, a[other], b[other], made[other]))
        wide = tuple(np.concatenate(c) for c in zip(*out))
        alive = wide[2] < wide[3]
        return tuple(c[alive] for c in wide), few, hits

    def _follow(self, state, letter):
        """One step of single suffixes; what is left in front decides which edit can still be made."""
        q, p, row, edited = state
        extra = self.left[row] - (p + 1)
        fits = np.where(edited, extra == 0, abs(extra) <= 1)
        q, p, row, edited, extra = q[fits], p[fits], row[fits], edited[fits], extra[fits]
        over = edited & (p < 0)
        hits = (q[over], self.word[row[over]])
        q, p, row, edited, extra = q[~over], p[~over], row[~over], edited[~over], extra[~over]
        before, asked = self.before[row], letter(q, p)
        same = (p >= 0) & (before == asked)
        fresh = ~edited
        out = [(q[same], p[same] - 1, self.step[row[same]], edited[same])]
        for edit, moved, stepped in (
            (fresh & (extra == 0) & (before > 0) & ~same, 1, True),
            (fresh & (extra == 1), 0, True),
            (fresh & (extra == -1), 1, False),
        ):
            to = self.step[row[edit]] if stepped else row[edit]
            out.append((q[edit], p[edit] - moved, to, np.ones(edit.sum(), bool)))
        return tuple(np.concatenate(c) for c in zip(*out)), hits


def _suffix_order(text: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, each read up to its word's terminal; ranks of doubled lengths."""
    size, count = len(text), len(ends)
    rank = text.astype(np.int64) + count
    rank[ends] = np.arange(count)
    reach = 1
    while True:
        ahead = np.arange(size) + reach
        second = np.where(ahead <= ends[owner], rank[np.minimum(ahead, size - 1)], 0) if size else rank
        pair = rank * (size + count + len(text) + 1) + second
        order = np.argsort(pair, kind="stable")
        new = np.concatenate([[True], pair[order][1:] != pair[order][:-1]])[:size]
        ranks = np.cumsum(new) - 1
        rank = np.empty(size, np.int64)
        rank[order] = ranks
        if new.all():
            return order
        reach *= 2


def _near_in_bucket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Per word asked for: near words in this bucket, and the most frequent of them.

    ``front`` buckets match the first half and edit behind it: both sides are
    read backwards.  ``back`` buckets match the last half; what the other search
    finds as well, words with the same first half, is left out there.
    """
    front = key[0].as_py() == "front"
    words, counts, asks = (table.column(c).to_pylist() for c in ("word", "n", "asked"))
    indexed = dict(sorted((w, n) for w, n, a in zip(words, counts, asks) if not a))
    names, n = list(indexed), np.fromiter(indexed.values(), np.int64, len(indexed))
    queries = [w for w, a in zip(words, asks) if a]
    out = {"word": [], "n_near": [], "form_n": [], "form": []}
    index = Index([w[::-1] for w in names] if front else names) if names and queries else None
    for start in range(0, len(queries) if index else 0, 16_384):
        part = queries[start : start + 16_384]
        halves = np.array([len(w) // 2 if front else len(w) - len(w) // 2 for w in part])
        asked, hit = index.near([w[::-1] for w in part] if front else part, halves)
        if not front:
            new = [not names[h].startswith(part[a][: len(part[a]) // 2]) for a, h in zip(asked.tolist(), hit.tolist())]
            asked, hit = asked[np.array(new, bool)], hit[np.array(new, bool)]
        order = np.lexsort((hit, -n[hit], asked))
        first = order[np.searchsorted(asked[order], np.unique(asked))]
        out["word"] += [part[a] for a in asked[first]]
        out["n_near"] += np.bincount(asked, minlength=len(part))[asked[first]].tolist()
        out["form_n"] += n[hit[first]].tolist()
        out["form"] += [names[h] for h in hit[first]]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})


def near_words(vocabulary: DataFrame, bucket_words: int = 50_000) -> DataFrame:
    """``word``, ``n_near``, ``form_n``, ``form``: one row or two per word that has near words.

    Two words one edit apart agree on the first half of either, or on its last
    half.  A word is indexed under the halves that words of its length, one more
    or one less have, and asks under its own two; equal halves share a bucket.  A
    half with more than ``bucket_words`` words is split, and asks in all its
    parts.  Every pair is found by one of the two searches only, so counts add up.
    """
    buckets = 1 + vocabulary.count() * 2 // bucket_words
    size, word = F.length("word"), F.col("word")
    lengths = F.array_distinct(F.array(size - 1, size, size + 1))
    fronts = F.array_distinct(F.transform(lengths, lambda n: F.floor(n / 2).cast("int")))
    backs = F.array_distinct(F.transform(lengths, lambda n: F.ceil(n / 2).cast("int")))

    def under(kind: str, parts, asked: bool) -> DataFrame:
        cut = F.expr("left(word, part)" if kind == "front" else "right(word, part)")
        spread_out = vocabulary.select("word", "n", F.explode(parts).alias("part"))
        return spread_out.select(F.lit(kind).alias("kind"), cut.alias("half"), "word", "n", F.lit(asked).alias("asked"))

    indexed = under("front", fronts, False).union(under("back", backs, False))
    own = under("front", F.array(F.floor(size / 2).cast("int")), True).union(
        under("back", F.array(F.ceil(size / 2).cast("int")), True)
    )
    crowded = indexed.groupBy("kind", "half").agg(F.ceil(F.count("*") / bucket_words).cast("int").alias("parts"))
    crowded = cut_lineage(crowded.filter("parts > 1"))
    if crowded.count() <= _BIG_KEYS:
        crowded = F.broadcast(crowded)

    def dealt(rows: DataFrame, salt) -> DataFrame:
        rows = rows.join(crowded, ["kind", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        alone = F.col("parts") > 1
        return rows.withColumn("salt", salt).select(
            "kind",
            F.when(alone, F.lit(-1)).otherwise(F.pmod(F.xxhash64("half"), F.lit(buckets)).cast("int")).alias("bucket"),
            F.when(alone, F.col("half")).alias("crowd"),
            "salt",
            "word",
            "n",
            "asked",
        )

    rows = dealt(indexed, F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).union(
        dealt(own, F.explode(F.expr("sequence(0, parts - 1)")))
    )
    return rows.groupBy("kind", "bucket", "crowd", "salt").applyInArrow(
        _near_in_bucket, "word string, n_near long, form_n long, form string"
    )


def spelling_variants(vocabulary: DataFrame, ratio: int = 2, bucket_words: int = 50_000) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of a table of distinct words with counts ``n``.

    ``form`` is the near word of largest n (ties: smallest in code-point order)
    if that n is ``ratio`` times the word's or more, else NULL; ``root`` follows
    forms to the last.  An empty vocabulary gives no rows.
    """
    vocabulary = cut_lineage(vocabulary.select("word", "n"))
    near = near_words(vocabulary, bucket_words).select(
        "word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("form_n")).alias("less"), "form").alias("best")
    )
    none = F.lit(None).cast("struct<less:bigint,form:string>")
    every = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.alias("best")).union(near)
    best = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("b"))
    best = best.select("word", "n", "n_near", (-F.col("b.less")).alias("m"), F.col("b.form").alias("f"))
    holds = F.col("m") >= ratio * F.col("n")
    table = cut_lineage(
        best.select("word", "n", "n_near", F.when(holds, F.col("f")).alias("form"), F.when(holds, F.col("m")).alias("form_n"))
    )
    roots = _last_forms(table.filter("form is not null").select("word", F.col("form").alias("root")))
    return table.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def _last_forms(roots: DataFrame) -> DataFrame:
    """Follow ``word`` to ``root`` to the end, twice as far each round; counts grow along forms, so they end."""
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = cut_lineage(
            roots.join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            )
        )
        moved = not roots.filter("moved").isEmpty()
        roots = roots.select("word", "root")
        if not moved:
            return roots
