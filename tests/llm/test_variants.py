"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm.helpers import SCHEMA, corpus, rows_of
from riverspark.llm import variants


def slow_counts(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in found.items() if n >= 3 and len(w) >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in near.items()}
    form = {w: b if b and n[b] >= 2 * n[w] else None for w, b in best.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def result(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def texts():
    draw = random.Random(8)
    stems = ["".join(draw.choice("abcé") for _ in range(draw.randint(4, 8))) for _ in range(120)]
    rows = []
    for i in range(150):
        part = []
        for _ in range(60):
            w = draw.choice(stems[: 1 + draw.randint(0, 119)])
            if draw.random() < 0.2:
                p = draw.randrange(len(w))
                w = w[:p] + draw.choice(["", "b", "é", w[p] + "c"]) + w[p + 1 :]
            part.append(draw.choice([w, w.upper(), w.title()]))
        rows.append((i, draw.choice([" ", ", ", "-", "1"]).join(part), "en"))
    rows += [(None, "ABCDE abcde Abcde abcdé", None), (3, rows[3][1], "x"), (900, "É" * 3000 + " " + "É" * 2999, "x")] * 3
    return rows + corpus()


def test_word_counts(spark):
    rows = texts()
    counted = variants.word_counts(spark.createDataFrame(rows_of(rows), SCHEMA).repartition(3))
    got = {r.word: r.n for r in counted.collect()}
    assert got == slow_counts((d, t) for d, t, _ in rows) and len(got) > 200
    assert any(len(w) > 2000 for w in got)


@pytest.mark.parametrize("bucket_words", [7, 50_000])
def test_variants(spark, bucket_words):
    n = slow_counts((d, t) for d, t, _ in texts())
    table = spark.createDataFrame([(1, w, c, "x", "y") for w, c in n.items()], "half int, word string, n long, root string, form string")
    expected = slow_variants(n)
    assert result(variants.spelling_variants(table.repartition(4), bucket_words=bucket_words)) == expected
    assert sum(e[2] is not None for e in expected.values()) > 50


def test_chains_and_ties(spark):
    n = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "zzzzz": 5, "zzzzy": 10, "zzzyz": 10, "qqqqqq": 9}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    got = result(variants.spelling_variants(table))
    assert got == slow_variants(n)
    assert got["aaaaa"][4] == "abbbb" and got["zzzzz"][2] == "zzzyz" and got["qqqqqq"] == (9, 0, None, None, "qqqqqq")


def test_no_words(spark):
    empty = spark.createDataFrame([], SCHEMA)
    counted = variants.word_counts(empty)
    assert counted.collect() == [] and variants.spelling_variants(counted).collect() == []


@pytest.mark.parametrize("few", [0, 2, 32])
def test_index(few, monkeypatch):
    monkeypatch.setattr(variants, "_FEW", few)
    draw = random.Random(few)
    for _ in range(10):
        words = sorted({"".join(draw.choice("abé") for _ in range(draw.randint(3, 7))) for _ in range(150)})
        asked = ["".join(draw.choice("abéz") for _ in range(draw.randint(3, 7))) for _ in range(40)]
        exact = np.array([len(w) - len(w) // 2 for w in asked])
        a, b = variants.Index(words).near(asked, exact)
        found = {(asked[i], words[j]) for i, j in zip(a, b)}
        assert found == {
            (q, w) for q, e in zip(asked, exact) for w in words if w.endswith(q[-e:]) and one_edit(q[:-e], w[: len(w) - e])
        }
