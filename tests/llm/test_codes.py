"""Vector codes against a plain version in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from riverspark.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id long, vector string, error double"


def slow(rows, parts=16, entries=64, rounds=2):
    kept = []
    for own, vector, label in rows:
        if vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((own, [math.floor(256 * x) for x in vector], label))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (width * parts - len(v)), x) for i, v, x in kept]
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    first = {}
    for (own, v, _), c in zip(kept, cut):
        key = (own is None, own or 0)
        first[key] = min(first.get(key, (v, c)), (v, c))
    first = [first[k][1] for k in sorted(first)[:entries]]
    books = [[c[p] for c in first] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            near = []
            for p in range(parts):
                near.append(min((sum((a - b) ** 2 for a, b in zip(c[p], e)), i) for i, e in enumerate(books[p])))
            out.append(near)
        return out

    for _ in range(rounds):
        made = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, m in zip(cut, made) if m[p][1] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own))
    made = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in m) for m in made]
    by_label = {}
    for (_, _, label), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    return [
        (i, "".join(f"{e:02x}" for _, e in m), error, by_label[label], digest)
        for (i, _, label), m, error in zip(kept, made, errors)
    ]


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def check(spark, rows, cuts=(1, 5)):
    table = spark.createDataFrame([(i, v, x, "c", 7, "v", 0.5) for i, v, x in rows], SCHEMA)
    back = [(r.vec_id, r.embedding, r.label) for r in table.select("vec_id", "embedding", "label").collect()]
    expected = sorted(slow(back), key=key)
    for cut in cuts:
        got = codes.compress(table.repartition(cut))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=key) == expected
    return expected


def test_codes(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(20, 64))
    rows = [(1000 - i, (centres[i % 20] + 0.2 * draw.normal(size=64)).tolist(), i % 3 or None) for i in range(300)]
    rows += [(2000 + i, rows[0][1], 1) for i in range(100)]
    odd = [[None] + [0.0] * 63, [float("nan")] * 64, [float("inf")] * 64, None, [0.0] * 64, [-0.001] * 64]
    rows += [(5 + i, v, 2) for i, v in enumerate(odd)] + [(None, rows[1][1], None), (701, rows[5][1], 1)]
    assert len(check(spark, rows)) == 404


@pytest.mark.parametrize("sizes", [(3,), (16, 20), (0,), (0, 33), (1, 48, 64)])
def test_odd_lengths_and_few_rows(spark, sizes):
    draw = random.Random(1)
    rows = [(i % 9, [draw.uniform(-2, 2) for _ in range(sizes[i % len(sizes)])], i % 2) for i in range(12)]
    rows += [(None, rows[0][1], None), (None, rows[1][1], None)]
    check(spark, rows, (3,))


def test_only_rows_without_id_and_no_rows(spark):
    check(spark, [(None, [0.5] * 16, 1), (None, [0.25] * 16, 1)], (2,))
    check(spark, [(1, None, 1)], (1,))
    empty = spark.createDataFrame([], SCHEMA)
    assert codes.compress(empty).collect() == []


def test_components_that_do_not_fit(spark):
    table = spark.createDataFrame([(1, [1e30] * 16, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        codes.compress(table)


def test_transform():
    for size in (1, 2, 4, 8, 16):
        rows = codes.walsh_hadamard(np.eye(size, dtype=np.int64)).T
        assert [(r[1:] != r[:-1]).sum() for r in rows] == list(range(size))
    draw = np.random.default_rng(5)
    a, b = draw.integers(-300, 300, (2, 50, 6))
    assert (((codes.walsh_hadamard(a) - codes.walsh_hadamard(b)) ** 2).sum(1) == 8 * ((a - b) ** 2).sum(1)).all()


@pytest.mark.parametrize("length", [1, 3, 4, 7, 16])
def test_nearest_entry(length):
    draw = np.random.default_rng(length)
    rows, entries = draw.integers(-4, 5, (500, length)), draw.integers(-4, 5, (64, length))
    distance = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    code, error = codes.nearest_entries(rows, entries)
    assert (code == distance.argmin(axis=1)).all() and (error == distance.min(axis=1)).all()
