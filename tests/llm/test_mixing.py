"""Source mixes against a plain version, and what a mix must hold whatever the draw."""

import hashlib
from fractions import Fraction

import pytest

from llm.helpers import corpus, sentences, words
from riverspark.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, draw int, `rank` double, name string, weight int"


def slow_targets(sizes):
    """Share by weight; full sources keep three times their size, the rest is shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, level = set(), Fraction(0)
    while len(full) < len(sizes):
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        level = Fraction(rest, sum(weight[s] for s in sizes if s not in full))
        over = {s for s in sizes if s not in full and weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        full |= over
    return {s: Fraction(3 * sizes[s]) if s in full else weight[s] * level for s in sizes}


def slow(rows):
    docs, alike, sizes = [], {}, {}
    for doc, text, source in rows:
        digest = hashlib.md5(text.encode()).hexdigest() if text is not None else ""
        number = alike[doc, source, digest] = alike.get((doc, source, digest), -1) + 1
        own = "" if doc is None else str(doc)
        draw = hashlib.md5(f"mix:{own}:{digest}:{number}".encode()).hexdigest()
        docs.append((doc, source, len(words(text)), draw))
        sizes[source] = sizes.get(source, 0) + docs[-1][2]
    goal, out = slow_targets(sizes), []
    for source, size in sizes.items():
        own = sorted((d for d in docs if d[1] == source), key=lambda d: (int(d[3][:12], 16), d[3]))
        copies = goal[source] // size if size else 0
        budget, before = goal[source] - copies * size, 0
        for doc, _, n, _ in own:
            extra = 1 if budget and 2 * before + n <= 2 * budget else 0
            before += n
            out.append((doc, n, size, goal[source], n * (copies + extra)))
    return out


def cases():
    rows = [(doc, text, f"s{doc % 4}") for doc, text, _ in corpus()]
    rows += [(700 + i, sentences(i, 5 + i), None) for i in range(20)]
    rows += [(None, sentences(3, 9), "S"), (None, None, "S"), (800, "", "empty"), (801, None, "empty")]
    rows += [(900, "a b c", "s1")] * 40 + [(901, "one", "été"), (902, "x y", "zz")]
    return rows


def got_rows(spark, rows, cut=3):
    table = spark.createDataFrame([(d, t, s, "x", 1, 0.5, "n", 2) for d, t, s in rows], SCHEMA).repartition(cut)
    return [(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(table).collect()]


def key(row):
    return (row[0] is None, row[0] or 0, row[1], row[2], row[4])


def test_mix(spark):
    rows = cases()
    expected = sorted(slow(rows), key=key)
    got = sorted(got_rows(spark, rows), key=key)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in expected]
    assert all(abs(a[3] - float(b[3])) <= 1e-9 * max(1, a[3]) for a, b in zip(got, expected))
    assert got == sorted(got_rows(spark, rows[::-1], 1), key=key)
    assert all(r[4] <= 3 * r[1] for r in got)


def test_totals_come_near(spark):
    rows = [(i, sentences(i, 1 + i % 37), f"s{i % 7}" if i % 3 else "s0") for i in range(1200)]
    totals = {}
    for _, n, size, target, taken in got_rows(spark, rows):
        one = totals.setdefault(size, [target, 0, 0])
        one[1] += taken
        one[2] = max(one[2], n)
    assert len(totals) == 7
    assert all(abs(taken - target) <= longest / 2 + 1e-6 for target, taken, longest in totals.values())
    assert abs(sum(t[0] for t in totals.values()) - sum(totals)) < 1e-6


@pytest.mark.parametrize("few", [0, 3, 10_000])
def test_ranges_end_where_sorting_does(spark, few):
    draws = [hashlib.md5(str(i).encode()).hexdigest() for i in range(400)]
    rows = [(f"s{i % 3}" if i % 7 else None, d, i % 11, int(d[:8], 16) << (i % 20)) for i, d in enumerate(draws)]
    rows += [("tie", d, 2, 77) for d in draws[:20]] + [("all", d, 1, 5 + i) for i, d in enumerate(draws[:9])]
    budget = {"s0": 33.5, "s1": 0.2, "s2": 400.0, None: 100.0, "tie": 19.0, "all": 9.0}
    ranked = spark.createDataFrame(rows, "source string, draw string, size long, rank long")
    budgets = spark.createDataFrame(list(budget.items()), "source string, budget double")
    last = {r.source: (r.last_rank, r.last_draw) for r in mixing._last_taken(ranked, budgets, few).collect()}
    for source, most in budget.items():
        before = 0
        for _, draw, size, rank in sorted((r for r in rows if r[0] == source), key=lambda r: (r[3], r[1])):
            assert ((rank, draw) <= last[source]) == (2 * before + size <= 2 * most), (source, rank)
            before += size


def test_no_rows_and_no_words(spark):
    assert got_rows(spark, []) == []
    assert got_rows(spark, [(1, "", "a"), (2, None, None)], 1) in (
        [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)],
        [(2, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0)],
    )


def test_rows_alike_beyond_a_block(spark):
    table = spark.range(70_000).selectExpr("cast(1 as long) as doc_id", "'a b' as text", "'s' as source")
    sizes = mixing.word_sizes(table)
    assert sizes.count() == sizes.select("draw").distinct().count() == 70_000
