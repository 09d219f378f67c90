"""Benchmark containment, personal data and nearest neighbours against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import SCHEMA, corpus, rows_of, sentences
from riverspark.llm import contamination, nearest, personal, queries

ITEMS = "item_id long, text string, source string, score string"


def shingles(text) -> set:
    words = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def planted():
    items = [(i, sentences(1000 + i, 12 + 4 * i), None, "x") for i in range(8)]
    items += [(20, "too short item", "s", "x"), (21, None, None, None), (22, "", None, None)]
    items += [(3, items[3][1], None, "x"), (30, items[5][1] + " with more words behind it", None, "x")]
    docs = [(d, t, g) for d, t, g in corpus()]
    for i in range(8):
        words = items[i][1].split()
        docs.append((100 + i, f"{sentences(i, 700)} {items[i][1].upper()}! {sentences(50 + i, 900)}", "en"))
        docs.append((120 + i, " ".join(words[: len(words) * 6 // 10]), "en"))
        docs.append((140 + i, " ".join(words[:-2] + ["other", "end"]), "en"))
    docs += [(100, docs[-24][1], "en"), (None, items[4][1], "en")]
    return docs, items


def test_contaminated(spark):
    docs, items = planted()
    got = contamination.contaminated(spark.createDataFrame(rows_of(docs), SCHEMA), spark.createDataFrame(items, ITEMS))
    found = {(r.doc_id, r.item_id): (r.shared, r.item_shingles) for r in got.collect()}
    expected = {}
    for doc, text, _ in docs:
        for item, passage, _, _ in items:
            own, q = shingles(text), shingles(passage)
            if q and 5 * len(own & q) >= 4 * len(q):
                expected[doc, item] = (len(own & q), len(q))
    assert found == expected and len(expected) >= 16


def test_without_contaminated(spark):
    docs, items = planted()
    table, bench = spark.createDataFrame(rows_of(docs), SCHEMA), spark.createDataFrame(items, ITEMS)
    kept = contamination.without_contaminated(table, bench)
    assert kept.columns == table.columns
    sets = [shingles(p) for _, p, _, _ in items if shingles(p)]
    clean = [d for d, t, _ in docs if not any(5 * len(shingles(t) & q) >= 4 * len(q) for q in sets)]
    key = lambda d: (d is None, d)
    assert sorted((r.doc_id for r in kept.collect()), key=key) == sorted(clean, key=key)
    assert contamination.without_contaminated(table, bench.limit(0)).count() == len(docs)
    assert contamination.contaminated(table.limit(0), bench).collect() == []


def test_common_phrase_proposes_no_pairs(spark):
    """A phrase of all items and all documents signs no item, so it brings no pairs of documents and items."""
    phrase = "one phrase that all of them share"
    items = [(i, f"{phrase} {sentences(4000 + i, 30)}", "s", "x") for i in range(40)]
    docs = [(d, f"{sentences(d, 60)} {phrase} {sentences(90 + d, 60)}", "en") for d in range(60)]
    docs += [(100 + i, f"{sentences(500 + i, 40)} {items[i][1]}", "en") for i in range(5)]
    bench = spark.createDataFrame(items, ITEMS)
    shingles = contamination.item_shingles(bench, "item_id", "text", 5, 0.8)
    common = [r for r in shingles.collect() if r.shingle in phrase]
    assert len(common) == 3 * 40 and not any(r.signed for r in common)
    got = contamination.contaminated(spark.createDataFrame(rows_of(docs), SCHEMA), bench).collect()
    assert {(r.doc_id, r.item_id, r.containment) for r in got} == {(100 + i, i, 1.0) for i in range(5)}


def test_signature_cannot_be_missed():
    for size in range(1, 400):
        lacking = size - -(-size * 4 // 5)
        assert min(size, lacking + 1) <= contamination.signature_length(size, 0.8) <= size


def slow_spans(text):
    kept = {k: [] for k in personal.BASE}
    kept["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            kept["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and personal.luhn(digits):
            kept["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            kept["phone"].append(m.span())
    return kept


def test_base_spans_match_the_patterns():
    draw = random.Random(1)
    texts = ["".join(draw.choice("a.@@1234567890..- +()é%") for _ in range(draw.randint(0, 60))) for _ in range(20_000)]
    texts += ["".join(draw.choice("1.0 2-") for _ in range(draw.randint(0, 60))) for _ in range(20_000)]
    texts += ["4111 1111 1111 1111", "a@b.c@d.e", "x@y", "256.1.1.1 1.2.3.4.5 01.002.3.255", "+1 (017) 555-7713"]
    for text in texts:
        found = personal.find(text)
        for kind, spans in slow_spans(text).items():
            assert [(a, b) for k, a, b, _ in found if k == kind] == spans, (kind, text)


def test_checks_and_context():
    assert [s[:3] for s in personal.find("iban DE89 3704 0044 0532 0130 00 AND so")] == [("iban", 5, 32)]
    assert personal.find("DE89 3704 0044 0532 0130 01") == []
    assert [s[0] for s in personal.find("ssn 123-45-6789")] == ["ssn"] and personal.find("part 123-45-6789") == []
    near, far = personal.find("mail to a@b.de, e-mail"), personal.find("a@b.de")
    assert near[0][3] > far[0][3]
    text = "x a@b.co +1 (017) 555-7713 y"
    assert personal.redact(text, personal.find(text)) == "x [EMAIL] [PHONE] y"


@pytest.mark.parametrize("bad", ["a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "AB12" * 50_000])
def test_long_odd_texts_end_soon(bad):
    personal.find(bad)


def test_personal_data_keeps_columns(spark):
    docs = spark.createDataFrame(rows_of([*corpus(), (70, "é a@b.de 4111111111111111", "en")]), SCHEMA)
    got = personal.personal_data(docs, redacted_col="text").collect()
    assert len(got) == len(corpus()) + 1
    row = next(r for r in got if r.doc_id == 70)
    assert [(s.kind, s.start, s.end) for s in row.spans] == [("email", 2, 8), ("card", 9, 25)]
    assert row.text == "é [EMAIL] [CARD]" and row["a b"] == 0
    assert next(r for r in got if r.doc_id == 50).text is None
    assert personal.personal_data(docs.limit(0)).collect() == []


def slow_nearest(rows, query, k=10):
    own, q = query
    near = []
    for other, v in rows:
        if other != own and len(v) == len(q):
            near.append((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), other))
    return sorted(near)[:k]


@pytest.mark.parametrize("chunk", [64, 4096])
def test_nearest(spark, chunk):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * draw.normal(size=16)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(60)]  # many equal vectors
    rows += [(3000 + i, draw.normal(size=4).tolist()) for i in range(5)]  # another length
    odd = [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [None] + [1.0] * 15), (4004, [float("nan")] * 16),
           (4005, [float("inf")] * 16), (None, rows[1][1]), (7, rows[7][1])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, v string, rank int")
    got = nearest.nearest(table, table.filter("vec_id % 100 = 0"), chunk_rows=chunk).collect()
    hits = total = 0
    for own, v in rows:
        if own % 100:
            continue
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == own)
        true = slow_nearest(rows, (own, v))
        assert [m[0] for m in mine] == list(range(1, len(true) + 1))
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hits += len({m[1] for m in mine} & {i for _, i in true})
        total += len(true)
    assert hits / total >= 0.95
    zero = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 0)
    assert [i for _, i in zero] == list(range(2000, 2010))
    assert not {r.query_id for r in got} & {4000, 4001, 4002, 4003, 4004, 4005}
    assert nearest.nearest(table.limit(0), table.limit(0)).collect() == []


def test_nearest_of_repeated_ids(spark):
    """An id with two vectors asks with the smaller one and may be found with both, in any order of rows."""
    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(300)]
    rows += [(i % 100, draw.normal(size=6).tolist()) for i in range(120)] + rows[:30]
    first = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    lists = []
    for table in (first.coalesce(1), first.orderBy(F.desc("embedding")).repartition(4)):
        found = nearest.nearest(table, table.filter("vec_id % 50 = 0"), sure=1.0).collect()
        lists.append(sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found))
    assert lists[0] == lists[1]
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    for query in range(0, 300, 50):
        own = min(v for i, v in distinct if i == query)
        true = slow_nearest(distinct, (query, own))
        mine = [(score, vec) for q, _, vec, score in lists[0] if q == query]
        assert [v for _, v in mine] == [v for _, v in true]
        assert np.allclose([s for s, _ in mine], [s for s, _ in true], rtol=1e-12)


def test_nearest_finds_most_of_the_test_vectors(spark):
    """Recall of the registered query against a full scan."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in vectors])
    data = np.array([r.embedding for r in vectors], np.float64)
    got = {}
    for r in queries.QUERIES["op10_nearest"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for at in np.flatnonzero(ids % 100 == 0):
        far = ((data - data[at]) ** 2).sum(axis=1)
        far[at] = np.inf
        hits.append(len(got[ids[at]] & set(ids[np.lexsort((ids, far))[:10]].tolist())) / 10)
    assert len(hits) == len(got) and np.mean(hits) >= 0.9


def test_stopping_test_leaves_points_out():
    """The search verifies in projected order, stops early, and still finds nearly all; with limit infinite, all."""
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(20, 32)) * 2
    data = np.repeat(centres, 200, axis=0) + 0.2 * draw.normal(size=(4000, 32))
    shown = data @ nearest.projection(32)
    hits = {0.97: 0, 1.0: 0}
    for sure in hits:
        tree, limit = nearest.Tree(np.arange(4000), data, shown), nearest.quantile(sure)
        for at in range(0, 4000, 100):
            far = np.sqrt(((data - data[at]) ** 2).sum(axis=1))
            far[at] = np.inf
            true = np.lexsort((np.arange(4000), far))[:10]
            ids, found = tree.nearest(at, data[at], shown[at], 10, np.inf, limit)
            assert len(ids) == 10 and np.array_equal(found, far[ids]) and (np.diff(found) >= 0).all()
            hits[sure] += len(set(ids) & set(true))
            if sure == 1:
                bounded, _ = tree.nearest(at, data[at], shown[at], 10, found[4], limit)
                assert bounded.tolist() == ids[: len(bounded)].tolist() and found[4] == found[len(bounded) - 1]
        if sure < 1:
            assert tree.verified < 0.1 * 4000 * 40
    assert hits[1.0] == 400 and hits[0.97] >= 380


def test_quantile():
    assert nearest.quantile(1.0) == float("inf")
    for sure in (0.5, 0.9, 0.97):
        assert abs(nearest.chi_square(nearest.quantile(sure)) - sure) < 1e-9


def test_chi_square():
    draw = np.random.default_rng(1).normal(size=(200_000, nearest.PROJECTIONS))
    for x in (8.0, 15.0, 25.0):
        assert abs(((draw**2).sum(axis=1) <= x).mean() - nearest.chi_square(x)) < 0.01
