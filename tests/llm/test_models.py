"""Character models, language identification and toxicity."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import SCHEMA, corpus, rows_of, sentences
from riverspark.llm import charlm, language, queries, toxicity


def slow_model(texts, order):
    """Interpolated Kneser-Ney by dictionaries: log probability of a character after a context."""
    top = Counter()
    for text in texts:
        chars = "".join(chr(int(c)) for c in charlm.letters(text, order))
        top.update(chars[i : i + order] for i in range(len(chars) - order + 1))
    tables = {order: top}
    for length in range(order - 1, 0, -1):
        tables[length] = Counter(g[1:] for g in tables[length + 1])

    def probability(gram):
        if not gram:
            return 1 / 65536
        table = tables[len(gram)]
        values = list(table.values())
        ones, twos = values.count(1), values.count(2)
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        ctx = {g: n for g, n in table.items() if g[:-1] == gram[:-1]}
        if not ctx:
            return probability(gram[1:])
        total = sum(ctx.values())
        own = max(table[gram] - d, 0) if gram in table else 0
        return own / total + d * len(ctx) / total * probability(gram[1:])

    return probability


def test_model_matches_dictionaries(spark):
    texts = {"a": [sentences(i, 30, "abcd") for i in range(4)], "b": [sentences(i, 30, "cdef") for i in range(3)]}
    rows = [(t, label) for label, many in texts.items() for t in many]
    counts = charlm.count_grams(spark.createDataFrame(rows, "text string, label string"), 3)
    model = charlm.fit(charlm.gram_tables(counts, 3, 10**6), 3)
    assert model.labels == ["a", "b"]
    shown = charlm.letters("abca bcdf zzz fed é", 3)
    packed = charlm.grams(shown, 3)
    got = model.score(packed)
    for column, label in enumerate("ab"):
        probability = slow_model(texts[label], 3)
        for i in range(len(packed)):
            gram = "".join(chr(int(c)) for c in shown[i : i + 3])
            assert got[i, column] == pytest.approx(math.log(probability(gram)), abs=1e-3), gram


def test_model_probabilities_add_up(spark):
    rows = [(sentences(1, 40, "abc"), "a")]
    counts = charlm.count_grams(spark.createDataFrame(rows, "text string, label string"), 3)
    model = charlm.fit(charlm.gram_tables(counts, 3, 10**6), 3)
    context = charlm.grams(charlm.letters("ab", 3), 3)[1:2]  # blank, a, b
    every = (context << np.uint64(21)) & np.uint64((1 << 63) - 1) | np.arange(65536, dtype=np.uint64)
    assert np.exp(model.score(every)).sum() == pytest.approx(1, abs=1e-3)


def test_letters():
    assert charlm.letters(None, 3).size == charlm.letters("12 !?", 3).size == 0
    assert "".join(map(chr, charlm.letters("Ab--c 1 d", 3).tolist())) == "  ab c d "


def test_languages(spark):
    rows = [(i, sentences(i, 60, "abcdefgh" if i % 2 else "mnopqrst"), "odd" if i % 2 else "even") for i in range(200)]
    rows += [(300, None, "odd"), (301, "123 !", "even"), (302, "", None), (303, "ΩΨΦ ΔΓΘ ΞΠΣ " * 40, None), (None, "abc abd", "odd")]
    docs = spark.createDataFrame(rows_of([*rows, rows[0]]), SCHEMA)
    learned = docs.filter("pmod(doc_id, 4) != 2").select("text", F.col("lang").alias("label"))
    got = language.identify(docs, language.train(learned)).collect()
    assert len(got) == len(rows) + 1
    by_id = {r.doc_id: r for r in got}
    for doc, text, lang in rows[:200]:
        assert by_id[doc].lang_pred == lang and 0 <= by_id[doc].score <= 1 and not by_id[doc].rejected
    for doc in (300, 301, 302):
        assert by_id[doc].lang_pred == "und" and by_id[doc].rejected
    assert by_id[303].rejected and by_id[303].lang_pred in ("odd", "even")
    nothing = language.identify(docs, language.train(learned.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.identify(docs.limit(0), language.train(learned)).collect() == []


def test_rejection_limit_covers_every_learned_text(spark):
    plain = [(f"{i} {'mn' * 80}", "plain") for i in range(2400)]
    draw = random.Random(3)
    odd = [("".join(draw.choices("abcdefgh", k=30_000)), "plain") for _ in range(12)]
    hashed = spark.createDataFrame(odd, "text string, label string").withColumn("h", F.xxhash64("text", "label"))
    # A text that a sample of the smallest hashes would leave out.
    text = hashed.orderBy(F.desc("h")).first().text
    learned = spark.createDataFrame([*plain, (text, "plain"), (text, None), (None, "plain")], "text string, label string")
    found = language.train(learned)
    (entropy,) = language.largest_entropies(learned.filter(F.col("text") == text).dropna(), found.model).values()
    assert found.limit[0] == pytest.approx(1.5 * entropy)
    asked = spark.createDataFrame([(text, 1), ("ΩΨΦ ΔΓΘ ΞΠΣ " * 40, 2)], "text string, doc_id long")
    assert {r.doc_id: r.rejected for r in language.identify(asked, found).collect()} == {1: False, 2: True}


def test_toxicity(spark):
    plain = [(i, sentences(i, 120), 0) for i in range(600)]
    toxic = []
    for i in range(600, 760):
        words = sentences(i, 120).split()
        words[i % 100 : i % 100 + 1] = [f"zorgu{sentences(i, 1)}", "zorguth"]
        toxic.append((i, " ".join(words), 1))
    rows = plain + toxic
    docs = spark.createDataFrame(rows_of([(d, t, None) for d, t, _ in rows] + [(900, None, None), (901, "12", None)]), SCHEMA)
    labels = [(d, 1, y) for d, _, y in rows] + [(900, 1, 1), (None, 0, 1), (5, None, None)]
    known = toxicity.labelled_texts(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scorer = toxicity.train(known.filter("doc_id % 3 = 1"), known.filter("doc_id % 3 = 2"))
    got = {r.doc_id: r for r in toxicity.score_texts(docs, scorer).collect()}
    assert len(got) == len(rows) + 2
    held = [(got[d].predicted, y) for d, _, y in rows if d % 3 == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert got[900].predicted == got[901].predicted == 0
    nothing = toxicity.score_texts(docs, toxicity.train(known.limit(0), known.limit(0))).collect()
    assert {r.predicted for r in nothing} == {0}


def test_one_label_for_each_document(spark):
    rows = [(1, "a b", None), (1, "c d", None), (2, "e", None), (3, "f", None), (None, "g", None)]
    labels = [(1, 1), (1, 0), (1, 1), (2, 0), (2, None), (2, 0), (3, None), (None, 1), (9, 1)]
    known = toxicity.labelled_texts(
        spark.createDataFrame(rows_of(rows), SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    )
    assert sorted(map(tuple, known.collect())) == [(1, "a b", "1"), (1, "c d", "1"), (2, "e", "0")]


def test_names_that_differ_in_case_are_replaced(spark):
    docs = spark.createDataFrame([(1, "some words", "x", 2, "y")], "doc_id long, text string, Score string, PREDICTED int, Lang_Pred string")
    learned = docs.selectExpr("text", "'en' AS label")
    found = language.identify(docs, language.train(learned))
    assert found.columns == ["doc_id", "text", "PREDICTED", "lang_pred", "score", "rejected"] and found.count() == 1
    known = docs.selectExpr("text", "'0' AS label")
    scored = toxicity.score_texts(docs, toxicity.train(known, known))
    assert scored.columns == ["doc_id", "text", "Lang_Pred", "score", "predicted"] and scored.count() == 1


def test_folds(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 7, 123456789, -3)], "doc_id long")
    from riverspark.llm.common import fold_of

    got = rows.select("doc_id", fold_of(F.col("doc_id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


def test_held_out_accuracy(spark):
    """Both learned queries on the test tables, judged on rows they have not learned from."""
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    found = [r for r in queries.QUERIES["op9_language"](spark, folder).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in found) / len(found) > 0.97
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = [r for r in queries.QUERIES["op8_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in toxic]
    by_label = defaultdict(list)
    for r in found:
        by_label[toxic[r.doc_id]].append(r.score)
    wins = sum((a > b) + 0.5 * (a == b) for a in by_label[1] for b in by_label[0])
    assert wins / (len(by_label[1]) * len(by_label[0])) > 0.8


def test_corpus_is_scored_whole(spark):
    docs = spark.createDataFrame(rows_of(corpus()), SCHEMA)
    learned = docs.select("text", F.col("lang").alias("label"))
    assert language.identify(docs, language.train(learned)).count() == len(corpus())


def test_model_size_is_bounded(spark):
    rows = [(f"{a}{b} " * (1 + i % 7) * 40, "a") for i, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "abcdefgh")]
    counts = charlm.count_grams(spark.createDataFrame(rows, "text string, label string"), 3)
    whole = charlm.gram_tables(counts, 3, 10**6)
    for most in (60, 20, 1):
        for table, all_grams in zip(charlm.gram_tables(counts, 3, most), whole):
            sizes = sum(len(g) for g, _ in table.values())
            assert sizes <= most
            for label, (grams, n) in table.items():
                known = dict(zip(*(x.tolist() for x in all_grams[label])))
                assert all(known[g] == c for g, c in zip(grams.tolist(), n.tolist()))
    model = charlm.fit(charlm.gram_tables(counts, 3, 20), 3)
    assert np.isfinite(model.score(charlm.grams(charlm.letters("abc xyz", 3), 3))).all()


def test_shards_equal_the_whole_model(spark):
    texts = {"a": [sentences(i, 30, "abcd") for i in range(4)], "b": [sentences(i, 30, "cdef") for i in range(3)]}
    rows = [(t, label) for label, many in texts.items() for t in many]
    counts = charlm.count_grams(spark.createDataFrame(rows, "text string, label string"), 4)
    packed = charlm.grams(charlm.letters("abca bcdf zzz fed é " + texts["b"][0], 4), 4)
    for shared in (False, True):
        whole = charlm.fit(charlm.gram_tables(counts, 4, 10**6), 4, shared).score(packed)
        one = charlm.fit_shards(counts, 4, shared)
        few = charlm.fit_shards(counts, 4, shared, shard_bytes=2000, held_bytes=4000)
        assert one.labels == few.labels == ["a", "b"]
        assert len(one.levels[3][0]) == 1 and len(few.levels[3][0]) > 3
        assert {shard.held for level in few.levels for shards in level for shard in shards} == {True, False}
        np.testing.assert_allclose(one.score(packed), whole, atol=1e-4)
        np.testing.assert_array_equal(one.score(packed), few.score(packed))


def test_many_grams_of_one_language_leave_the_others_whole(spark):
    """More grams, each seen as often, than a model once kept: small languages of the same letters stay apart."""
    draw = random.Random(1)
    wide = "".join(draw.choices([chr(c) for c in range(0x4E00, 0x9E00)], k=2_300_000))
    line = draw.sample([chr(c) for c in range(0xAC00, 0xC000)], 2000)
    there, back = "".join(line), "".join(line[::-1])
    rows = [(i, wide[i * 100_000 : (i + 1) * 100_000], "wide") for i in range(23)] + [(30, there, "there"), (31, back, "back")]
    learned = spark.createDataFrame(rows, "doc_id long, text string, label string")
    asked = [(i, there[i * 100 : i * 100 + 90], "there") for i in range(10)]
    asked += [(10 + i, back[i * 100 : i * 100 + 90], "back") for i in range(10)]
    docs = spark.createDataFrame(asked, "doc_id long, text string, truth string")
    got = language.identify(docs, language.train(learned)).collect()
    assert [r.lang_pred for r in got] == [r.truth for r in got]


def test_rows_beyond_the_calibration_sample_are_learned(spark):
    known = [(sentences(i, 40), str(int(i < 20))) for i in range(60)]
    new = [(f"{sentences(100 + i, 40)} vyzzuq", "1") for i in range(30)] + [(sentences(200 + i, 40), "0") for i in range(30)]
    learn, calibrate = (spark.createDataFrame(rows, "text string, label string") for rows in (known, new))
    word = charlm.grams(charlm.letters("vyzzuq", toxicity.ORDER), toxicity.ORDER)
    likely = {}
    for most in (4, 60):
        likely[most] = toxicity.train(learn, calibrate, calibration_rows=most).model.score(word)[:, 1].sum()
    assert likely[4] > -15 and likely[60] < -30
