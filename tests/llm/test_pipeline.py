"""The pipeline, stage by stage, against brute force; and the entry without the subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm.helpers import SCHEMA, rows_of, sentences, slow_components, slow_fingerprint
from riverspark.llm import personal

ROOT = Path(__file__).resolve().parents[2]
MAIL = "write to jo.do@mail7.example.com or +1 (017) 555-7713"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A few documents of two languages with every reason to go, and the items to look for."""
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, sentences(i, 150, "abcdefgh"), "one") for i in range(40)]
    rows += [(100 + i, sentences(100 + i, 150, "mnopqrst"), "two") for i in range(40)]
    items = [(i, sentences(500 + i, 20 + i)) for i in range(5)]
    rows += [(200 + i, f"{sentences(i, 60)} {items[i][1]} {sentences(i + 9, 70)}", "one") for i in range(5)]
    rows += [(300 + i, rows[i][1], "one") for i in range(5)]  # copies
    rows += [(310, f"{sentences(310, 80, 'mnopqrst')} {MAIL} {sentences(311, 80, 'mnopqrst')}", "two")]
    rows += [(400, None, "one"), (401, "", None), (402, "12 34 !", "two"), (403, "ΩΨΦ ΔΓΘ ΞΠΣ " * 40, None)]
    rows += [(7, rows[7][1], "one"), (None, sentences(77, 120, "abcdefgh"), None), (404, "abc", "one")]
    spark.createDataFrame(rows_of(rows), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_stages_in_order(spark, folder):
    path, rows, items = folder
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "near_dedup", "decontamination", "personal_data", "packing"
    ]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = [r for r in rows if r[0] not in (400, 401, 402, 403)]

    def step(number):
        nonlocal docs
        out = corpus_pipeline.STAGES[number][1](spark, docs, path)
        if number < 4:
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        return docs.collect()

    key = lambda d: (d is None, d)
    assert sorted((r.doc_id for r in step(0)), key=key) == sorted((r[0] for r in kept), key=key)
    label = slow_components({r[0]: slow_fingerprint(r[1]) for r in kept if r[0] is not None})
    first = {r[0]: r[1] for r in kept if r[0] is None or label[r[0]] == r[0]}
    got = step(1)
    assert len(got) == len(first) and {r.doc_id for r in got} == set(first)
    clean = {d: t for d, t in first.items() if not any(passage in t for _, passage in items)}
    got = step(2)
    assert len(got) == len(clean) and {r.doc_id for r in got} == set(clean)
    for r in step(3):
        spans = personal.find(clean[r.doc_id])
        assert r.text == (personal.redact(clean[r.doc_id], spans) if spans else clean[r.doc_id])
        assert r.n_chars == len(r.text) and ("@" not in r.text)
    totals = {}
    for r in step(4):
        totals.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert set(totals) == set(clean) and all(a == b for a, b in totals.values())


@pytest.mark.parametrize("cut", [1, 5])
def test_one_of_each_group_judges_rows(spark, cut):
    t, u, v, w = (sentences(900 + i, 160) for i in range(4))
    near = next(x for x in (f"{t} {sentences(i, 1)}" for i in range(99)) if 0 < bits(x, t) <= 3)
    rows = [(2, t, "a"), (5, t, "a"), (5, u, "b"), (6, v, "c"), (6, w, "c"), (6, w, "c"), (6, w, "d"), (2, near, "a"), (9, near, "a")]
    rows += [(None, t, "a"), (None, t, "a"), (20, None, "n"), (21, "", "n"), (20, "", "n")]
    docs = spark.createDataFrame(rows_of(rows), SCHEMA)
    got = corpus_pipeline.one_of_each_group(spark, docs.repartition(cut), "").collect()
    kept = [(r.doc_id, r.text) for r in got]
    assert sum(k in ((2, t), (2, near)) for k in kept) == 1 and (9, near) not in kept and (5, t) not in kept
    assert [kept.count(k) for k in ((5, u), (6, v), (6, w), (None, t))] == [1, 1, 1, 2]
    assert len(kept) == 7 and sum(d == 20 for d, _ in kept) == 1
    again = corpus_pipeline.one_of_each_group(spark, docs.orderBy(F.desc("lang")).coalesce(1), "").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def bits(a, b):
    return (slow_fingerprint(a) ^ slow_fingerprint(b)).bit_count()


def test_run_gives_the_last_stage(spark, folder):
    path, _, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.count() > 50 and "sequence_id" in out.columns


def test_stages_take_an_empty_table(spark, folder):
    path, _, _ = folder
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).collect() == []


def test_entry_works_without_the_subpackage(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("riverspark.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
names = set(entry.queries())
assert "regime_metrics" in names and not any(n.startswith("op") and n[2:3].isdigit() for n in names)
assert "pipeline" not in names and set(entry.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in [*ROOT.glob("riverspark/**/*.py"), *ROOT.glob("catalogue/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.parts:
            assert "riverspark.llm" not in path.read_text(), path
