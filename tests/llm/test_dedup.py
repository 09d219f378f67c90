"""SimHash groups, word windows and byte strings against brute force."""

import numpy as np
import pytest

from llm.helpers import SCHEMA, corpus, rows_of, sentences, slow_components, slow_fingerprint, slow_strings, slow_windows
from riverspark.llm import simhash, substrings, suffixes
from riverspark.llm.components import components


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(corpus()), SCHEMA).cache()


def test_fingerprint_matches_definition():
    for text in ["a b c d e f", "Hello", "", None, "A b", "ÄÖ x y z   q r s t " * 40, "\x85   a\x0bb"]:
        assert simhash.fingerprint(text) % 2**64 == slow_fingerprint(text), text


def test_groups(docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(corpus())
    prints = {doc: slow_fingerprint(text) for doc, text, _ in corpus()}
    label = slow_components(prints)
    for row in got:
        assert row.fingerprint == f"{prints[row.doc_id]:016x}"
        assert row.component_id == label[row.doc_id]


@pytest.mark.parametrize("crowd", [1, 3, 20_000])
def test_links_of_close_codes(spark, crowd):
    """Chains and clusters of codes, with every depth of the index."""
    draw = np.random.default_rng(5)
    codes = [int(c) for c in draw.integers(0, 2**63, 60)]
    for code in list(codes):
        for _ in range(6):
            flips = draw.choice(64, draw.integers(1, 6), replace=False)
            codes.append(code ^ sum(1 << int(b) for b in flips))
    codes = sorted(set(codes))
    signed = [(c - 2**64 if c >= 2**63 else c, i) for i, c in enumerate(codes)]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long, doc_id long"), 3, crowd)
    found = {r.node: r.component for r in components(links).collect()}
    expected = slow_components(dict(enumerate(codes)))
    assert {i: found.get(i, i) for i in expected} == expected


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(7, 7), (None, 3)], "a long, b long")
    assert {r.component for r in components(links).collect()} == {0}


@pytest.mark.parametrize("crowd", [1, 2, 6, 2000])
def test_windows(docs, crowd):
    got = substrings.remove_repeated_windows(docs, crowd=crowd).collect()
    expected = slow_windows([(d, t) for d, t, _ in corpus()])
    assert len(got) == len(corpus())
    for row in got:
        assert (row.n_words, row.n_removed, row.kept) == expected[row.doc_id], row.doc_id


@pytest.mark.parametrize("crowd", [1, 4, 5000])
def test_strings(docs, crowd):
    got = suffixes.remove_repeated_strings(docs, crowd=crowd).collect()
    expected = slow_strings([(d, t) for d, t, _ in corpus()])
    assert len(got) == len(corpus())
    for row in got:
        assert (row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept)) == expected[row.doc_id], row.doc_id


def test_doubling_agrees_with_whole_strings():
    draw = np.random.default_rng(3)
    data = draw.integers(97, 99, 600).astype(np.uint8)
    data[300:450] = data[20:170]
    left = len(data) - np.arange(len(data))
    for width in (3, 8, 12, 20, 100):
        ranks = suffixes.doubled_ranks(data, left, width)
        strings = [bytes(data[i : i + width]) for i in range(len(data) - width + 1)]
        for i, s in enumerate(strings):
            twins = [j for j, t in enumerate(strings) if t == s]
            assert (ranks[i] > 0) == (len(twins) > 1)
            assert {int(ranks[j]) for j in twins} == {int(ranks[i])}


def test_shared_minimisers_without_shared_strings(spark):
    """A passage under 100 bytes meets in one bucket and removes nothing."""
    passage = sentences(9, 14)[:70]
    rows = [(i, f"{sentences(20 + i, 60)} {passage} {sentences(60 + i, 60)}", "en") for i in range(3)]
    got = suffixes.remove_repeated_strings(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()
    assert [r.n_removed for r in got] == [0, 0, 0]
    short = [(i, f"{sentences(20 + i, 60)} {' '.join(sentences(9, 20).split())} {sentences(60 + i, 60)}", "en") for i in range(3)]
    got = substrings.remove_repeated_windows(spark.createDataFrame(rows_of(short), SCHEMA)).collect()
    assert [r.n_removed for r in got] == [0, 0, 0]


def test_rows_without_id_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(80))
    odd = spark.createDataFrame(rows_of([(None, text, "en"), (1, text, "en"), (None, None, None)]), SCHEMA)
    assert [r.component_id for r in simhash.near_duplicates(odd).collect() if r.doc_id is None] == [None, None]
    assert all(r.n_removed == 0 for r in substrings.remove_repeated_windows(odd).collect())
    assert all(r.n_removed == 0 for r in suffixes.remove_repeated_strings(odd).collect())
    empty = spark.createDataFrame([], SCHEMA)
    for build in (simhash.near_duplicates, substrings.remove_repeated_windows, suffixes.remove_repeated_strings):
        assert build(empty).collect() == []
