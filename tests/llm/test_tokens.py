"""Token ids, length statistics and packing."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm.helpers import SCHEMA, corpus, rows_of
from riverspark.llm import packing, tokens

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "it's a b c ́x é a \x1c b\x85c <|endoftext|> x<|startoftext|>y",
    "X<|endoftext|>, <|ENDOFTEXT|>. a<|endoftext|>b, it's, I'M. é, e,́ Ñ.̃ <|startoftext|>!",
    "ΑΣ ΣΑΣ İstanbul ﬁ ​ z J̌ ǰ a\x00b \x00 \x00\x00 c",
    "a\n̸b  ≠ = ̸ don't I'LL 12345 ½² ③ \x0b\x0c q WORD*** word%%%, x.y,z -a,- \",",
    "",
    None,
]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("room", [5, 500_000])
def test_runs_give_the_ids_of_the_whole_text(plain, room):
    coder = tokens.RunCoder(FILE, room)
    texts = ODD + [t for _, t, _ in corpus()]
    for _ in range(2):
        for text, ids in zip(texts, coder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == plain(text), text
    assert len(coder.known) <= room


def test_context_limits(spark, plain):
    docs = spark.createDataFrame(rows_of(corpus()), SCHEMA)
    got = {r.length: r for r in tokens.context_limits(tokens.length_histogram(docs), band=8).collect()}
    lengths = [len(plain(t)) for _, t, _ in corpus()]
    assert {k: r.docs for k, r in got.items()} == Counter(lengths)
    for limit, r in got.items():
        assert r.docs_over == sum(n > limit for n in lengths)
        assert r.tokens_over == sum(n for n in lengths if n > limit)
        assert r.tokens_kept == sum(min(n, limit) for n in lengths)
        assert r.tokens_kept + r.tokens_cut == r.tokens_total == sum(lengths)
        assert r.quantile == pytest.approx(sum(n <= limit for n in lengths) / len(lengths))
    assert tokens.context_limits(tokens.length_histogram(docs.limit(0))).collect() == []


def test_packing_holds_every_id_once(spark, plain):
    docs = spark.createDataFrame(rows_of(corpus()), SCHEMA)
    got = packing.pack_documents(docs, window=256).collect()
    places = defaultdict(list)
    whole = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id].append((r.start, r.ids))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for pieces in places.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 256
    repeats = Counter(doc for doc, _, _ in corpus())
    for doc, text, _ in corpus():
        ids = [*plain(text), 1]
        starts = defaultdict(list)
        for start, part in whole[doc]:
            starts[start].append(list(part))
        for start, parts in starts.items():
            assert parts == [ids[start : start + 256]] * repeats[doc]
        assert sum(len(p[0]) for p in starts.values()) == len(ids)
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_plan_uses_every_piece_and_pads_little():
    lengths = np.minimum(2048, np.random.default_rng(1).lognormal(6, 1, 20_000).astype(int) + 1)
    sizes = Counter((-(-lengths // 8)).tolist())
    plan = packing.plan(dict(sizes), 256)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 256 and times > 0
        for size in pattern:
            used[size] += times
    assert used == sizes
    sequences = sum(times for _, times in plan)
    assert 1 - lengths.sum() / (2048 * sequences) < 0.01


def test_nnls_beats_no_feasible_neighbour():
    draw = np.random.default_rng(2)
    a, b = draw.random((12, 20)), draw.random(12)
    x = packing.nnls(a, b)
    gradient = a.T @ (b - a @ x)
    assert (x >= 0).all() and (gradient < 1e-6).all() and np.abs(gradient[x > 0]).max() < 1e-6
