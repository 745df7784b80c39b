from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlake.llm import lm
from loomlake.llm.queries import op1_backoff_lm


def plain_model(rows, order=2):
    """Dictionaries and a loop: (id, held out, tokens, known, N, base, score). Words in front of a text: its start."""
    uni, grams, ctx = Counter(), Counter(), Counter()

    def tokens(t):
        return [*(t or "").encode().lower().split(), b""]

    def contexts(before):
        """Contexts of all lengths, the longest last; the start stands once in front."""
        return [tuple(before[len(before) - k :]) for k in range(1, min(order - 1, len(before)) + 1)]

    for _, t, train in rows:
        if train:
            before = ["start"]
            for w in tokens(t):
                uni[w] += 1
                for h in contexts(before):
                    grams[h, w] += 1
                    ctx[h] += 1
                before.append(w)
    n, v = sum(uni.values()), len(uni)
    out = []
    for d, t, _ in rows:
        before, total, base = ["start"], 0.0, 0.0
        for w in tokens(t):
            p = (uni[w] + 1) / (n + v + 1)
            base += math.log10(p)
            for h in contexts(before):
                p = (grams[h, w] + lm.BACKOFF * p) / (ctx[h] + lm.BACKOFF)
            total += math.log10(p)
            before.append(w)
        out.append((d, len(tokens(t)), sum(uni[w] > 0 for w in tokens(t)), base, total))
    return n, out


def close(a, b):
    assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9) and a[4] == pytest.approx(b[4], rel=1e-9), (a, b)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    n, want = plain_model(rows)
    got = sorted(op1_backoff_lm(spark, sf_dir).collect())
    assert len(got) == len(want)
    held = {d: not t for d, _, t in rows}
    for r, w in zip(got, sorted(want)):
        assert r.train_tokens == n and r.held_out == held[r.doc_id]
        close((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score), w)


@pytest.mark.parametrize("order, fan", [(2, 512), (3, 512), (4, 512), (2, 3), (3, 2)])
def test_many_blocks_and_odd_rows(spark, order, fan):
    rows = [(None, None, True), (1, "", True), (2, "a b a b", True), (3, "A b\tc", True), (4, "new b words", False), (4, "new b words", False), (5, "c a b a b c b a b c", True), (6, "x a b a", False)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").selectExpr("*", "1 as id", "2 as words", "3 as place")
    _, want = plain_model(rows, order)
    scored, _ = lm.score(docs, F.col("train"), order=order, fan=fan, block_bytes=20)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r) for r in scored.collect()), key=key)
    assert len(got) == len(rows)
    for g, w in zip(got, sorted(want, key=key)):
        close(g, w)
    if order == 2:
        assert lm.score(docs.limit(0), F.col("train"), fan=fan)[0].collect() == []
        scored, totals = lm.score(docs, F.lit(False), fan=fan)
        assert totals["tokens"] == 0 and all(math.isfinite(r.score) for r in scored.collect())


def test_longer_order_and_cells_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.doc_id % 3 > 0) for r in docs.collect()]
    _, want = plain_model(rows, 3)
    scored, _ = lm.score(docs, F.col("doc_id") % 3 > 0, order=3, fan=2, block_bytes=40_000)
    for g, w in zip(sorted(map(tuple, scored.collect())), sorted(want)):
        close(g, w)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_states_are_distributions(order):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 5, 30)).encode() for _ in range(8)]
    block = lm.block_of(texts, np.ones(8, bool), order)
    n, counts = len(block.word_hash), block.train()
    total, seen = int(block.word_train.sum()), int((block.word_train > 0).sum())
    model = lm.Automaton(block, counts, total, seen, 8)
    unknown = 1 / (total + seen + 1)
    words = np.arange(n)
    reached = {0, 1, *model.ends.tolist(), *model.next_of_root.tolist()}  # all but those after an end
    assert len(reached) > 5 ** (order - 1)
    for state in reached:
        weights, _ = model.step(np.full(n, state), words)
        lost, at = 0.0, state
        while at:
            lost, at = lost + model.failure[at], model.fail_to[at]
        assert (10**weights).sum() + 10**lost * unknown == pytest.approx(1.0)


def test_failure_chains_are_as_long_as_the_order():
    texts = [b"a b c d", b"b c e", b"c f", b"g"]
    block = lm.block_of(texts, np.ones(4, bool), 4)
    model = lm.Automaton(block, block.train(), 13, 8, 4)
    state = np.ones(1, np.int64)
    number = {w: i for i, w in enumerate([b"", b"a", b"b", b"c", b"d", b"e", b"f", b"g"])}
    for w in (b"a", b"b", b"c"):
        _, state = model.step(state, np.array([number[w]]))
    chain = [int(state[0])]
    while chain[-1]:
        chain.append(int(model.fail_to[chain[-1]]))
    assert len(chain) == 4  # a b c, b c, c, root
    weights = [model.step(np.array([chain[0]]), np.array([number[w]]))[0][0] for w in (b"d", b"e", b"f", b"g")]
    assert weights == sorted(weights, reverse=True)


def test_totals_beyond_32_bits():
    """Three packs that share keys; two have nearly 2^32 of one each."""
    big, rare, word = 6, 10, (1 << 63) + 1
    keys = [np.array(k, np.uint64) for k in ([big, rare, word], [big, word], [rare])]
    counts = [np.array(c) for c in ([(1 << 32) - 1, 3, 2], [(1 << 32) - 1, 1], [4])]
    rows = [[0, i, lm.packed(k, c), i, 0, 0] for i, (k, c) in enumerate(zip(keys, counts))]
    answers = list(lm._answer(iter([lm._batch(lm.ASKED, list(zip(*rows)))])))
    want = {big: (1 << 33) - 2, rare: 7, word: 3}
    for k, batch in zip(keys, answers):
        assert lm._from_numbers(batch.column(2)[0].as_py()).tolist() == [want[x] for x in k.tolist()]
    assert [b.column(4)[0].as_py() for b in answers] == [1, 0, 0]


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**40)), max_size=50, unique_by=lambda x: x[0]))
def test_packs_round_trip(entries):
    keys, counts = (np.array(x, t) for x, t in zip(zip(*sorted(entries)), (np.uint64, np.int64))) if entries else (np.empty(0, np.uint64), np.empty(0, np.int64))
    got = lm.unpacked(lm.packed(keys, counts))
    assert got[0].tolist() == keys.tolist() and got[1].tolist() == counts.tolist()


def test_packs_of_a_block_stay_few():
    for ranges in (1, 7, 512, 513, 100_000):
        places = lm.Places(ranges)
        assert len(places.of(12345)) == places.groups <= lm.FAN
        assert places.groups * places.inner >= ranges


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000), (2, "word other")], "doc_id long, text string")
    rows = {r.id: r for r in lm.score(docs, F.lit(True), order=3)[0].collect()}
    assert rows[1].n_tokens == 300_001 and rows[1].score > rows[1].base_score
