from __future__ import annotations

import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomlake.llm import huffman
from loomlake.llm.queries import op6_huffman

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>"]


def plain(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=60, deadline=None)
@given(
    st.lists(
        st.lists(st.one_of(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=40), st.sampled_from([*SPECIAL, " ", "a"])), max_size=6).map("".join),
        max_size=5,
    )
)
def test_words_alone_give_the_ids_of_whole_texts(texts):
    ids, counts = huffman._tokenizer(PATH).encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for t in texts for i in plain(t)]
    assert counts.tolist() == [len(plain(t)) for t in texts]


def test_lengths_are_optimal_and_limited():
    rng = random.Random(4)
    for n in (2, 3, 17, 300):
        counts = np.array([int(rng.paretovariate(0.7)) for _ in range(n)])
        lengths = huffman.code_lengths(counts, 30)
        heap, best = list(map(int, counts)), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            best += x
            heapq.heappush(heap, x)
        assert int((lengths * counts).sum()) == best
        short = huffman.code_lengths(counts, max(2, n.bit_length()))
        assert short.max() <= max(2, n.bit_length()) and sum(2.0 ** -short) <= 1
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    assert huffman.code_lengths(fib, 4).max() == 4
    assert huffman.code_lengths(np.array([0, 7]), 4).tolist() == [0, 1]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) + rng.integers(0, 3000, n) * (rng.random(n) < 0.1), 60_000)
    book = huffman.Codebook(huffman.code_lengths(np.bincount(ids, minlength=1 << 16) if n else np.eye(1, 65536, dtype=int)[0]))
    bits, marks = book.pack(ids)
    assert book.unpack(bits, marks, n).tolist() == ids.tolist()


def test_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want, start = {}, 0
    for d, t in docs:
        ids = np.array(plain(t), "<u4")
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op6_huffman(spark, sf_dir).collect()}
    assert got == want


def test_odd_rows(spark):
    rows = [(5, "b"), (None, "x y"), (3, None), (4, ""), (5, "a"), (5, "b"), (9, "long " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as tokens", "2 as id", "3 as file")
    coded, book = huffman.write(docs, PATH, block_ids=100)
    got = huffman.read(coded, book).orderBy("start").collect()
    assert [r.id for r in got] == [None, 3, 4, 5, 5, 5, 9]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert np.frombuffer(got[-1].tokens, "<u4").tolist() == plain("long " * 3000)
    coded, book = huffman.write(docs.limit(0), PATH)
    assert huffman.read(coded, book).collect() == []


def test_strings_of_added_tokens():
    """As the library has it: these strings give their tokens, anywhere in a text, in their own case only."""
    texts = ["a <|endoftext|> b <|startoftext|>x", None, "<|ENDOFTEXT|>", "plain", "", "<|endoftext|><|endoftext|>", "é<|endoftext|>\n", "<|endoftext |>"]
    ids, counts = huffman._tokenizer(PATH).encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for t in texts for i in plain(t)]
    assert counts.tolist() == [len(plain(t)) for t in texts]
    assert plain(texts[0])[1] == 49407 and 49407 not in plain(texts[2])


def test_plain_words_and_odd_words():
    words = ["Straße's", "ÀÉÎ-ß,ÿ", "don't", "ßß1a2", "x²y", "İstanbul", "H̱a", "Ǆz", "a b", "<|endoftext|>", "100%,", "...'d!!", "ΣΑΣ", "\x1c\x7f", "Çé"]
    texts = [" ".join(words), *words, *(w.upper() for w in words), *(w.lower() for w in words)]
    ids, _ = huffman._tokenizer(PATH).encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for t in texts for i in plain(t)]
