from __future__ import annotations

import base64
import hashlib
import random
import string
import time

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlake.llm import bpe
from loomlake.llm.queries import op7_byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
OWN = bpe.ByteBpe(PATH, public_tokenizers.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
PLAIN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60), max_size=5))
def test_same_ids_as_the_library(texts):
    ids, sizes = OWN.encode(texts)
    want = [PLAIN.encode_ordinary(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_long_piece_and_repeats():
    texts = ["a" * 3000, "ab" * 500 + " " * 70, "", "\n\n  x", "Ärger 東京 😀" * 40]
    ids, _ = OWN.encode(texts)
    assert ids.tolist() == [i for t in texts for i in PLAIN.encode_ordinary(t)]


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="abst", min_size=bpe.LONG - 2, max_size=3 * bpe.LONG), st.integers(1, 3))
def test_matches_above_the_longest_row(text, times):
    assert OWN.encode([text * times])[0].tolist() == PLAIN.encode_ordinary(text * times)


def test_a_match_of_a_million_letters():
    rng = random.Random(3)
    text = "".join(rng.choice(string.ascii_lowercase) for _ in range(1_000_000))
    start = time.time()
    ids, _ = OWN.encode([text])
    assert time.time() - start < 60
    flat, _ = OWN.decode(ids)
    assert flat.tobytes() == text.encode()
    # far from its ends a part is merged as it is alone
    part, _ = OWN.encode([text[:100_000]])
    assert ids[:60_000].tolist() == part[:60_000].tolist() and part.tolist() == PLAIN.encode_ordinary(text[:100_000])


def test_query_matches_library(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = PLAIN.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "x"), (2, "x")], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as id")
    rows = bpe.digests(bpe.encode(docs, OWN), OWN).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 1, 1]
    assert {r.ids_sha256 for r in rows if not r.n_tokens} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.encode(docs.limit(0), OWN).collect() == []
    assert [bytes(r.bytes) for r in bpe.decode(bpe.encode(docs.where("doc_id = 2"), OWN), OWN).collect()] == [b"x", b"x"]
