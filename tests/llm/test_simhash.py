from __future__ import annotations

import numpy as np
import pytest
import xxhash

from loomlake.llm import simhash
from loomlake.llm.components import connected


def plain_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(4, len(words))
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    part = list(range(len(fps)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                part[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d if d is not None else -1, f"{fp:016x}", least.get(root(i))) for i, (d, fp) in enumerate(fps))


def result(df):
    return sorted((r.id if r.id is not None else -1, r.fingerprint, r.component_id) for r in df.collect())


def test_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(simhash.near_duplicates(docs)) == plain_components(rows)


def test_many_near_copies_and_odd_rows(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*base[: 390 - i % 9], f"x{i}", *base[395:]])) for i in range(60)]
    rows += [(None, None), (100, ""), (101, None), (102, " \n"), (103, "One two"), (104, "one  TWO"), (104, "one  TWO")]
    rows += [(None, "alone among ids")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id", "3 as id")
    assert result(simhash.near_duplicates(docs)) == plain_components(rows)


@pytest.mark.parametrize("layout", simhash.LAYOUTS)
def test_every_layout_meets_all_pairs_in_reach(layout):
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for bits in range(5):
        other = fps.copy()
        for i in range(len(other)):
            for b in rng.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        mine, theirs = (simhash.ball_keys(x, layout, 4) for x in (fps, other))
        assert all(set(a) & set(b) for a, b in zip(mine.tolist(), theirs.tolist()))
    strangers = simhash.ball_keys(rng.integers(0, 1 << 63, 300, dtype=np.uint64), layout, 4)
    assert not set(strangers.ravel().tolist()) & set(mine.ravel().tolist())


def test_longer_segments_for_larger_corpora(spark, sf_dir):
    assert simhash.layout_for(4, 10**6) == simhash.LAYOUTS[0] and simhash.layout_for(4, 10**11) == simhash.LAYOUTS[1]
    assert simhash.LAYOUTS[1].crowd(4, 10**11) < 2
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(simhash.near_duplicates(docs, layout=simhash.LAYOUTS[1])) == plain_components(rows)


def test_hubs_in_components(spark):
    rng = np.random.default_rng(5)
    links = [(1, i) for i in range(2, 300)] + [(1000 + i, 1001 + i) for i in range(40)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2100, (60, 2))]
    want: dict[int, int] = {x: x for pair in links for x in pair}
    for _ in want:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    table = spark.createDataFrame(links, "a long, b long")
    for hub in (10, 10**6):
        assert {r.node: r.label for r in connected(table, hub).collect()} == {x: want[x] for x in linked}


def test_ties_stay_defined(spark):
    rows = [(7, "same text", "b"), (7, "same text", "a"), (9, "same text", "c"), (None, "same text", "d"), (8, "other words here", None)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, `a.b` string")
        assert sorted(map(tuple, simhash.deduplicated(docs).collect())) == [(7, "same text", "a"), (8, "other words here", None)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
