from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from loomlake.llm import mixing
from loomlake.llm.common import n_words
from loomlake.llm.queries import op5_mixing, source_mix


def plain_targets(sizes, weights, total):
    capped: set[int] = set()
    while True:
        left = total - sum(2 * sizes[i] for i in capped)
        whole = sum(w for i, w in enumerate(weights) if i not in capped)
        t = [2.0 * sizes[i] if i in capped else left * w / whole for i, w in enumerate(weights)]
        more = {i for i in range(len(sizes)) if i not in capped and t[i] > 2 * sizes[i]}
        if not more:
            return t
        capped |= more


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    names = sorted(set(source.values()))
    sums = [sum(size[d] for d in size if source[d] == s) for s in names]
    targets = dict(zip(names, plain_targets(sums, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sums))))
    got = op5_mixing(spark, sf).collect()
    assert len(got) == len(docs)
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(targets[source[r.doc_id]])
        assert r.source_size == sums[names.index(source[r.doc_id])]
        taken[source[r.doc_id]] += r.taken
    for s in names:
        most = max(size[d] for d in size if source[d] == s)
        assert abs(taken[s] - targets[s]) <= most
    assert sorted(map(tuple, got)) == sorted(map(tuple, op5_mixing(spark, sf).collect()))


def test_flow_is_cheapest():
    rng = random.Random(2)
    for _ in range(30):
        patterns = {}
        for n in (1, 2, 3):
            for m in itertools.combinations("abc", n):
                if rng.random() < 0.7:
                    patterns["".join(m)] = (rng.randint(1, 4), m)
        quotas = {s: rng.randint(0, 6) for s in "abc"}
        sent = mixing.route(patterns, quotas)
        assert all(0 <= sent[p] <= 2 * patterns[p][0] for p in patterns)

        def reach(caps):
            # max flow value by cuts: over each set of sources, its quota plus what the other sources can take
            return min(
                sum(quotas[s] for s in cut) + sum(c for p, c in caps.items() if set(patterns[p][1]) - set(cut))
                for k in range(4)
                for cut in itertools.combinations("abc", k)
            )

        best = reach({p: 2 * patterns[p][0] for p in patterns})
        once = reach({p: patterns[p][0] for p in patterns})
        assert sum(sent.values()) == best
        assert sum(max(0, sent[p] - patterns[p][0]) for p in patterns) == best - once


def test_overlapping_sources_from_documents(spark):
    """Three sources that share documents: every quota is met up to a document a pattern, nothing is taken thrice."""
    rng = random.Random(8)
    kinds = [["a"], ["b"], ["a", "b"], ["b", "c"], ["a", "b", "c"]]
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), kinds[rng.randrange(5)]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    rows = mixing.sized(docs, F.col("sources"), n_words("text"))
    sizes = mixing.totals(rows)
    assert len(sizes) == 5
    total = sum(sizes.values())
    quotas = {'"a"': int(0.3 * total), '"b"': int(0.5 * total), '"c"': int(0.4 * total)}
    drawn = mixing.draw(rows, sizes, quotas)
    sent = mixing.route({k: (n, mixing.members_of(k)) for k, n in sizes.items()}, quotas)
    got = mixing.with_copies(rows, drawn, len(sizes), F.col("key"), F.col("bucket")).collect()
    assert len(got) == 600 and {r.copies for r in got} <= {0, 1, 2}
    for k in sizes:
        assert abs(sum(r["size"] * r.copies for r in got if r.key == k) - sent[k]) <= 30
    assert sum(sent.values()) == sum(quotas.values())


def test_patterns_apart_are_routed_alike():
    rng = random.Random(3)
    patterns = {f"p{i}": (rng.randint(1, 9), [f"s{i // 3}", f"s{i // 3 + 10 * (i % 2)}"]) for i in range(12)} | {f"q{i}": (5, [f"t{i}"]) for i in range(4)}
    quotas = {s: rng.randint(0, 12) for _, m in patterns.values() for s in m}
    apart, whole = mixing.route(patterns, quotas), mixing._flow(patterns, quotas, 2)
    assert sum(apart.values()) == sum(whole.values())
    cost = lambda sent: sum(max(0, sent[p] - patterns[p][0]) for p in patterns)
    assert cost(apart) == cost(whole)


def test_odd_rows(spark):
    rows = [(1, "a b c", None), (2, None, "x"), (3, "", "x"), (None, "d e", "x"), (4, "f", "x"), (4, "f", "x"), (5, "g h", '"x'), (6, "w " * 200_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "'k' as key", "2 as copies")
    got = source_mix(docs).collect()
    assert len(got) == 8 and sum(r["size"] for r in got) == 3 + 2 + 1 + 1 + 2 + 200_000
    assert {r.copies for r in got if r.id == 4} <= {0, 1, 2} and len({r.copies for r in got if r.id == 4}) == 1
    assert source_mix(docs.limit(0)).collect() == []
