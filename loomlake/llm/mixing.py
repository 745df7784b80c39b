"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they are in). On the driver a flow routes token
capacity from patterns to source quotas; the c-th copy of a pattern's tokens costs c - 1, so the cost is convex in the
repetitions and first copies go before second ones. What a pattern sends is then drawn from its documents: whole copies
of all, and one more of those that come first in a seeded order of hashes. The order is cut at a hash bucket, found
from the pattern's bucket totals, so no pattern is ever sorted as a whole.

The driver holds one short row a pattern; with single membership that is one a source. Patterns that share no source
are routed apart, a pattern that is alone with its source without any search. Plans of up to SMALL rows are broadcast,
longer ones joined by key.

Results for odd input: null and empty texts have size 0 and are taken 0 times their size; a null source is a source
of its own, last in order; equal rows share a fate; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomlake.llm.common import stored

SMALL = 100_000
BUCKET_BITS = 16
STRETCH = 256


def shared_targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of total by weight that stop at most times the size; the excess is shared again until none is above."""
    targets = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes))]
    left = float(total)
    while open_:
        whole = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not above:
            for i in open_:
                targets[i] = left * weights[i] / whole
            break
        for i in above:
            targets[i] = most * sizes[i]
        left -= sum(targets[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return targets


def route(patterns: Mapping[str, tuple[int, Sequence[str]]], quotas: Mapping[str, int], copies: int = 2) -> dict[str, int]:
    """Tokens that each pattern (tokens, its sources) sends: a maximum flow into the quotas of least repetition cost."""
    head: dict[str, str] = {}

    def root(s: str) -> str:
        while head.setdefault(s, s) != s:
            head[s] = s = head[head[s]]
        return s

    for _, members in patterns.values():
        for s in members[1:]:
            head[root(s)] = root(members[0])
    parts: dict[str, list[str]] = {}
    for p, (_, members) in patterns.items():
        parts.setdefault(root(members[0]) if members else "", []).append(p)
    sent = {}
    for own in parts.values():
        tokens, members = patterns[own[0]]
        if len(own) == 1 and len(members) <= 1:
            sent[own[0]] = min(copies * tokens, sum(quotas.get(s, 0) for s in members))
        else:
            sources = {s for p in own for s in patterns[p][1]}
            sent |= _flow({p: patterns[p] for p in own}, {s: quotas[s] for s in quotas if s in sources}, copies)
    return sent


def _flow(patterns: Mapping[str, tuple[int, Sequence[str]]], quotas: Mapping[str, int], copies: int) -> dict[str, int]:
    """Successive shortest paths with potentials; arcs are source -> pattern copies -> member sources -> sink."""
    names = list(patterns)
    sources = list(quotas)
    at = {s: 1 + len(names) + i for i, s in enumerate(sources)}
    sink = 1 + len(names) + len(sources)
    graph: list[list[list]] = [[] for _ in range(sink + 1)]  # arc: [to, capacity, cost, index of the reverse arc]

    def arc(a: int, b: int, capacity: int, cost: int) -> None:
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for i, p in enumerate(names):
        tokens, members = patterns[p]
        for c in range(copies):
            arc(0, 1 + i, tokens, c)
        for s in members:
            if s in at:
                arc(1 + i, at[s], copies * tokens, 0)
    for s in sources:
        arc(at[s], sink, quotas[s], 0)
    potential = [0] * (sink + 1)
    while True:
        far = 1 << 60
        distance, came = [far] * (sink + 1), [None] * (sink + 1)
        distance[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > distance[a]:
                continue
            for x in graph[a]:
                if x[1] > 0 and (n := d + x[2] + potential[a] - potential[x[0]]) < distance[x[0]]:
                    distance[x[0]] = n
                    heapq.heappush(heap, (n, x[0]))
        if distance[sink] == far:
            break
        for v in range(sink + 1):
            if distance[v] < far:
                potential[v] += distance[v]
        # a blocking flow along the arcs of reduced cost zero: many paths of one length at once
        while True:
            level = [-1] * (sink + 1)
            level[0], queue = 0, [0]
            for a in queue:
                for x in graph[a]:
                    if x[1] > 0 and level[x[0]] < 0 and distance[x[0]] < far and x[2] + potential[a] - potential[x[0]] == 0:
                        level[x[0]] = level[a] + 1
                        queue.append(x[0])
            if level[sink] < 0:
                break
            nxt = [0] * (sink + 1)
            while True:
                path, a = [], 0
                while a != sink:
                    while nxt[a] < len(graph[a]):
                        x = graph[a][nxt[a]]
                        if x[1] > 0 and level[x[0]] == level[a] + 1 and x[2] + potential[a] - potential[x[0]] == 0:
                            break
                        nxt[a] += 1
                    if nxt[a] == len(graph[a]):
                        if not path:
                            break
                        a = path.pop()[0]
                        nxt[a] += 1
                        continue
                    path.append((a, graph[a][nxt[a]]))
                    a = path[-1][1][0]
                if a != sink:
                    break
                least = min(x[1] for _, x in path)
                for _, x in path:
                    x[1] -= least
                    graph[x[0]][x[3]][1] += least
    return {p: _sent(graph, i) for i, p in enumerate(names)}


def _sent(graph: list[list[list]], i: int) -> int:
    """Flow into pattern i: what its reverse arcs to the source node hold."""
    return sum(x[1] for x in graph[1 + i] if x[0] == 0)


def pattern_key(members: Column) -> Column:
    """A string for a set of sources; null elements stay."""
    return F.to_json(F.array_sort(F.array_distinct(members)))


def place_of(id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> Column:
    """Hash bucket of a document: its place in the seeded order of its pattern."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 64 - BUCKET_BITS)


def sized(docs: DataFrame, members: Column, size: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(id, key, size, bucket), written down: the texts are read once."""
    cols = (F.col(id_col).cast("long").alias("id"), pattern_key(members).alias("key"), size.alias("size"))
    return stored(docs.select(*cols, place_of(id_col, text_col, seed).alias("bucket")), "mixing")


def totals(rows: DataFrame) -> dict[str, int]:
    """Size of each pattern; one short row a pattern reaches the driver."""
    return {r["key"]: int(r["size"]) for r in rows.groupBy("key").agg(F.sum("size").alias("size")).collect()}


def small(plan: DataFrame, rows: int) -> DataFrame:
    """A plan of known length, to be broadcast if it is short."""
    return F.broadcast(plan) if rows <= SMALL else plan


def members_of(key: str) -> list[str]:
    """Names of a pattern's sources as JSON, so that null stays apart from any text."""
    return [json.dumps(s) for s in json.loads(key)]


def draw(rows: DataFrame, sizes: Mapping[str, int], quotas: Mapping[str, int], copies: int = 2) -> DataFrame:
    """(key, whole, cut): each pattern's copies of all its documents, and the last bucket that gets one more; as many
    rows as sizes has."""
    spark = rows.sparkSession
    sent = route({k: (n, members_of(k)) for k, n in sizes.items()}, quotas, copies)
    plan = [(k, int(f // sizes[k]) if sizes[k] else 0, int(f % sizes[k]) if sizes[k] else 0) for k, f in sent.items()]
    plan = spark.createDataFrame(plan, "key string, whole int, rest long")
    # running totals in two levels: a hot pattern's buckets are spread over its stretches of STRETCH buckets
    stretch = F.floor(F.col("bucket") / STRETCH).alias("stretch")
    by_bucket = rows.groupBy("key", stretch, "bucket").agg(F.sum("size").alias("n"))
    whole = rows.groupBy("key", stretch).agg(F.sum("size").alias("m"))
    earlier = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("key", "stretch", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "stretch").orderBy("bucket")
    by_bucket = by_bucket.withColumn("within", F.sum("n").over(inside)).join(whole, ["key", "stretch"])
    by_bucket = by_bucket.select("key", "bucket", "n", (F.col("base") + F.col("within")).alias("upto"))
    # a bucket is in if that brings the total nearer to the rest
    near = by_bucket.join(small(plan, len(sizes)), "key").where("rest > 0 and 2 * upto - n <= 2 * rest")
    cut = near.groupBy("key").agg(F.max("bucket").alias("cut"))
    return plan.join(cut, "key", "left").select("key", "whole", F.coalesce("cut", F.lit(-1)).alias("cut"))


def with_copies(rows: DataFrame, drawn: DataFrame, n: int, key: Column, bucket: Column, out: str = "copies") -> DataFrame:
    """rows with column out: how often the mix takes each document; drawn has n rows."""
    drawn = drawn.select(F.col("key").alias("_key"), F.col("whole").alias("_whole"), F.col("cut").alias("_cut"))
    joined = rows.join(small(drawn, n), key == drawn["_key"])
    copies = drawn["_whole"] + F.when(bucket <= drawn["_cut"], 1).otherwise(0)
    return joined.select(*(rows[f"`{c}`"] for c in rows.columns if c != out), copies.alias(out))


def weighted_quotas(sizes: Mapping[str, int], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str, float]:
    """Targets of single sources in code point order, null last, by repeating weights."""
    order = sorted(sizes, key=lambda k: ((s := json.loads(k)[0]) is None, s or ""))
    n = [sizes[k] for k in order]
    return dict(zip(order, shared_targets(n, [weights[i % len(weights)] for i in range(len(n))], share * sum(n), most)))
