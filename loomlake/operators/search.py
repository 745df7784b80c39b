"""Lexical, vector and hybrid retrieval as joins over postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions.scalars import with_one
from loomlake.session import written
from loomlake.functions import vectors
from loomlake.operators.tables import newest

K1, B = 1.2, 0.75
#: Engine-defined weights of the hybrid score; they are shared out over the signals that are present.
HYBRID = {"keyword": 0.35, "vector": 0.35, "graph": 0.15, "episodic": 0.05, "freshness": 0.10}


def words(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): counted per document before the shuffle by term."""
    return docs.select(key, F.explode(words(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _count(array: str, value: str) -> Column:
    return F.size(F.filter(array, lambda x: x == F.lit(value)))


def bm25(docs: DataFrame, key: str, text: str, terms: Sequence[str], all_terms: bool = True) -> DataFrame:
    """(key, score): BM25 of the documents that hold all (or any) terms. Only the terms' occurrences leave the scan."""
    wanted = sorted(set(terms))
    w = words(text)
    counts = [_count("w", t).alias(f"t{i}") for i, t in enumerate(wanted)]
    # written down: the texts are cut into words once, for the statistics and the scores
    rows = written(docs.select(key, w.alias("w")).select(key, F.size("w").alias("len"), *counts), "bm25")
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(wanted))))  # one row
    hit = [F.col(f"t{i}") > 0 for i in range(len(wanted))]
    keep = hit[0]
    for h in hit[1:]:
        keep = keep & h if all_terms else keep | h
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        tf = F.col(f"t{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return rows.where(keep).transform(with_one, stats).select(key, F.round(score, 6).alias("score"))


def vec_search(rows: DataFrame, query: Sequence[float], k: int, floor: float | None = None) -> DataFrame:
    """The k nearest of (id, embedding) by clamped cosine, exact; optionally only those of at least floor."""
    q = F.array(*(F.lit(float(x)) for x in query))
    hits = rows.select("id", F.round(vectors.cosine("embedding", q), 6).alias("similarity"))
    if floor is not None:
        hits = hits.where(F.col("similarity") >= floor)
    return hits.orderBy(F.desc("similarity"), "id").limit(k)


def grams(term: str) -> list[str]:
    return sorted({term[i : i + 3] for i in range(len(term) - 2)})


def gram_index(docs: DataFrame, key: str, text: str, only: Sequence[str] | None = None) -> DataFrame:
    """(gram, key): postings of the distinct trigrams of lower-case texts, or of some only; a stored index is all of
    them, laid out by gram."""
    chars = docs.select(key, F.split(F.lower(text), "").alias("c"))
    places = F.when(F.size("c") >= 3, F.sequence(F.lit(0), F.size("c") - 3)).otherwise(F.array().cast("array<int>"))
    own = F.array_distinct(F.transform(places, lambda i: F.concat(F.get("c", i), F.get("c", i + 1), F.get("c", i + 2))))
    if only is not None:
        own = F.array_intersect(own, F.array(*(F.lit(g) for g in only)))
    return chars.select(F.explode(own).alias("gram"), key)


def candidates(index: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """(key): documents whose postings have all trigrams of some term."""
    held = index.where(F.col("gram").isin(*{g for t in terms for g in grams(t)})).groupBy(key).agg(F.collect_set("gram").alias("held"))  # a few grams a document
    hit = F.lit(False)
    for t in terms:
        own = F.array(*(F.lit(g) for g in grams(t)))
        hit = hit | (F.size(F.array_intersect("held", own)) == len(grams(t)))
    return held.where(hit).select(key)


def gram_match(docs: DataFrame, key: str, text: str, at: str, terms: Sequence[str], index: DataFrame | None = None, guard: int = 10_000) -> DataFrame:
    """(key, at, matched, score): documents holding the terms as substrings; repeated terms count each time.

    Candidates come from the trigram postings, and only their texts are looked at. With more candidates than guard all
    of them are returned with score 0, so that the newest come first. Terms under three bytes are not searched."""
    terms = [t.lower() for t in terms if len(t.encode()) >= 3]
    wanted = sorted({g for t in terms for g in grams(t)})
    found = candidates(gram_index(docs, key, text, wanted) if index is None else index, key, sorted({t for t in terms if grams(t)}))
    many = found.agg(F.count("*").alias("n"))  # one row
    low = F.lower(text)
    total = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    rows = docs.select(key, at, text).join(found, key).select(key, at, total.alias("hits")).transform(with_one, many)
    full = F.col("n") > guard
    rows = rows.where(full | (F.col("hits") > 0)).select(key, at, F.when(full, 0).otherwise(F.col("hits")).alias("matched"))
    return rows.withColumn("score", F.round(F.col("matched") / max(1, len(terms)), 6))


def hybrid(branches: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, a column a branch, final, signals): weighted mean of branch scores (key, score), held within 0 and 1, over
    the branches that know the document."""
    tagged = None
    for name, rows in branches.items():
        part = rows.select(key, F.lit(name).alias("branch"), F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"), F.lit(HYBRID[name]).alias("w"))
        tagged = part if tagged is None else tagged.unionByName(part)
    shown = [F.round(F.max(F.when(F.col("branch") == name, F.col("score"))), 6).alias(name) for name in branches]
    final = F.round(F.sum(F.col("w") * F.col("score")) / F.sum("w"), 6)
    return tagged.groupBy(key).agg(*shown, final.alias("final"), F.count("*").alias("signals"))


def context(facts: DataFrame, key: str, types: dict[str, Column], most: int) -> DataFrame:
    """(key, facts, context): how many facts (subject, predicate, object) a key has, and the first of them as lines with
    the type of each end. The limit precedes the gathering, so no group is held whole."""
    line = F.concat("subject", F.lit(" ("), types["subject"], F.lit(") -["), "predicate", F.lit("]-> "), "object", F.lit(" ("), types["object"], F.lit(")"))
    lines = facts.select(key, line.alias("line"))
    counts = lines.groupBy(key).agg(F.count("*").alias("facts"))
    first = newest(lines, [key], most, [F.asc("line")]).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("context"))
    return counts.join(first, key)
