from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomlake.llm import rules
from loomlake.llm.queries import op2_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    hit = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(hit) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(hit), failed


def test_base_counts(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_quality_rules(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_odd_texts(spark):
    texts = [None, "", " \n\t", "a", "a b c", "a b c a b c", "a a a a", "x\x0by\x0cz\r\nx y z\r\nx y z\r\n", "é ü # * | <> é ü #\n\nl\nl\n l", "w " * 9000]
    docs = spark.createDataFrame([(i or None, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n_words", "'x' as w")
    got = {(r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.counted(docs).collect()}
    assert got == {(i or None, *plain(t)[:5]) for i, t in enumerate(texts)}
    none = spark.createDataFrame([], "id long, label int")
    out, found = rules.judged(docs, none)
    assert found == [] and out.count() == 2 * len(texts)
    assert rules.judged(docs.limit(0), none)[0].collect() == []


def test_learns_a_planted_list(spark):
    rows = spark.range(6000).select(
        F.col("id").alias("of"), (F.hash("id") % 100 / 100.0).alias("a"), (F.hash("id", F.lit(1)) % 100 / 100.0).alias("b")
    )
    bad = ((F.col("a") > 0.7) & (F.col("b") > 0.5)) | (F.col("a") < -0.8)
    labelled = rows.withColumn("label", F.when(bad, 0).otherwise(1))
    numbers = {"a": F.col("a"), "b": F.col("b")}
    found = rules.learn(labelled, numbers, F.col("of") % 3)
    out = labelled.withColumn("rule", rules.first_rule(found, numbers))
    wrong = out.where((F.col("rule") > 0) != (F.col("label") == 0)).count()
    assert 2 <= len(found) <= 6 and wrong < 0.05 * 6000
    assert str(found[0][0]).split()[0] in numbers


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_clean_documents_stay(spark, sf):
    out = op2_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id")
    r = out.where(~F.col("base_failed")).groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    share = {x.quality: x.kept for x in r}
    print(share)
    assert share[1] > 0.97 and share[0] < 0.6
