from __future__ import annotations

import re
from pathlib import Path

import corpus_pipeline
from loomlake.llm import queries, simhash, toxicity
from loomlake.llm.common import shared_dir, stored
from tests.llm.test_bpe import PLAIN
from tests.llm.test_secrets import plain_base
from tests.llm.test_simhash import plain_fingerprint

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    bad = {r.id for r in toxicity.score(docs, queries.toxicity_index(docs, spark, SF)).where("predicted = 1").collect()}
    clean = stored(corpus_pipeline.drop_toxic(spark, docs, SF), "t")
    assert clean.columns == columns
    rows = clean.collect()
    assert {r.doc_id for r in rows} == set(before) - bad and bad

    left = stored(corpus_pipeline.one_of_each(spark, clean, SF), "t")
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    part: dict[int, int] = {}
    for d in sorted(fps):  # flood from the smallest id: it is the one that stays
        if d in part:
            continue
        part[d], todo = d, [d]
        while todo:
            x = todo.pop()
            near = [y for y in fps if y not in part and (fps[x] ^ fps[y]).bit_count() <= 4]
            part.update(dict.fromkeys(near, d))
            todo += near
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(part.values()))
    assert left.columns == columns

    hidden = stored(corpus_pipeline.hide_secrets(spark, left, SF), "t")
    for r in hidden.collect():
        if not plain_base(before[r.doc_id].text) and "[secret]" not in r.text:
            assert tuple(r) == tuple(before[r.doc_id])
        assert not plain_base(r.text) and r.n_chars == len(r.text)

    mixed = stored(corpus_pipeline.mix_sources(spark, hidden, SF), "t")
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in hidden.collect()}
    taken = [r.doc_id for r in mixed.collect()]
    assert all(taken.count(d) <= 2 for d in set(taken)) and set(taken) <= set(words)
    assert abs(sum(words[d] for d in taken) / (1.5 * sum(words.values())) - 1) < 0.1

    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in corpus_pipeline.encode_texts(spark, mixed, SF).collect():
        assert list(r.ids) == PLAIN.encode_ordinary(texts[r.doc_id]) and r.decodes and r.n_tokens == len(r.ids)


def test_run_leaves_one_copy(spark, sf_dir):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    rows = corpus_pipeline.run(spark, sf_dir).count()
    left = [p.name for p in set(folder.iterdir()) - before]
    assert rows and len(left) == 1 and left[0].startswith("pipeline-3-")


def test_whole_run_agrees_with_itself(spark, sf_dir):
    a, b = (sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) for _ in range(2))
    assert a and a == b


def test_odd_rows(spark, sf_dir):
    rows = [(None, None, None, None, None), (None, "x", None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c d e", None, "s", None), (2, "a b c d e", None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as _id", "2 as _key", "3 as fp", "4 as `a.b`")
    for table in (docs, docs.limit(0)):
        now = stored(table, "odd")
        for _, stage in corpus_pipeline.STAGES:
            now = stored(stage(spark, now, sf_dir), "odd")
        now.count()
    kept = simhash.deduplicated(docs).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, "x"), (1, ""), (2, "a b c d e")], key=str)
