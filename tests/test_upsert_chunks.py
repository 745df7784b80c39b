"""Chunks after an upsert, against plain Python."""

from __future__ import annotations

from loomlake.functions.extensions import HashEmbedder
from loomlake.functions.pandas_text import plain_chunks
from loomlake.plans.stores import rechunked


def test_old_chunks_go_and_others_stay(spark):
    text = "# Head\n" + "word " * 600 + "\n\n## Next\nshort"
    writes = spark.createDataFrame(
        [("d1", "ns", "k", 1, 1, "t", 1, "first text"), ("d9", "ns", "k", 2, 2, "t", 1, text)],
        "document_id string, namespace string, doc_key string, created_at long, updated_at long, title string, priority int, content string",
    )
    old = spark.createDataFrame(
        [("d1", i, "", f"old {i}", [0.0], "old", 1) for i in range(9)] + [("d2", 0, "", "kept", [1.0], "old", 1)],
        "document_id string, seq int, heading string, content string, embedding array<double>, signature string, dim int",
    )
    rows = {(r.document_id, r.seq): r for r in rechunked(writes, old).collect()}
    want = plain_chunks(text, 225)
    assert set(rows) == {("d2", 0), *(("d1", c["index"]) for c in want)} and len(want) > 2
    for c in want:
        r = rows["d1", c["index"]]
        assert (r.heading, r.content, r.signature, r.dim) == (c["heading"], c["content"], "local/hash/64", 64)
        assert list(r.embedding) == HashEmbedder(64).embed([c["content"]])[0]
    assert rows["d2", 0].content == "kept"
