"""Queries over whole texts against plain Python."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import __spark_entry__ as entry
from loomlake.functions.pandas_text import plain_clean_email
from loomlake.plans import catalog


def test_normalize_reads_every_letter_of_every_document(spark, sf_dir):
    folds = dict(zip("łøßæœþðđħıŋ", ["l", "o", "ss", "ae", "oe", "th", "d", "d", "h", "i", "n"]))

    def plain(text):
        bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return "".join(folds.get(c, c) for c in unicodedata.normalize("NFKC", bare.lower()))

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert any(set("ßæœø") & set(r.text) for r in rows) and any(len(r.text) > 400 for r in rows)
    got = {r.doc_id: r.h for r in entry.queries()["f_normalize"](spark, sf_dir).collect()}
    assert got == {r.doc_id: hashlib.md5(plain(r.text).encode()).hexdigest() for r in rows}


def test_mails_are_hashed_whole(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    threads = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        head = f"From: {r.lang}@mail.com\n" + ("List-Unsubscribe: <mailto:out@x>\n" if r.doc_id % 3 == 0 else "")
        threads.setdefault(f"thread {r.doc_id // 40}", []).append(head + f"Hi\n{r.text}".strip("\n"))
    got = {r.subject: (r.n, r.h) for r in entry.queries()["src_email"](spark, sf_dir).collect()}
    assert got == {s: (len(m), hashlib.md5("\n".join(m).encode()).hexdigest()) for s, m in threads.items()}
    assert max(n for n, _ in got.values()) <= 40


def test_mails_are_cleaned_whole(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.h for r in entry.queries()["f_email_clean"](spark, sf_dir).collect()}
    want = {r.doc_id: hashlib.md5(plain_clean_email(f"Hi\n{r.text}\nOn Monday Ada wrote:\n> old").encode()).hexdigest() for r in rows}
    assert got == want


def test_transcripts_join_whole_messages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    assert any(len(r.text) > 60 for r in rows)
    lines = {}
    for r in sorted(rows, key=lambda r: r.turn):
        lines.setdefault(r.conv_id, []).append(f"{r.role}: {r.text}")
    got = {r.conv_id: r.transcript for r in entry.queries()["transcript_day"](spark, sf_dir).collect()}
    assert got == {c: hashlib.md5("\n".join(x).encode()).hexdigest() for c, x in lines.items()}


def test_text_queries_read_whole_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for name in ("sentences", "noisy_lines", "leaks", "fact_lines", "mails", "raw_documents"):
        rows = [r for r in catalog.load(spark, sf, name).collect() if r.doc_id >= 0]
        assert len(rows) == len(texts) and all(texts[r.doc_id] in (r.body if "body" in r else r.text) for r in rows)
    got = entry.queries()["f_extract_entities"](spark, sf).where("doc_id >= 0 and kind = 'email' and surface != 'ada@example.com'")
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    want = {i for i, t in texts.items() if mail.search(t)}
    assert {r.doc_id for r in got.collect()} == want and len(want) == 11
