"""Sources, sinks, segmentation, compaction and the Python text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators import compaction
from loomlake.operators import segments as seg
from loomlake.plans.catalog import QUERIES, TWINS, load, query, stand_in
from loomlake.session import fresh_path
from loomlake.sources import contacts, readers

stand_in("log_lines", "select event_id, case when event_id % 10 = 0 then chr(123) || 'bad' when event_id % 11 = 0 then '  ' else props end as line from {events}")
#: Whole texts as bodies, 40 mails a thread at any size of the table.
stand_in("mails", """select doc_id, 'thread ' || cast(cast(floor(doc_id / 40) as bigint) as string) as subject, lang || '@mail.com' as sender, doc_id * 60 as sent_at, 'Hi' || chr(10) || text || chr(10) || 'On Monday Ada wrote:' || chr(10) || '> old' as body, case when doc_id % 3 = 0 then '<mailto:out@x>' else null end as unsubscribe from {documents}""")
stand_in("raw_documents", """select doc_id, case doc_id % 4 when 0 then cast(doc_id * 1000 as string) when 1 then '2024-01-02T03:04:05' when 2 then 'soon' else null end as stamp, case when doc_id % 5 = 0 then null else source end as provider, text as body from {documents}""")
stand_in("responses", """select doc_id, 'Subject A ' || cast(doc_id as string) || chr(10) || 'body ' || lang || chr(10) || '---' || chr(10) || 'Subject B' || chr(10) || case doc_id % 3 when 0 then '## Subject C' || chr(10) || 'x' when 1 then '### subject c' else '## Other' end as markdown,
    'subject a ' || cast(doc_id as string) as first, case when doc_id % 5 = 0 then 'Subject Z' else 'Subject B' end as second, 'SUBJECT C' as third, lang from {documents}""")
stand_in("marked_turns", "select user_id as session_id, event_id as turn, @sec(ts) as sec, event_type = 'error' as marker from {events}")


@query("src_jsonl", ["log_lines"], "select cast(json_extract(line, '$.k') as bigint) as k, count(*) as n from log_lines where event_id % 10 <> 0 and event_id % 11 <> 0 group by 1")
def src_jsonl(lines: DataFrame) -> DataFrame:
    return readers.parsed_lines(lines, "line", "k long").groupBy("k").agg(F.count("*").alias("n"))


def src_dir_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.dir_walk(spark, sf_dir, "*.parquet", ("parquet",)).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "bytes", "digest", "supported")


QUERIES["src_dir_walk"] = src_dir_walk


@query("src_chat", ["messages"], "select conv_id, md5('# Chat transcript' || chr(10) || string_agg('## ' || cast(turn as varchar) || ' — ' || role || chr(10) || body, chr(10) order by turn)) as h from messages group by 1")
def src_chat(messages: DataFrame) -> DataFrame:
    return readers.transcript(messages, "conv_id", "turn", "role", F.col("body")).select("conv_id", F.md5("markdown").alias("h"))


@query("src_email", ["mails"], """select subject, count(*) as n, min(sent_at) as first_sent, md5(string_agg('From: ' || sender || chr(10) || coalesce('List-Unsubscribe: ' || unsubscribe || chr(10), '') || trim(split_part(body, chr(10) || 'On Monday', 1), chr(10)), chr(10) order by sent_at)) as h from mails group by 1""")
def src_email(mails: DataFrame) -> DataFrame:
    own = F.btrim(F.split_part("body", F.lit("\nOn Monday"), F.lit(1)), F.lit("\n"))
    head = F.concat(F.lit("From: "), "sender", F.lit("\n"), F.coalesce(F.concat(F.lit("List-Unsubscribe: "), "unsubscribe", F.lit("\n")), F.lit("")), own)
    lines = F.array_sort(F.collect_list(F.struct("sent_at", head.alias("m"))))
    by = mails.groupBy("subject").agg(F.count("*").alias("n"), F.min("sent_at").alias("first_sent"), lines.alias("l"))
    return by.select("subject", "n", "first_sent", F.md5(F.array_join(F.transform("l", lambda x: x["m"]), "\n")).alias("h"))


@query("src_document", ["raw_documents"], """select doc_id, coalesce(provider, 'unknown') as provider, case when regexp_matches(stamp, '^[0-9]+$') then cast(stamp as bigint) when try_strptime(stamp, '%Y-%m-%dT%H:%M:%S') is not null then epoch_ms(try_strptime(stamp, '%Y-%m-%dT%H:%M:%S')) else 1700000000000 end as ts_ms from raw_documents""")
def src_document(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.coalesce("provider", F.lit("unknown")).alias("provider"), readers.document_time(F.col("stamp"), F.lit(1_700_000_000_000)).alias("ts_ms"))


@query("src_email_reshape", ["responses"], """select doc_id, unnest(['Subject A ' || cast(doc_id as varchar) || chr(10) || 'body ' || lang, 'Subject B', case doc_id % 3 when 0 then '## Subject C' || chr(10) || 'x' else '### subject c' end]) as part, unnest([0, 1, 2]) as pos from responses where doc_id % 3 <> 2 and doc_id % 5 <> 0
 union all select doc_id, markdown, 0 from responses where doc_id % 3 = 2 or doc_id % 5 = 0""")
def src_email_reshape(rows: DataFrame) -> DataFrame:
    parts = readers.verified_messages(F.col("markdown"), F.array("first", "second", "third"))
    return rows.select("doc_id", F.posexplode(F.coalesce(parts, F.array("markdown"))).alias("pos", "part"))


@query("src_slack_bucket", ["messages"], "select case when conv_id % 3 = 0 then 'private:' || chat_id else '#' || chat_id end as label, count(*) as n, min(sec) as first_sec, string_agg(cast(message_id as varchar), ',' order by sec, message_id) as refs from messages group by 1")
def src_slack_bucket(messages: DataFrame) -> DataFrame:
    label = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("private:"), "chat_id")).otherwise(F.concat(F.lit("#"), "chat_id"))
    ordered = F.array_sort(F.collect_list(F.struct("sec", "message_id")))
    by = messages.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.min("sec").alias("first_sec"), ordered.alias("o"))
    return by.select("label", "n", "first_sec", F.array_join(F.transform("o", lambda x: x["message_id"].cast("string")), ",").alias("refs"))


@query("src_addressbook", ["customer"], "select c_custkey as person, 'name' as kind, lower(c_name) as handle from customer union all select c_custkey, 'email', 'user' || cast(c_custkey % 100 as varchar) || '@mail.com' from customer")
def src_addressbook(customer: DataFrame) -> DataFrame:
    return contacts.handles(customer).select("person", "kind", "handle")


@query("src_imessage", ["messages", "handles"], "select m.message_id, h.value as handle from messages m join handles h on h.c_custkey = m.conv_id where m.message_id > 500")
def src_imessage(messages: DataFrame, handles: DataFrame) -> DataFrame:
    fresh = messages.where("message_id > 500").select("message_id", F.col("conv_id").alias("c_custkey"))
    return fresh.join(handles.select("c_custkey", F.col("value").alias("handle")), "c_custkey").select("message_id", "handle")


def file_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "memory_docs").select("document_id", "content")
    return readers.write_if_new(rows, fresh_path(spark, "file-sink")).select("document_id", "sha", "intact")


QUERIES["file_sink"] = file_sink
TWINS["file_sink"] = (["memory_docs"], "select document_id, sha256(content) as sha, true as intact from memory_docs")

SEGS = """with recursive s as (select *, row_number() over (partition by session_id order by turn) as rn from marked_turns),
 f as (select session_id, rn, turn, sec, cast(0 as bigint) as segment, 1 as n, '' as reason from s where rn = 1 union all
 select s.session_id, s.rn, s.turn, s.sec, f.segment + case when f.n >= 20 or s.sec - f.sec > 86400 or s.marker then 1 else 0 end, case when f.n >= 20 or s.sec - f.sec > 86400 or s.marker then 1 else f.n + 1 end,
 case when f.n >= 20 then 'count' when s.sec - f.sec > 86400 then 'gap' when s.marker then 'marker' else '' end from f join s on s.session_id = f.session_id and s.rn = f.rn + 1)"""


@query("segments", ["marked_turns"], SEGS + " select session_id, turn, segment, reason from f")
def segments(turns: DataFrame) -> DataFrame:
    return seg.segments(turns, "session_id", "turn", "sec", "marker", gap=86_400).select("session_id", "turn", "segment", "reason")


@query("segment_drift", ["embeddings"])
def segment_drift(rows: DataFrame) -> DataFrame:
    turns = rows.select((F.col("vec_id") % 50).alias("session_id"), F.col("vec_id").alias("turn"), F.col("vec_id").alias("sec"), F.lit(False).alias("marker"), "embedding")
    return seg.segments(turns, "session_id", "turn", "sec", "marker", "embedding").groupBy("session_id").agg((F.max("segment") + 1).alias("segments"), F.count_if(F.col("reason") == "drift").alias("drifts"))


@query("f_chunk_md", ["documents"])
def f_chunk_md(docs: DataFrame) -> DataFrame:
    from loomlake.functions.pandas_text import chunk_markdown

    return docs.select("doc_id", F.explode(chunk_markdown(225)("text")).alias("c")).select("doc_id", "c.index", "c.heading", F.octet_length("c.content").alias("bytes"), F.md5("c.content").alias("h"))


def _email_sql() -> str:
    """Lines up to the first that begins a reply chain or footer, blank runs collapsed."""
    from loomlake.functions.pandas_text import FOOTER, FOOTER_TRIGGERS, REPLY

    blank = "chr(32) || chr(9) || chr(13) || chr(11) || chr(12) || chr(10)"
    marks = " or ".join(f"contains(lower(l[i]), '{t.replace(chr(39), chr(39) * 2)}')" for t in FOOTER_TRIGGERS)
    ends = " or ".join(f"regexp_matches(trim(l[i], {blank}), '(?i){form.pattern}')" for form in (REPLY, FOOTER))
    quoted = " and ".join(f"starts_with(trim(l[i + {k}], {blank}), '>')" for k in range(3))
    return f"""with m as (select doc_id, string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)) as l from mails),
 c as (select doc_id, l, list_filter(range(1, len(l) + 1), lambda i: {ends} or {marks} or (i + 2 <= len(l) and {quoted})) as stops from m),
 k as (select doc_id, array_to_string(list_transform(list_slice(l, 1, coalesce(stops[1] - 1, len(l))), lambda x: rtrim(x, {blank})), chr(10)) as own from c)
 select doc_id, md5(trim(regexp_replace(own, '\\n\\n\\n+', chr(10) || chr(10), 'g'), {blank})) as h from k"""


@query("f_email_clean", ["mails"], _email_sql())
def f_email_clean(mails: DataFrame) -> DataFrame:
    from loomlake.functions.pandas_text import clean_email

    return mails.select("doc_id", F.md5(clean_email("body")).alias("h"))


@query("f_vec_codec", ["embeddings"], "select vec_id, cast(len(embedding) * 4 as integer) as bytes, true as same from embeddings")
def f_vec_codec(rows: DataFrame) -> DataFrame:
    from loomlake.functions.pandas_text import pack_vector, unpack_vector

    packed = rows.select("vec_id", "embedding", pack_vector("embedding").alias("b"))
    return packed.select("vec_id", F.octet_length("b").alias("bytes"), (unpack_vector("b") == F.col("embedding")).alias("same"))


#: Names followed by other scripts: wide letters, a base with a mark, joined and coloured emoji, a flag.
stand_in("scripts", """select p_partkey, p_name, p_name || case p_partkey % 6 when 0 then '' when 1 then ' 中文한' when 2 then ' é ñ' when 3 then ' 👨‍👩‍👧' when 4 then ' 👍🏽!' else ' 🇳🇴🇫🇷' end as text from {part}""")


@query("f_width", ["scripts"], """select p_partkey, cast(length(p_name) + case p_partkey % 6 when 0 then 0 when 1 then 7 when 2 then 4 when 3 then 3 when 4 then 4 else 3 end as integer) as width,
 cast(length(p_name) + case p_partkey % 6 when 0 then 0 when 1 then 4 when 2 then 4 when 3 then 2 when 4 then 3 else 3 end as integer) as graphemes from scripts""")
def f_width(rows: DataFrame) -> DataFrame:
    from loomlake.functions.pandas_text import graphemes, width

    return rows.select("p_partkey", width("text").alias("width"), graphemes("text").alias("graphemes"))


#: Objects and lists with sensitive keys and secrets at several depths, a bare value, and a text that is no JSON.
stand_in("json_texts", """select event_id, case event_id % 5 when 0 then chr(123) || '"password": "x", "deep": [' || chr(123) || '"apiKey": "y", "Client-Secret": [1], "k": ' || cast(user_id as string) || chr(125) || ']' || chr(125)
    when 1 then '[' || chr(123) || '"note": "use bearer abcdef123456 now", "n": ' || cast(user_id as string) || ', "refresh_token": null' || chr(125) || ', "ghp_' || repeat('x1', 12) || '"]'
    when 2 then cast(user_id as string) when 3 then 'not json ' || cast(user_id as string) else chr(123) || '"monkey": 1, "keys": ' || cast(user_id as string) || ', "a": ' || chr(123) || '"b": [true, null, "é"]' || chr(125) || chr(125) end as text, user_id from {events}""")


@query("f_redact_json", ["json_texts"], """select event_id, case event_id % 5 when 0 then '{"password":"[REDACTED]","deep":[{"apiKey":"[REDACTED]","Client-Secret":"[REDACTED]","k":' || user_id || '}]}'
 when 1 then '[{"note":"use bearer [REDACTED] now","n":' || user_id || ',"refresh_token":"[REDACTED]"},"[REDACTED]"]' when 2 then cast(user_id as varchar) when 3 then text else '{"monkey":"[REDACTED]","keys":' || user_id || ',"a":{"b":[true,null,"é"]}}' end as j from json_texts""")
def f_redact_json(rows: DataFrame) -> DataFrame:
    from loomlake.functions.pandas_text import redact_json

    return rows.select("event_id", redact_json("text").alias("j"))


def _long(pages: DataFrame):
    return pages.select("page_id", F.concat(F.lit("see "), "url", F.lit("&"), F.repeat(F.lit("q"), 80), F.lit(". end")).alias("body"))


@query("f_urls_shorten", ["pages"], "select page_id, 'see link://' || substr(sha256(url || '&' || repeat('q', 80)), 1, 12) || '. end' as body from pages")
def f_urls_shorten(pages: DataFrame) -> DataFrame:
    from loomlake.functions.pandas_text import shorten_urls

    return _long(pages).select("page_id", shorten_urls("body").alias("body"))


@query("f_urls_expand", ["pages"], "select page_id, 'see ' || url || '&' || repeat('q', 80) || '. end' as body from pages")
def f_urls_expand(pages: DataFrame) -> DataFrame:
    from loomlake.functions.pandas_text import long_urls, shorten_urls

    rows = _long(pages).select("page_id", shorten_urls("body").alias("short"), F.explode(long_urls("body")).alias("url"))
    link = F.concat(F.lit("link://"), F.substring(F.sha2("url", 256), 1, 12))
    return rows.select("page_id", F.replace("short", link, F.col("url")).alias("body"))


@query("f_mixed_grams", ["part"], "with n as (select p_partkey, lower(p_name) as t from part) select p_partkey, cast(greatest(length(t) - 2, 0) as integer) as grams from n")
def f_mixed_grams(part: DataFrame) -> DataFrame:
    from loomlake.functions.pandas_text import mixed_grams

    return part.select("p_partkey", F.size(mixed_grams(F.lower("p_name"))).alias("grams"))


#: Signatures below a mark and without one, with and without a place, a time zone and an employer, under whole mails.
stand_in("signed", """select doc_id, body || chr(10) || case doc_id % 4 when 0 then 'Thanks' || chr(10) || '--' || chr(10) || 'Ada Byron' || chr(10) || 'Engineer, Example Ltd' || chr(10) || sender when 1 then '--' || chr(10) || 'Bob Q. Lee' || chr(10) || 'Product Manager at Acme' || chr(10) || 'Berlin, Germany' || chr(10) || 'UTC+2 office hours'
    when 2 then '--' || chr(10) || sender || chr(10) || 'Location: Oslo, Norway' else '--' || chr(10) || 'no facts here' end as body, sender from {mails}""")


@query("f_signature", ["signed"], """select doc_id, case when doc_id % 4 in (0, 2) then sender end as email, case doc_id % 4 when 0 then 'Ada Byron' when 1 then 'Bob Q. Lee' end as name, case doc_id % 4 when 0 then 'Engineer' when 1 then 'Product Manager' end as role,
 case doc_id % 4 when 0 then 'Example Ltd' when 1 then 'Acme' end as employer, case when doc_id % 4 = 1 then 'UTC+2' end as timezone, case doc_id % 4 when 1 then 'Berlin, Germany' when 2 then 'Oslo, Norway' end as location from signed""")
def f_signature(mails: DataFrame) -> DataFrame:
    from loomlake.functions.signature import facts

    return mails.select("doc_id", facts("body").alias("f")).select("doc_id", "f.*")


stand_in("tool_inputs", "select doc_id as id, case doc_id % 3 when 0 then 'shell' when 1 then 'search' else 'other' end as tool, case doc_id % 4 when 0 then 'git' else 'ls' end as argv0, text from {documents}")
RULES = [("git-status", "shell", "git", 1), ("shell-any", "shell", "", 1), ("search-hits", "search", "", 2)]


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, tool string, argv0 string, priority int")


@query("compact_classify", ["tool_inputs"], "select id, case when tool = 'shell' and argv0 = 'git' then 'git-status' when tool = 'shell' then 'git-status' when tool = 'search' then 'search-hits' else 'fallback' end as rule_id, (case when tool = 'other' then 0.2 else 0.9 end)::double as confidence from tool_inputs")
def compact_classify(rows: DataFrame) -> DataFrame:
    return compaction.classified(rows, _rules(rows.sparkSession))


@query("compact_output", ["tool_inputs"])
def compact_output(rows: DataFrame) -> DataFrame:
    inputs = rows.select("id", "text", F.lit("^\\s*$").alias("skip"), F.lit("").alias("keep"))
    return compaction.compacted(inputs).select("id", "raw_chars", F.length("text").alias("chars"), "compacted")


@query("f_graphemes", ["scripts"], "select p_partkey, cast(length(p_name) + case p_partkey % 6 when 0 then 0 when 1 then 4 when 2 then 4 when 3 then 2 when 4 then 3 else 3 end as integer) as n from scripts")
def f_graphemes(rows: DataFrame) -> DataFrame:
    from loomlake.functions.pandas_text import graphemes

    return rows.select("p_partkey", graphemes("text").alias("n"))
