"""Scalar functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.functions.scalars import with_one
from loomlake.functions import text as fn
from loomlake.operators import relations
from loomlake.plans.catalog import query, stand_in

stand_in("noisy_lines", """select doc_id, case doc_id % 6 when 0 then chr(27) || '[31mred' || chr(27) || '[0m ' || text when 1 then chr(10) || '  ' || chr(10) || 'a' || chr(10) || 'a' || chr(10) || 'b  ' || chr(10) || text || chr(10) || chr(10)
    when 2 then 'x' || chr(13) || chr(10) || 'y' || chr(13) || chr(10) || 'y' || chr(13) || chr(10) || text when 3 then chr(27) || ']0;title' || chr(7) || text || chr(27) || ']8;;http://x' || chr(27) || chr(92) || 'link' || chr(27) || ']2;never ends'
    when 4 then chr(27) || 'M' || text || chr(27) || '[1m' || chr(27) || chr(10) || chr(27) || '[12;4' else text end as text from {documents}""")
stand_in("words_list", "select event_id, case event_id % 6 when 0 then 'box' when 1 then 'city' when 2 then 'day' when 3 then 'match' when 4 then 'file' else 'bus' end as word, event_id % 3 as n from {events}")
stand_in("stamps", """select o_orderkey, case o_orderkey % 4 when 0 then '2024-03-0' || cast(1 + o_custkey % 9 as string) || 'T10:11:12' when 1 then '2023-12-1' || cast(o_custkey % 10 as string) || ' 08:00:01'
    when 2 then '2022-07-2' || cast(o_custkey % 9 as string) else 'not a date' end as stamp, o_orderdate as ts, o_orderpriority as label from {orders}""")
stand_in("handles", """select c_custkey, case c_custkey % 4 when 0 then 'email' when 1 then 'url' when 2 then 'handle' else 'hashtag' end as kind,
    case c_custkey % 4 when 0 then ' Ada' || cast(c_custkey as string) || '@Mail.COM ' when 1 then 'https://Ex.org/A' || cast(c_custkey as string) when 2 then '@Bob  Lee' when 3 then '#Topic' else '' end as value from {customer}""")

WS = "trim(regexp_replace({0}, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g'))"


@query("f_tokens", ["documents"], "select doc_id, cast(floor((length(text) + 3) / 4) as bigint) as tokens from documents")
def f_tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", fn.tokens_by_chars("text").alias("tokens"))


@query("f_tokens_b", ["documents"], "select doc_id, cast(ceil(strlen(text) / 4) as bigint) as tokens from documents")
def f_tokens_b(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", fn.tokens_by_bytes("text").alias("tokens"))


@query("f_collapse_ws", ["documents"], f"select doc_id, md5({WS.format('text')}) as h from documents")
def f_collapse_ws(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5(fn.collapse_ws("text")).alias("h"))


@query("f_norm_search", ["sentences"], r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[_\-/.]', ' ', 'g'), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) as norm from sentences""")
def f_norm_search(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", fn.norm_search("text").alias("norm"))


@query("f_norm_pred", ["triples"], "select distinct predicate, upper(regexp_replace(regexp_replace(predicate, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) as norm from triples")
def f_norm_pred(triples: DataFrame) -> DataFrame:
    return triples.select("predicate", fn.norm_predicate("predicate").alias("norm")).distinct()


@query("f_norm_ent", ["triples"], "select distinct subject, upper(trim(regexp_replace(subject, '\\s+', ' ', 'g'))) as norm from triples")
def f_norm_ent(triples: DataFrame) -> DataFrame:
    return triples.select("subject", fn.norm_entity("subject").alias("norm")).distinct()


@query("f_ns", ["part"], "select p_partkey, case when trim(p_name) = '' then 'global' else regexp_replace(trim(p_name), '[^A-Za-z0-9_/-]', '_', 'g') end as ns from part")
def f_ns(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", fn.namespace("p_name").alias("ns"))


@query("f_slug", ["part"], """select p_partkey, substr(regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120) as slug,
 array_to_string(list_transform(string_split(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '-') as tag from part""")
def f_slug(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", fn.slug(F.concat("p_brand", F.lit(" "), "p_name")).alias("slug"), fn.tag_value("p_name").alias("tag"))


@query("f_ngrams", ["part"], "with n as (select p_partkey, lower(p_name) as t from part) select p_partkey, substr(t, cast(i as integer), 3) as gram, count(*) as n from n, unnest(range(1, greatest(length(t) - 1, 1))) u(i) group by 1, 2")
def f_ngrams(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", F.explode(fn.ngrams(F.lower("p_name"))).alias("gram")).groupBy("p_partkey", "gram").agg(F.count("*").alias("n"))


@query("f_sanitize_fts", ["sentences"], """select doc_id, array_to_string(list_transform(list_filter(list_slice(string_split(trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' '), 1, 8), lambda w: w <> ''), lambda w: '"' || w || '"'), ' ') as q from sentences""")
def f_sanitize_fts(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", fn.sanitize_fts("text").alias("q"))


@query("f_recency", ["usage"], "with m as (select max(sec) as now from usage) select id, round(least(greatest(1 / (1 + (now - sec) / 3600.0 / 24), 0), 1), 6) as recency from usage, m")
def f_recency(usage: DataFrame) -> DataFrame:
    now = usage.agg(F.max("sec").alias("now"))  # one row
    return usage.select("id", "sec").transform(with_one, now).select("id", F.round(fn.recency((F.col("now") - F.col("sec")) / 3600.0), 6).alias("recency"))


@query("f_recency_piecewise", ["usage"], """with m as (select max(sec) as now from usage), d as (select id, (now - sec) / 86400.0 as d from usage, m)
 select id, round(case when d <= 0 then 1 when d <= 7 then 1 - d / 14 when d < 30 then 0.5 * (30 - d) / 23 else 0 end, 6) as recency from d""")
def f_recency_piecewise(usage: DataFrame) -> DataFrame:
    now = usage.agg(F.max("sec").alias("now"))  # one row
    return usage.select("id", "sec").transform(with_one, now).select("id", F.round(fn.recency_piecewise((F.col("now") - F.col("sec")) / 86_400.0), 6).alias("recency"))


@query("f_trunc_body", ["documents"], "select doc_id, case when length(text) > 300 then substr(text, 1, 299) || '…' else text end as body from documents")
def f_trunc_body(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", fn.truncated("text", 300).alias("body"))


@query("f_md_escape", ["sentences"], r"""select doc_id, regexp_replace(text, '([\\`*_\[\]#|])', '\\\1', 'g') as body from sentences""")
def f_md_escape(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", fn.md_escape("text").alias("body"))


@query("f_extract_email", ["handles"], """select c_custkey, lower(trim(case when c_custkey % 2 = 0 then value else 'x@' || cast(c_custkey as varchar) || '.org' end)) as email from handles""")
def f_extract_email(rows: DataFrame) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 2 == 0, F.col("value")).otherwise(F.concat(F.lit("Bob <x@"), "c_custkey", F.lit(".ORG>")))
    return rows.select("c_custkey", fn.bracket_email(raw).alias("email"))


@query("f_strip_ansi", ["noisy_lines"], r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)', '', 'g'),
 '\x1b\[[0-?]*[ -/]*[@-~]', '', 'g'), '\x1b\][^\x07\x1b]*\z', '', 'g'), '\x1b\[[0-?]*[ -/]*\z', '', 'g'), '\x1b[@-_]', '', 'g'), '\x1b', '', 'g')) as h from noisy_lines""")
def f_strip_ansi(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.md5(fn.strip_ansi("text")).alias("h"))


@query("f_trim_edges", ["noisy_lines"], """with l as (select doc_id, string_split(text, chr(10)) as a from noisy_lines), f as (select doc_id, a, list_filter(range(1, len(a) + 1), lambda i: trim(a[i]) <> '') as w from l)
 select doc_id, case when len(w) = 0 then '' else array_to_string(list_slice(a, w[1], w[len(w)]), chr(10)) end as body from f""")
def f_trim_edges(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.array_join(fn.trim_edges(F.split("text", "\n")), "\n").alias("body"))


@query("f_norm_lines", ["noisy_lines"], r"select doc_id, md5(array_to_string(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda s: rtrim(s, ' ')), chr(10))) as h from noisy_lines")
def f_norm_lines(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.md5(F.array_join(fn.norm_lines("text"), "\n")).alias("h"))


@query("f_head_tail", ["documents"], """with l as (select doc_id, string_split(text, chr(10)) as a from documents)
 select doc_id, md5(array_to_string(case when len(a) <= 5 then a else list_concat(list_concat(list_slice(a, 1, 3), ['... ' || cast(len(a) - 5 as varchar) || ' lines omitted ...']), list_slice(a, len(a) - 1, len(a))) end, chr(10))) as h from l""")
def f_head_tail(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5(F.array_join(fn.head_tail(F.split("text", "\n"), 3, 2), "\n")).alias("h"))


@query("dedupe_adjacent", ["noisy_lines"], """with l as (select doc_id, string_split(text, chr(10)) as a from noisy_lines)
 select doc_id, cast(len(list_filter(range(1, len(a) + 1), lambda i: i = 1 or a[i] <> a[i - 1])) as integer) as kept, md5(array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: i = 1 or a[i] <> a[i - 1]), lambda i: a[i]), chr(10))) as h from l""")
def dedupe_adjacent(rows: DataFrame) -> DataFrame:
    lines = rows.select("doc_id", F.split("text", "\n").alias("lines"))
    kept = lines.select("doc_id", fn.dedupe_adjacent(F.col("lines")).alias("kept"))
    return kept.select("doc_id", F.size("kept").alias("kept"), F.md5(F.array_join("kept", "\n")).alias("h"))


@query("f_clamp", ["documents"], """with c as (select doc_id, text, substr(text, 1, 500) as cut from documents), p as (select *, length(cut) - instr(reverse(cut), chr(10)) as pos, instr(reverse(cut), chr(10)) as br from c)
 select doc_id, md5(case when length(text) <= 500 then text else case when br > 0 and pos >= 250 then substr(cut, 1, pos) else cut end || chr(10) || '… truncated …' end) as h from p""")
def f_clamp(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5(fn.clamp("text", 500)).alias("h"))


@query("f_clamp_middle", ["documents"], "select doc_id, md5(case when length(text) <= 1000 then text else substr(text, 1, 700) || chr(10) || '… omitted …' || chr(10) || right(text, 300) end) as h from documents")
def f_clamp_middle(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5(fn.clamp_middle("text", 1000)).alias("h"))


@query("f_pluralize", ["words_list"], """select word, n, case when n = 1 then word when regexp_matches(word, '(s|x|z|ch|sh)$') then word || 'es' when regexp_matches(word, '[^aeiou]y$') then regexp_replace(word, 'y$', '') || 'ies' else word || 's' end as plural, count(*) as uses from words_list group by 1, 2""")
def f_pluralize(rows: DataFrame) -> DataFrame:
    return rows.groupBy("word", "n").agg(F.count("*").alias("uses")).select("word", "n", fn.pluralize("word", "n").alias("plural"), "uses")


def _replaced(sql: str, forms) -> str:
    """SQL that replaces each (pattern, mark) in turn."""
    for pattern, mark in forms:
        sql = f"regexp_replace({sql}, '{pattern.replace(chr(39), chr(39) * 2)}', '{mark.replace('$1', chr(92) + '1')}', 'g')"
    return sql


SECRETS = [*((p, fn.REDACTED) for p in fn.SECRET_BLOCKS), *fn.SECRET_FORMS]


@query("f_redact_secrets", ["leaks"], f"select doc_id, md5({_replaced('text', SECRETS)}) as h, contains({_replaced('text', SECRETS)}, '[REDACTED]') as found from leaks")
def f_redact_secrets(rows: DataFrame) -> DataFrame:
    made = rows.select("doc_id", fn.redact_secrets("text").alias("body"))
    return made.select("doc_id", F.md5("body").alias("h"), F.contains("body", F.lit("[REDACTED]")).alias("found"))


@query("f_sanitize", ["documents"])
def f_sanitize(docs: DataFrame) -> DataFrame:
    """Secrets, then personal data, with counts a class."""
    made = docs.select("doc_id", fn.sanitized("text").alias("s"))
    return made.select("doc_id", F.md5("s.text").alias("h"), *(f"s.{k}" for k in fn.SANITIZED))


@query("f_pii", ["documents"], r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', '[EMAIL]', 'g'), '\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b', '[IP]', 'g'),
 '\+[0-9][ ().0-9-]{7,}[0-9]', '[PHONE]', 'g'), '\b[0-9]{13,19}\b', '[CARD]', 'g')) as h from documents""")
def f_pii(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5(fn.redact_personal("text")).alias("h"))


@query("f_redact_log", ["pages"], "select page_id, substr(sha256(url), 1, 8) as digest, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as endpoint from pages")
def f_redact_log(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", fn.log_digest("url").alias("digest"), F.try_parse_url("url", F.lit("HOST")).alias("endpoint"))


@query("f_events_heuristic", ["sentences"], """with s as (select distinct doc_id, trim(x) as sentence from sentences, unnest(regexp_split_to_array(text, '[.!?\\n]')) u(x)), p as (select *, lower(sentence) as l from s where strlen(sentence) > 5)
 select doc_id, sentence, case when regexp_matches(l, '{d}') then 'decision' when regexp_matches(l, '{c}') then 'commitment' when regexp_matches(l, '{p}') then 'preference' else 'fact' end as kind from p where regexp_matches(l, '{d}|{c}|{p}|{f}')""".replace("{d}", "|".join(fn.EVENT_PHRASES["decision"]).replace("'", "''")).replace("{c}", "|".join(fn.EVENT_PHRASES["commitment"]).replace("'", "''")).replace("{p}", "|".join(fn.EVENT_PHRASES["preference"]).replace("'", "''")).replace("{f}", "|".join(fn.EVENT_PHRASES["fact"]).replace("'", "''")))
def f_events_heuristic(rows: DataFrame) -> DataFrame:
    parts = rows.select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "[.!?\n]"), lambda s: F.trim(s)))).alias("sentence"))
    return parts.where(F.octet_length("sentence") > 5).select("doc_id", "sentence", fn.event_kind("sentence").alias("kind")).where("kind is not null")


def _quoted(phrases) -> str:
    return "|".join(phrases).replace("'", "''")


@query("f_candidates", ["sentences"], f"""with p as (select doc_id, text, lower(text) as l, doc_id % 2 = 0 as u from sentences where length(trim(text)) >= 20 and regexp_replace(lower(trim(text)), '[.!?]+$', '') not in ({', '.join(repr(x) for x in fn.FILLERS)}))
 select doc_id, substr(text, 1, 400) as snippet, case when u and regexp_matches(l, '{_quoted(fn.CANDIDATE_PHRASES["preference"])}') then 'preference' when u and regexp_matches(l, '{_quoted(fn.CANDIDATE_PHRASES["commitment"])}') then 'commitment'
 when regexp_matches(l, '{_quoted(fn.CANDIDATE_PHRASES["decision"])}') then 'decision' else 'unresolved' end as kind from p
 where (u and regexp_matches(l, '{_quoted(fn.CANDIDATE_PHRASES["preference"] + fn.CANDIDATE_PHRASES["commitment"])}')) or regexp_matches(l, '{_quoted(fn.CANDIDATE_PHRASES["decision"] + fn.CANDIDATE_PHRASES["unresolved"])}')""")
def f_candidates(rows: DataFrame) -> DataFrame:
    kind = fn.candidate_kind("text", F.col("doc_id") % 2 == 0).alias("kind")
    return rows.where(~fn.is_filler("text")).select("doc_id", F.substring("text", 1, 400).alias("snippet"), kind).where("kind is not null")


@query("f_reflections", ["sentences"], f"""with r as (select source, doc_id from sentences where regexp_matches(lower(text), '{_quoted(fn.REFLECTION_PHRASES)}')),
 p as (select source, count(*) as n from sentences where lower(text) like '%i prefer%' group by 1)
 select source, count(*) as n, 'reflection' as kind from r group by 1 union all select source, n, 'recurring' from p where n >= 3""")
def f_reflections(rows: DataFrame) -> DataFrame:
    found = rows.where(fn.has_any(F.lower("text"), fn.REFLECTION_PHRASES)).groupBy("source").agg(F.count("*").alias("n"), F.lit("reflection").alias("kind"))
    often = rows.where(F.lower("text").contains("i prefer")).groupBy("source").agg(F.count("*").alias("n"), F.lit("recurring").alias("kind")).where("n >= 3")
    return found.union(often)


def _hit(texts: str, phrases) -> str:
    return " or ".join(f"contains({t}, '{p}')" for t in texts.split() for p in phrases)


@query("f_injection", ["sentences"], f"""with t as (select doc_id, lower(text) as l, translate(lower(text), '{''.join(fn.ALIKE | fn.WIDE).replace("'", "''")}{fn.INVISIBLE}', '{''.join((fn.ALIKE | fn.WIDE).values()).replace("'", "''")}') as c from sentences),
 d as (select doc_id, l, trim(regexp_replace(regexp_replace(c, '[^A-Za-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as p from t), e as (select *, replace(p, ' ', '') as q from d),
 s as (select doc_id, case when {_hit('p', fn.OVERRIDES)} or {_hit('q', [x.replace(' ', '') for x in fn.OVERRIDES])} then {fn.OVERRIDE_WEIGHT} else 0 end + case when {_hit('p', fn.TARGETS)} or (contains(p, 'reveal') and ({_hit('p', fn.HINTS)})) then {fn.TARGET_WEIGHT} else 0 end + """
 + " + ".join(f"case when regexp_matches(l, '{p}') or regexp_matches(p, '{p}') or regexp_matches(q, '{p}') then {w} else 0 end" for w, p in fn.ATTACKS) + """ as s from e)
 select doc_id, round(cast(least(s, 1) as double), 6) as score, case when s >= 0.7 then 'block' when s >= 0.55 then 'review' else 'allow' end as verdict from s""")
def f_injection(rows: DataFrame) -> DataFrame:
    scored = rows.select("doc_id", fn.attack_score("text").alias("score"))
    return scored.select("doc_id", "score", fn.verdict(F.col("score")).alias("verdict"))


@query("f_canonical_id", ["handles"], "select c_custkey, kind || ':' || case when kind = 'url' then trim(value) else regexp_replace(lower(trim(value)), '^[@#]+', '') end as canonical from handles")
def f_canonical_id(rows: DataFrame) -> DataFrame:
    return rows.select("c_custkey", fn.canonical_id("kind", "value").alias("canonical"))


@query("f_canonical_handle", ["handles"], "select c_custkey, case when kind = 'email' then lower(trim(value)) else trim(regexp_replace(value, '\\s+', ' ', 'g')) end as handle from handles")
def f_canonical_handle(rows: DataFrame) -> DataFrame:
    return rows.select("c_custkey", fn.canonical_handle("kind", "value").alias("handle"))


ENTITIES = """with e as (select doc_id, 'email' as kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) as surface from sentences
 union all select doc_id, 'url', unnest(regexp_extract_all(text, 'https?://[^\\s<>"'')]+')) from sentences union all select doc_id, 'handle', unnest(regexp_extract_all(text, '(?:^|[\\s(])(@[A-Za-z0-9_][A-Za-z0-9_.\\-]+)', 1)) from sentences
 union all select doc_id, 'handle', unnest(regexp_extract_all(text, '\\b[A-Za-z0-9_.\\-]{2,32}#[0-9]{4}\\b')) from sentences
 union all select doc_id, 'hashtag', unnest(regexp_extract_all(text, '(?:^|[\\s(])(#[A-Za-z][A-Za-z0-9_\\-]*)', 1)) from sentences) """


@query("f_extract_entities", ["sentences"], ENTITIES + "select doc_id, kind, surface, count(*) as n from e group by 1, 2, 3")
def f_extract_entities(rows: DataFrame) -> DataFrame:
    found = rows.select("doc_id", F.explode(fn.entities("text")).alias("e"))
    return found.groupBy("doc_id", "e.kind", "e.surface").agg(F.count("*").alias("n"))


@query("f_entity_spans", ["documents"])
def f_entity_spans(docs: DataFrame) -> DataFrame:
    """Entities and topics with their spans."""
    from loomlake.functions.pandas_text import entity_spans

    return docs.select("doc_id", F.explode(entity_spans("text")).alias("e")).select("doc_id", "e.*")


@query("f_date_parse", ["stamps"], "select o_orderkey, coalesce(try_strptime(stamp, '%Y-%m-%dT%H:%M:%S'), try_strptime(stamp, '%Y-%m-%d %H:%M:%S'), try_strptime(stamp, '%Y-%m-%d')) as ts from stamps")
def f_date_parse(rows: DataFrame) -> DataFrame:
    return rows.select("o_orderkey", fn.parsed_time("stamp").cast("timestamp_ntz").alias("ts"))


@query("f_tree_ids", ["stamps"], """select o_orderkey, strftime(ts, '%Y/%m/%d/%H') as hour, strftime(ts, '%Y/%m/%d') as day, strftime(ts, '%Y/%m') as month, strftime(ts, '%Y') as year, strftime(ts, '%Y/%m/%d') as hour_parent, 4 as hour_level from stamps""")
def f_tree_ids(rows: DataFrame) -> DataFrame:
    ids = rows.select("o_orderkey", *(c.alias(k) for k, c in fn.tree_ids(F.col("ts")).items()))
    depth = (F.length("hour") - F.length(F.replace("hour", F.lit("/"), F.lit(""))) + 1).alias("hour_level")
    return ids.select("*", F.substring_index("hour", "/", 3).alias("hour_parent"), depth)


@query("f_json_get", ["events"], "select event_id, coalesce(nullif(json_extract_string(props, '$.missing'), ''), json_extract_string(props, '$.k')) as v from events")
def f_json_get(events: DataFrame) -> DataFrame:
    return events.select("event_id", fn.first_of("props", "missing", "k").alias("v"))


@query("f_budget_trunc", ["documents"], "select doc_id, md5(case when strlen(text) > 1000 then substr(text, 1, 800) || ' [truncated]' else text end) as h from documents")
def f_budget_trunc(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5(fn.budget_truncated("text", 1000, 800)).alias("h"))


@query("f_signature_fmt", ["vectors"], "select distinct 'local/hash/' || cast(dim as varchar) as signature from vectors")
def f_signature_fmt(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.format_string("%s/%s/%d", F.lit("local"), F.lit("hash"), F.col("dim")).alias("signature")).distinct()


@query("low_quality", ["sentences"], "select doc_id, strlen(lower(trim(text))) < 5 or regexp_matches(lower(trim(text)), '^(i can''t|i cannot|i''m sorry|as an ai|i am unable)') as low from sentences")
def low_quality(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", fn.low_quality("text").alias("low"))


FOLDS = "strip_accents(lower(text))"
for _letter, _plain in fn.FOLDED.items():
    FOLDS = f"replace({FOLDS}, '{_letter}', '{_plain}')"


@query("f_normalize", ["documents"], f"select doc_id, md5({FOLDS}) as h from documents")
def f_normalize(docs: DataFrame) -> DataFrame:
    from loomlake.functions.pandas_text import normalize

    return docs.select("doc_id", F.md5(normalize("text")).alias("h"))


def _type(name: str) -> str:
    """SQL for the type of a name in column name, its upper case in up_name, its person in person_name."""
    marks = " ".join(f"when regexp_matches(up_{name}, '{'|'.join(m)}') then '{kind}'" for kind, m in fn.TYPE_MARKS)
    return (
        f"case when regexp_matches({name}, '{fn.DATE}') then 'DATE' when contains(up_{name}, '@') then 'ORGANIZATION' when person_{name} is not null or regexp_matches({name}, '{fn.PERSON_NAME}') then 'PERSON' {marks} "
        f"when ends_with(up_{name}, 'CORE') then 'ORGANIZATION' when regexp_matches(up_{name}, '[-_]') and not contains(up_{name}, ' ') then 'PROJECT' else 'TOPIC' end"
    )


def _clean(x: str) -> str:
    edge = r"[\s\-:;,.\"\'()]+".replace("\\'", "''").replace('\\"', '"')
    return f"upper(trim(regexp_replace(regexp_replace({x}, '^{edge}|{edge}$', '', 'g'), '\\s+', ' ', 'g')))"


def _facts_sql() -> str:
    parts = []
    for form, subject, predicate, object_ in fn.FACT_FORMS:
        name = f"regexp_extract(c, '{form}', {predicate})" if isinstance(predicate, int) else f"regexp_extract(c, '{form}', 2) || '_of'" if "{}" in predicate else f"'{predicate}'"
        parts.append(f"select doc_id, regexp_extract(c, '{form}', {subject}) as subject, upper({name}) as predicate, regexp_replace(regexp_extract(c, '{form}', {object_}), '[:;,.\\s]+$', '') as object from l where regexp_matches(c, '{form}')")
    return " union all ".join(parts)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


RELATIONS = f"""with l as (select doc_id, i as pos, lines[i] as line, trim(regexp_replace(lines[i], '^\\s*-+\\s*', '')) as c from (select doc_id, string_split(text, chr(10)) as lines from fact_lines) x, unnest(range(1, len(lines) + 1)) u(i)),
 h as (select doc_id, pos, regexp_extract_all(regexp_extract(line, '{fn.HEADER}', 1), '{fn.NAMED_ADDRESS}', 1) as names from l where regexp_matches(line, '{fn.HEADER}')),
 n as (select doc_id, pos * 1000 + j as place, {_clean('names[j]')} as person from h, unnest(range(1, len(names) + 1)) v(j)),
 a as (select doc_id, alias, arg_min(person, place) as person from (select doc_id, place, person, person as alias from n union all select doc_id, place, person, split_part(person, ' ', 1) from n) y where person <> '' group by 1, 2),
 f as ({_facts_sql()}), g as (select f.*, {_clean('subject')} as up_subject, {_clean('object')} as up_object from f),
 k as (select g.*, s.person as person_subject, o.person as person_object from g left join a s on s.doc_id = g.doc_id and s.alias = up_subject left join a o on o.doc_id = g.doc_id and o.alias = up_object),
 t as (select *, {_type('subject')} as subject_type, {_type('object')} as object_type from k),
 r(predicate, canonical, heads, tails) as (values {', '.join(f"('{p}', '{c}', {_list(h)}, {_list(t)})" for p, (c, h, t) in fn.RELATIONS.items())}),
 z as (select doc_id, case when subject_type = 'PERSON' then coalesce(person_subject, up_subject) else up_subject end as subject, subject_type, canonical as predicate, case when object_type = 'PERSON' then coalesce(person_object, up_object) else up_object end as object, object_type
 from t join r using (predicate) where list_contains(heads, subject_type) and list_contains(tails, object_type))
 select * from z where subject <> '' and object <> '' and subject <> object"""


@query("f_relations", ["fact_lines"], RELATIONS)
def f_relations(docs: DataFrame) -> DataFrame:
    return relations.relations(docs)
