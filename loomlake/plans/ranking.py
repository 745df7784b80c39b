"""Ranking, window-like and paging queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomlake.functions.scalars import with_one
from loomlake.operators import ranking as op
from loomlake.operators import tables
from loomlake.plans.catalog import query, stand_in

stand_in("turns", "select user_id as session_id, event_id as turn, @sec(ts) as sec, floor(value * 10) + 1 as user_len, event_id % 37 + 1 as agent_len, event_type as key, props as value from {events}")
stand_in("tools", "select p_partkey as tool_id, p_name || ' ' || lower(p_type) as words, case p_partkey % 3 when 0 then 'get' when 1 then 'list' else 'make' end as verb from {part}")
stand_in("experiences", """select o_orderkey as id, 'agent' || cast(o_custkey % 3 as string) as agent, lower(o_orderpriority) || ' ' || lower(o_orderstatus) as tags, case o_custkey % 4 when 0 then 'search read' when 1 then 'write' else 'read' end as tools,
    o_custkey % 100 / 100.0 as confidence, @sec(o_orderdate) as updated, o_custkey % 10 = 0 as dismissed from {orders}""")


@query("topk_sort", ["orders"], "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def topk_sort(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("topk_per_group", ["summaries"], "select tree_id, id, level from (select *, row_number() over (partition by tree_id order by level desc, sealed_at desc, id desc) as rn from summaries) where rn = 1")
def topk_per_group(summaries: DataFrame) -> DataFrame:
    top = summaries.groupBy("tree_id").agg(F.max(F.struct("level", "sealed_at", "id")).alias("x"))
    return top.select("tree_id", "x.id", "x.level")


@query("first_last_per_session", ["turns"], "select session_id, min(turn) as first_turn, max(turn) as last_turn, arg_max(key, turn) as last_key from turns group by 1")
def first_last_per_session(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.max_by("key", "turn").alias("last_key"))


@query("lag_gap", ["turns"], "select session_id, turn, sec - p as gap from (select *, lag(sec) over (partition by session_id order by turn) as p from turns) where sec - p > 600")
def lag_gap(turns: DataFrame) -> DataFrame:
    before = F.lag("sec").over(Window.partitionBy("session_id").orderBy("turn"))
    return turns.select("session_id", "turn", (F.col("sec") - before).alias("gap")).where("gap > 600")


@query("rolling_ratio", ["turns"], """with r as (select session_id, turn, row_number() over w as n, avg(user_len / agent_len) over (partition by session_id order by turn rows between 14 preceding and current row) as now,
 avg(user_len / agent_len) over (partition by session_id order by turn rows between 29 preceding and 15 preceding) as before from turns window w as (partition by session_id order by turn)),
 c as (select *, case when now / before < 0.3 then 'terse' when now / before < 0.5 then 'short' when now / before < 0.8 then 'brief' else null end as value from r where n >= 30)
 select session_id, value, min(turn) as turn from c where value is not null group by 1, 2""")
def rolling_ratio(turns: DataFrame) -> DataFrame:
    return op.rolling_shift(turns)


stand_in("edits", """select user_id as session_id, event_id as turn, event_id * 2 as sec, case when event_type in ('view', 'click') then 'assistant' else 'user' end as role,
    case event_id % 5 when 0 then 'Make it shorter, it is too long' when 1 then 'say less please' when 2 then 'just code and more detail' when 3 then 'thanks' else 'More verbose, not bullets' end as body from {events}""")
EDITS = """with recursive p as (select *, max(case when role = 'assistant' then turn end) over (partition by session_id order by turn rows between unbounded preceding and 1 preceding) as answer from edits),
 g as (select p.session_id, p.turn, p.sec, lower(p.body) as l from p join edits a on a.session_id = p.session_id and a.turn = p.answer where p.role = 'user' and p.sec - a.sec >= 0 and p.sec - a.sec < 30),
 c(i, pattern, key, value) as (values {values}), h as (select session_id, turn, sec, i, key, value, row_number() over (partition by session_id, key, value order by turn, i) as rn from g join c on contains(l, pattern)),
 f as (select session_id, turn, sec, key, value, rn, sec as held, true as told from h where rn = 1 union all
 select h.session_id, h.turn, h.sec, h.key, h.value, h.rn, case when h.sec - f.held >= 300 then h.sec else f.held end, h.sec - f.held >= 300 from f join h on h.session_id = f.session_id and h.key = f.key and h.value = f.value and h.rn = f.rn + 1)
 select session_id, turn, 'style' as class, key, value from f where told union all select session_id, turn, 'veto', key, value from f where rn = 3"""


@query("edit_cooldown", ["edits"], EDITS.replace("{values}", ", ".join(f"({i}, '{p}', '{k}', '{v}')" for i, (p, k, v) in enumerate(op.CORRECTIONS))))
def edit_cooldown(turns: DataFrame) -> DataFrame:
    return op.corrections(turns)


@query("reflection_cap", ["turns"], "select session_id, turn from (select *, row_number() over (partition by session_id order by turn) as rn from turns) where rn <= 20")
def reflection_cap(turns: DataFrame) -> DataFrame:
    return tables.newest(turns, ["session_id"], 20, [F.asc("turn")]).select("session_id", "turn")


@query("keep_recent_N", ["turns"], """with r as (select *, row_number() over (partition by session_id order by turn desc) as rn from turns)
 select session_id, count(*) as entries, count(*) filter (rn > 5) as cleared, cast(coalesce(sum(strlen(value)) filter (rn > 5), 0) as bigint) as freed from r group by 1""")
def keep_recent_n(turns: DataFrame) -> DataFrame:
    ranked = turns.withColumn("rn", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn"))))
    old = F.col("rn") > 5
    return ranked.groupBy("session_id").agg(F.count("*").alias("entries"), F.count_if(old).alias("cleared"), F.coalesce(F.sum(F.when(old, F.octet_length("value"))), F.lit(0)).alias("freed"))


@query("ring_buffer", ["turns"], "select session_id, turn from (select *, row_number() over (partition by session_id order by turn desc) as rn from turns) where rn <= 64")
def ring_buffer(turns: DataFrame) -> DataFrame:
    return tables.newest(turns, ["session_id"], 64, [F.desc("turn")]).select("session_id", "turn")


@query("tool_rank", ["tools"], """with s as (select tool_id, len(list_intersect(list_distinct(string_split(words, ' ')), ['red', 'ring', 'small', 'economy'])) + case when words like '%red%' then 1 else 0 end as score from tools where verb = 'get')
 select tool_id, cast(score as bigint) as score from s where score > 0 order by score desc, tool_id limit 20""")
def tool_rank(tools: DataFrame) -> DataFrame:
    return op.tool_rank(tools, "get", ["red", "ring", "small", "economy"], "red", 20)


@query("experience_rank", ["experiences"], """with s as (select id, updated, 0.2 * confidence + case when len(list_intersect(string_split(tools, ' '), ['read', 'search'])) > 0 then 3 + 0.5 * len(list_intersect(string_split(tools, ' '), ['read', 'search'])) else 0 end
 + case when len(list_intersect(string_split(tags, ' '), ['1-urgent', 'f'])) > 0 then 2 + 0.25 * len(list_intersect(string_split(tags, ' '), ['1-urgent', 'f'])) else 0 end + case when agent = 'agent1' then 1 else 0 end as score from experiences where not dismissed)
 select id, round(cast(score as double), 6) as score from s order by round(cast(score as double), 6) desc, updated desc, id limit 30""")
def experience_rank(rows: DataFrame) -> DataFrame:
    return op.experience_rank(rows.where("not dismissed"), ["read", "search"], ["1-urgent", "f"], "agent1", 30)


@query("rule_rank", ["jobs"], """with r as (select * from jobs where enabled order by job_key desc, next_run desc, job_id limit 30) select name, count(*) as n, min(job_id) as first_id from r group by name""")
def rule_rank(jobs: DataFrame) -> DataFrame:
    top = jobs.where("enabled").orderBy(F.desc("job_key"), F.desc("next_run"), "job_id").limit(30)
    return top.groupBy("name").agg(F.count("*").alias("n"), F.min("job_id").alias("first_id"))


@query("page", ["orders"], "select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 20 offset 40")
def page(orders: DataFrame) -> DataFrame:
    return orders.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey")


@query("query_response", ["orders"], "with h as (select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'), t as (select count(*) as total from h) select o_orderkey, total, total > 10 as truncated from h, t order by o_totalprice desc, o_orderkey limit 10")
def query_response(orders: DataFrame) -> DataFrame:
    hits = orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return op.response(hits, [F.desc("o_totalprice"), F.asc("o_orderkey")], 10).select("o_orderkey", "total", "truncated")


# small logs


@query("notif_stats", ["notifications"], """select 'all' as what, count(*) as n, count(*) filter (not is_read) as unread, count(*) filter (score is null) as unscored from notifications
 union all select 'provider:' || provider, count(*), count(*) filter (not is_read), count(*) filter (score is null) from notifications group by provider
 union all select 'action:' || action, count(*), count(*) filter (not is_read), count(*) filter (score is null) from notifications group by action""")
def notif_stats(rows: DataFrame) -> DataFrame:
    kinds = F.array(F.lit("all"), F.concat(F.lit("provider:"), "provider"), F.concat(F.lit("action:"), "action"))
    by = rows.groupBy("provider", "action").agg(F.count("*").alias("n"), F.count_if(~F.col("is_read")).alias("unread"), F.count_if(F.col("score").isNull()).alias("unscored"))
    return by.withColumn("what", F.explode(kinds)).groupBy("what").agg(*(F.sum(c).alias(c) for c in ("n", "unread", "unscored")))


@query("notif_list", ["notifications"], "select id, provider, score from notifications where provider = 'prov1' and score >= 5 order by sec desc, id desc limit 50 offset 5")
def notif_list(rows: DataFrame) -> DataFrame:
    return rows.where("provider = 'prov1' and score >= 5").orderBy(F.desc("sec"), F.desc("id")).offset(5).limit(50).select("id", "provider", "score")


@query("repeat_failures", ["tool_calls"], "select turn_id, tool, count(*) as n, substr(arg_min(message, seq), 1, 240) as sample from tool_calls where not ok group by 1, 2 having count(*) >= 2")
def repeat_failures(calls: DataFrame) -> DataFrame:
    by = calls.where("not ok").groupBy("turn_id", "tool").agg(F.count("*").alias("n"), F.substring(F.min_by("message", "seq"), 1, 240).alias("sample"))
    return by.where("n >= 2")


@query("turn_outcome", ["tool_calls"], """with a as (select turn_id, min(seq) filter (not ok) as f, max(seq) filter (ok) as s, count(*) filter (not ok) as nf, count(distinct tool) filter (ok) as t from tool_calls group by 1)
 select turn_id, case when nf = 0 and t >= 2 then 'multi_tool_success' when f < s then 'partial' when nf >= 2 then 'repeated_failure' else 'other' end as outcome from a""")
def turn_outcome(calls: DataFrame) -> DataFrame:
    by = calls.groupBy("turn_id").agg(
        F.min(F.when(~F.col("ok"), F.col("seq"))).alias("f"), F.max(F.when(F.col("ok"), F.col("seq"))).alias("s"), F.count_if(~F.col("ok")).alias("nf"), F.countDistinct(F.when(F.col("ok"), F.col("tool"))).alias("t")
    )
    outcome = F.when((F.col("nf") == 0) & (F.col("t") >= 2), "multi_tool_success").when(F.col("f") < F.col("s"), "partial").when(F.col("nf") >= 2, "repeated_failure")
    return by.select("turn_id", outcome.otherwise("other").alias("outcome"))


@query("surfaced_filter", ["notifications", "audit"], """with m as (select max(ts_ms) as now from audit), s as (select distinct id + 1 as id from audit, m where ts_ms > now - 86400000 and not success and tool <> 'view')
 select id, provider from notifications where id not in (select id from s)""")
def surfaced_filter(rows: DataFrame, audit: DataFrame) -> DataFrame:
    now = audit.agg(F.max("ts_ms").alias("now"))  # one row
    live = audit.transform(with_one, now).where("ts_ms > now - 86400000 and not success and tool <> 'view'").select((F.col("id") + 1).alias("id"))
    return tables.without(rows, live, ["id"]).select("id", "provider")


@query("sent_once", ["notifications"], "with m as (select max(sec) as now from notifications) select provider || ':' || action as key, min(id) as id from notifications, m where sec >= now - 10 * 86400 group by 1")
def sent_once(rows: DataFrame) -> DataFrame:
    now = rows.agg(F.max("sec").alias("now"))  # one row
    fresh = rows.transform(with_one, now).where("sec >= now - 10 * 86400")
    return fresh.groupBy(F.concat_ws(":", "provider", "action").alias("key")).agg(F.min("id").alias("id"))


@query("reflection_dedupe", ["sentences"], "select source || '|' || substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 80) as key, min(doc_id) as doc_id, count(*) as n from sentences group by 1")
def reflection_dedupe(rows: DataFrame) -> DataFrame:
    from loomlake.functions.text import collapse_ws

    key = F.concat_ws("|", "source", F.substring(collapse_ws("text"), 1, 80))
    return rows.groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("reflection_cap_n", ["turns"], "select session_id, least(count(*), 3) as kept, greatest(count(*) - 3, 0) as dropped from turns group by 1")
def reflection_cap_n(turns: DataFrame) -> DataFrame:
    n = F.count("*")
    return turns.groupBy("session_id").agg(F.least(n, F.lit(3)).cast("long").alias("kept"), F.greatest(n - 3, F.lit(0)).cast("long").alias("dropped"))


@query("trigger_history", ["usage"], "select id, day from usage order by day desc, id desc limit 40")
def trigger_history(usage: DataFrame) -> DataFrame:
    return usage.select("id", "day").orderBy(F.desc("day"), F.desc("id")).limit(40)


@query("respond_queue", ["kv"], "with l as (select namespace, k, max(updated_at) as updated_at from kv group by 1, 2) select namespace, k, updated_at from l order by updated_at desc, k limit 500")
def respond_queue(kv: DataFrame) -> DataFrame:
    return kv.groupBy("namespace", "k").agg(F.max("updated_at").alias("updated_at")).orderBy(F.desc("updated_at"), "k").limit(500)


@query("artifacts_page", ["orders"], "with t as (select count(*) as total from orders) select o_orderkey, total from orders, t order by o_orderdate desc, o_orderkey limit 15 offset 15")
def artifacts_page(orders: DataFrame) -> DataFrame:
    total = orders.agg(F.count("*").alias("total"))  # one row
    top = orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(15).limit(15)
    return top.transform(with_one, total).select("o_orderkey", "total")


@query("meet_recent", ["orders"], "select o_orderkey, o_orderpriority from orders order by o_orderdate desc, o_orderkey desc limit 10")
def meet_recent(orders: DataFrame) -> DataFrame:
    return orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10).select("o_orderkey", "o_orderpriority")


@query("link_hits", ["pages"], "select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as link, count(*) as hit_count, max(page_id) as last_used from pages group by 1")
def link_hits(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.try_parse_url("url", F.lit("HOST")).alias("link")).agg(F.count("*").alias("hit_count"), F.max("page_id").alias("last_used"))


@query("routing_log", ["usage"], "select split_part(model, '/', 2) as category, split_part(model, '/', 1) as routed_to, count(*) as calls, cast(sum(input_tokens) as bigint) as tokens, round(avg(cost_usd), 4) as mean_cost from usage group by 1, 2")
def routing_log(usage: DataFrame) -> DataFrame:
    by = usage.groupBy(F.split_part("model", F.lit("/"), F.lit(2)).alias("category"), F.split_part("model", F.lit("/"), F.lit(1)).alias("routed_to"))
    return by.agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("tokens"), F.round(F.avg("cost_usd"), 4).alias("mean_cost"))


@query("transcript_day", ["messages"], """select conv_id, cast(min(floor(sec / 86400.0)) as bigint) as first_day, cast(max(floor(sec / 86400.0)) as bigint) as last_day, md5(string_agg(role || ': ' || body, chr(10) order by turn)) as transcript from messages group by 1""")
def transcript_day(messages: DataFrame) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "body").alias("line"))))
    by = messages.groupBy("conv_id").agg(F.min(F.floor(F.col("sec") / 86_400)).alias("first_day"), F.max(F.floor(F.col("sec") / 86_400)).alias("last_day"), lines.alias("l"))
    return by.select("conv_id", "first_day", "last_day", F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("transcript"))


@query("history_examples", ["messages"], "select message_id, right(body, 40) as context from messages where role = 'assistant' order by sec desc, message_id desc limit 50")
def history_examples(messages: DataFrame) -> DataFrame:
    return messages.where("role = 'assistant'").orderBy(F.desc("sec"), F.desc("message_id")).limit(50).select("message_id", F.right("body", F.lit(40)).alias("context"))
