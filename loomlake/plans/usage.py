"""Usage, cost and interface rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.operators import usage as op
from loomlake.plans.catalog import query

DAYS = 14


@query("cost_daily", ["usage"], f"""
with last as (select max(day) as d from usage),
cal as (select cast(d - cast(i as integer) as date) as day from last, range({DAYS}) r(i))
select cal.day, coalesce(model, '') as model, round(coalesce(sum(cost_usd), 0), 4) as cost, cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens,
  cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens, cast(coalesce(sum(input_tokens + output_tokens), 0) as bigint) as total_tokens, count(id) as requests
from cal left join usage u on u.day = cal.day group by 1, 2""")
def cost_daily(usage: DataFrame) -> DataFrame:
    return op.daily_history(usage, DAYS)


@query("cost_dashboard", ["usage"], """
with last as (select max(day) as d from usage), w as (select usage.*, d from usage, last),
t as (select round(coalesce(sum(case when day > d - 7 then cost_usd end), 0), 4) as week_total,
 round(coalesce(sum(case when year(day) = year(d) and month(day) = month(d) then cost_usd end), 0), 4) as month_to_date from w)
select week_total, round(week_total / 7, 4) as daily_average, round(week_total / 7 * 30, 4) as monthly_pace, month_to_date,
 round(least(greatest(month_to_date / 50000.0, 0), 1), 6) as utilization,
 case when month_to_date >= 50000.0 then 'alert' when month_to_date >= 40000.0 then 'warn' else 'ok' end as status from t""")
def cost_dashboard(usage: DataFrame) -> DataFrame:
    return op.dashboard(usage, 50_000.0, 0.8)


@query("cost_by_model", ["usage"], """
with m as (select model, sum(cost_usd) as c, sum(input_tokens + output_tokens) as t, count(*) as n from usage group by model), a as (select sum(c) as total from m)
select model, split_part(model, '/', 1) as provider, round(c, 4) as cost, cast(t as bigint) as total_tokens, n as requests,
 round(case when total = 0 then 0 else 100 * c / total end, 4) as percent from m, a""")
def cost_by_model(usage: DataFrame) -> DataFrame:
    return op.by_model(usage)


@query("budget_check", ["usage"], """
with d as (select session_id, day, sum(cost_usd) as spent from usage group by 1, 2),
m as (select session_id, year(day) * 100 + month(day) as ym, sum(cost_usd) as spent from usage group by 1, 2)
select d.session_id, d.day, round(d.spent, 4) as day_cost, round(m.spent, 4) as month_cost,
 case when d.spent + 5 > 60 then 'exceeded_daily' when m.spent + 5 > 500 then 'exceeded_monthly' when d.spent + 5 >= 60 * 0.8 then 'warning_daily'
 when m.spent + 5 >= 500 * 0.8 then 'warning_monthly' else 'allowed' end as verdict
from d join m on m.session_id = d.session_id and m.ym = year(d.day) * 100 + month(d.day)""")
def budget_check(usage: DataFrame) -> DataFrame:
    return op.budget(usage, projected=5.0, daily=60.0, monthly=500.0, warn=0.8)


@query("cost_for_date", ["usage"], "select day, round(sum(cost_usd), 4) as cost, count(*) as n from usage where day = date '2024-01-05' group by day")
def cost_for_date(usage: DataFrame) -> DataFrame:
    return usage.where("day = date '2024-01-05'").groupBy("day").agg(F.round(F.sum("cost_usd"), 4).alias("cost"), F.count("*").alias("n"))


@query("cost_for_month", ["usage"], "select cast(year(day) as integer) as y, cast(month(day) as integer) as m, round(sum(cost_usd), 4) as cost, count(*) as n from usage group by 1, 2")
def cost_for_month(usage: DataFrame) -> DataFrame:
    by = usage.groupBy(F.year("day").alias("y"), F.month("day").alias("m"))
    return by.agg(F.round(F.sum("cost_usd"), 4).alias("cost"), F.count("*").alias("n"))


@query("tool_stats", ["tool_calls"], """
with e as (select tool, substr(message, 1, 80) as msg, min(seq) as first_seq from tool_calls where not ok group by 1, 2),
r as (select *, row_number() over (partition by tool order by first_seq desc) as rn from e),
l as (select tool, string_agg(msg, '|' order by first_seq) as last_errors from r where rn <= 5 group by tool)
select t.tool, count(*) as calls, count(*) filter (ok) as success, count(*) filter (not ok) as failure, round(avg(duration_ms), 4) as mean_ms, coalesce(max(last_errors), '') as last_errors
from tool_calls t left join l on l.tool = t.tool group by t.tool""")
def tool_stats(calls: DataFrame) -> DataFrame:
    return op.tool_stats(calls)


@query("compaction_stats", ["documents"], """
select source, cast(sum(length(text)) as bigint) as raw_chars, cast(sum(length(trim(regexp_replace(text, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g')))) as bigint) as reduced_chars,
 round(sum(length(trim(regexp_replace(text, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g')))) / sum(length(text)), 6) as ratio from documents group by source""")
def compaction_stats(docs: DataFrame) -> DataFrame:
    from loomlake.functions.text import collapse_ws

    return op.compaction(docs.select("source", F.col("text").alias("raw"), collapse_ws("text").alias("reduced")), "source")


@query("status_counts", ["jobs"], "select status, count(*) as n from jobs group by status")
def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


@query("ui_heatmap", ["usage"], """
with last as (select max(day) as d from usage), c as (select day, count(*) as n from usage group by day),
cal as (select cast(d - cast(i as integer) as date) as day from last, range(182) r(i))
select cal.day, coalesce(n, 0) as n, cast(case when coalesce(n, 0) = 0 then 0 when n = 1 then 1 when n <= 3 then 2 when n <= 6 then 3 else 4 end as integer) as level,
 cast(dayofweek(cal.day) as integer) as weekday from cal left join c on c.day = cal.day""")
def ui_heatmap(usage: DataFrame) -> DataFrame:
    return op.heatmap(usage, 182)


@query("ui_buckets", ["usage"], """
with last as (select max(day) as d from usage)
select case when day = d then 'TODAY' when day = d - 1 then 'YESTERDAY' when day > d - 7 then 'THIS WEEK' else 'OLDER' end as bucket, count(*) as n from usage, last group by 1""")
def ui_buckets(usage: DataFrame) -> DataFrame:
    return op.age_buckets(usage)


@query("ui_stats", ["chunks"], """select cast(sum(token_count) as bigint) as tokens, count(*) filter (token_count > 500) as compactions, count(*) filter (token_count <= 500) as flushes from chunks""")
def ui_stats(chunks: DataFrame) -> DataFrame:
    big = F.col("token_count") > 500
    return chunks.agg(F.sum("token_count").alias("tokens"), F.count_if(big).alias("compactions"), F.count_if(~big).alias("flushes"))
