"""Streaming queries, drained over the event table, with the SQL of their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.plans.catalog import QUERIES, TWINS, query
from loomlake.streaming import jobs


def stream(name: str, sql: str):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, jobs.table_stream(spark, sf_dir, "events"))
        TWINS[name] = ((), sql)
        return f

    return keep


@stream("st_event_bus", "select event_type, count(*) as n from events group by 1")
def st_event_bus(spark: SparkSession, events: DataFrame) -> DataFrame:
    return jobs.drained(events.groupBy("event_type").agg(F.count("*").alias("n")), "complete")


@stream("st_late", "select distinct user_id, event_type from events")
def st_late(spark: SparkSession, events: DataFrame) -> DataFrame:
    return jobs.drained(jobs.deduplicated(events, ["user_id", "event_type"], "400 days").select("user_id", "event_type"))


@query("st_periodic_sync", ["events"], """with e as (select user_id as connection, cast(floor(epoch(ts)) as bigint) as sec from events where event_id > 100), b as (select connection, cast(floor(sec / 1200) as bigint) as tick, count(*) as items, min(sec) as first from e group by 1, 2),
 l as (select *, lag(first) over (partition by connection order by tick) as last from b), p as (select *, least(cast(ceil(items / 2.0) as bigint), case when first - last < 300 then 2 else 20 end) as pages, cast(floor(tick * 1200 / 86400) as bigint) as day from l),
 r as (select *, coalesce(sum(pages) over (partition by connection, day order by tick rows between unbounded preceding and 1 preceding), 0) as before from p)
 select connection, tick, items, pages, cast(before as bigint) as requests_before, cast(least(items, least(pages, 500 - before) * 2) as bigint) as taken from r where before < 500""")
def st_periodic_sync(events: DataFrame) -> DataFrame:
    fresh = events.where("event_id > 100").select(F.col("user_id").alias("connection"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"))  # beyond the cursor
    return jobs.sync_plan(fresh, 2)


@stream("st_daily", "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def st_daily(spark: SparkSession, events: DataFrame) -> DataFrame:
    return jobs.drained(jobs.windowed(events, "1 day"), "complete")


@stream("st_flush", "select time_bucket(interval 3 hours, ts, timestamp '1970-01-01') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def st_flush(spark: SparkSession, events: DataFrame) -> DataFrame:
    return jobs.drained(jobs.windowed(events, "3 hours"), "complete")


@stream("st_session_segment", """with recursive s as (select user_id, event_id, event_type, epoch_ms(ts) as seen, row_number() over (partition by user_id order by event_id) as rn from events),
 f as (select user_id, event_id, rn, seen, cast(0 as bigint) as segment, 1 as n, '' as reason from s where rn = 1 union all
 select s.user_id, s.event_id, s.rn, s.seen, f.segment + case when f.n >= 20 or s.seen - f.seen > 86400000 or s.event_type = 'error' then 1 else 0 end, case when f.n >= 20 or s.seen - f.seen > 86400000 or s.event_type = 'error' then 1 else f.n + 1 end,
 case when f.n >= 20 then 'count' when s.seen - f.seen > 86400000 then 'gap' when s.event_type = 'error' then 'marker' else '' end from f join s on s.user_id = f.user_id and s.rn = f.rn + 1)
 select user_id, event_id, segment, reason from f""")
def st_session_segment(spark: SparkSession, events: DataFrame) -> DataFrame:
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    return jobs.drained(jobs.stateful(rows, "user_id", jobs.Segments(20, 86_400_000), "user_id long, event_id long, segment long, reason string"))


@stream("st_session_gap", """with l as (select *, lag(ts) over (partition by user_id order by ts) as p from events), g as (select *, sum(case when p is null or ts - p >= interval 1 day then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as s from l)
 select user_id, min(ts) as start, count(*) as n from g group by user_id, s""")
def st_session_gap(spark: SparkSession, events: DataFrame) -> DataFrame:
    return jobs.drained(jobs.sessions(events, "1 day"), "complete")


@stream("st_bucket_seal", """with recursive s as (select user_id, event_id, value, epoch_ms(ts) as seen, row_number() over (partition by user_id order by event_id) as rn from events),
 f as (select user_id, rn, cast(0 as bigint) as grp, value as held, 1 as n, seen as since, seen, false as aged from s where rn = 1 union all
 select s.user_id, s.rn, f.grp + case when f.held >= 100 or s.seen - f.since > 259200000 then 1 else 0 end, case when f.held >= 100 or s.seen - f.since > 259200000 then s.value else f.held + s.value end,
 case when f.held >= 100 or s.seen - f.since > 259200000 then 1 else f.n + 1 end, case when f.held >= 100 or s.seen - f.since > 259200000 then s.seen else f.since end, s.seen, false from f join s on s.user_id = f.user_id and s.rn = f.rn + 1),
 g as (select user_id, grp, max(n) as n, max_by(held, rn) as held, max(since) as since, max(rn) as rn from f group by 1, 2), w as (select max(epoch_ms(ts)) - 3600000 as mark from events), z as (select *, max(rn) over (partition by user_id) as last from g)
 select user_id, grp, cast(n as bigint) as n, round(held, 4) as total, case when held >= 100 then 'size' else 'age' end as reason from z, w where held >= 100 or rn < last or since + 259200000 <= mark""")
def st_bucket_seal(spark: SparkSession, events: DataFrame) -> DataFrame:
    schema = "user_id long, grp long, n long, total double, reason string"
    return jobs.drained(jobs.stateful(jobs.timed(events, "1 hour"), "user_id", jobs.BucketSeal(100.0, 3 * 86_400_000), schema, "EventTime"))


@stream("st_ring", "with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as rn from events) select user_id, min(event_id) filter (rn <= 32) as oldest, count(*) filter (rn <= 32) as n, count(*) filter (rn > 32) as dropped from r group by 1")
def st_ring(spark: SparkSession, events: DataFrame) -> DataFrame:
    seen = jobs.drained(jobs.stateful(events, "user_id", jobs.Ring(32), "user_id long, oldest long, n long, dropped long"))
    # a key reports after each micro-batch; its last report has most
    return seen.groupBy("user_id").agg(F.max_by(F.struct("oldest", "n", "dropped"), F.struct("dropped", "n")).alias("x")).select("user_id", "x.*")


@stream("st_extract_trigger", """with recursive s as (select user_id, event_id, event_id % 97 * 10 as tok, case when event_type = 'click' then 1 else 0 end as c, row_number() over (partition by user_id order by event_id) as rn from events),
 f as (select user_id, event_id, rn, tok as t, c, 1 as n from s where rn = 1 union all
 select s.user_id, s.event_id, s.rn, case when f.t >= 1500 and f.c >= 2 and f.n >= 4 then 0 else f.t end + s.tok, case when f.t >= 1500 and f.c >= 2 and f.n >= 4 then 0 else f.c end + s.c, case when f.t >= 1500 and f.c >= 2 and f.n >= 4 then 0 else f.n end + 1 from f join s on s.user_id = f.user_id and s.rn = f.rn + 1)
 select user_id, event_id from f where t >= 1500 and c >= 2 and n >= 4""")
def st_extract_trigger(spark: SparkSession, events: DataFrame) -> DataFrame:
    return jobs.drained(jobs.stateful(events, "user_id", jobs.ExtractTrigger(1500, 2, 4), "user_id long, event_id long"))


@query("st_lifecycle", ["chunks", "labels"], """select c.id, case when l.doc_id is null then 'pending_extraction' when l.quality = 0 then 'dropped' when c.seq % 3 = 0 then 'sealed' when c.seq % 3 = 1 then 'buffered' else 'admitted' end as status from chunks c left join labels l on l.doc_id = c.id""")
def st_lifecycle(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    joined = chunks.select("id", "seq").join(labels.select(F.col("doc_id").alias("id"), "quality"), "id", "left")
    status = F.when(F.col("quality").isNull(), "pending_extraction").when(F.col("quality") == 0, "dropped").when(F.col("seq") % 3 == 0, "sealed").when(F.col("seq") % 3 == 1, "buffered")
    return joined.select("id", status.otherwise("admitted").alias("status"))


ACTIONS = {"click": "claim", "error": "fail", "purchase": "done", "view": "defer"}


@query("st_queue", ["events"], """with l as (select user_id * 40 + event_id % 40 as job, event_id as seq, case event_type when 'click' then 'claim' when 'error' then 'fail' when 'purchase' then 'done' when 'view' then 'defer' else 'claim' end as action, cast(floor(epoch(ts)) as bigint) as sec from events),
 n as (select max(sec) as now from l), d as (select *, coalesce(max(seq) filter (action = 'done') over (partition by job), -1) as done from l),
 g as (select job, count(*) filter (action = 'fail' and seq > done) as failures, arg_max(action, seq) as last, arg_max(sec, seq) as seen from d group by 1),
 t as (select g.*, now, case when last = 'claim' then case when now - seen <= 300 then 'running' else 'ready' end when last = 'defer' then 'deferred' when last = 'fail' then case when failures >= 5 then 'failed' else 'retry' end else 'done' end as status from g, n)
 select job, failures, status, case when status = 'deferred' then seen + 300 when status = 'retry' then seen + cast(60 * pow(2, least(failures, 5) - 1) as bigint) when status = 'ready' then now end as next_run from t""")
def st_queue(events: DataFrame) -> DataFrame:
    action = F.coalesce(F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))[F.col("event_type")], F.lit("claim"))
    log = events.select((F.col("user_id") * 40 + F.col("event_id") % 40).alias("job"), F.col("event_id").alias("seq"), action.alias("action"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"))
    return jobs.queue_state(log, log.agg(F.max("sec").alias("now")))  # one row
