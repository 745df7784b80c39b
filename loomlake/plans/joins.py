"""Joins: co-occurrence, digests, hotness, sync status, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.functions.scalars import with_one
from loomlake.operators import graph as op
from loomlake.operators import tables
from loomlake.plans.catalog import query, stand_in

stand_in("hotness_now", "select entity_id, count(*) as score, max(case when is_user then 1 else 0 end) as u from {entity_index} group by entity_id")
stand_in("hotness_before", "select entity_id, count(*) as score from {entity_index} where node_id % 3 > 0 group by entity_id")
stand_in("sync_chunks", """select event_id as id, 'prov' || cast(user_id % 6 as string) as provider, case when user_id % 11 = 0 then '' else 'src' || cast(user_id as string) end as source_id,
    floor(value) as tokens, @sec(ts) as sec, event_id % 4 <> 0 as embedded, event_id % 9 = 0 as skipped from {events}""")


@query("co_occurring", ["entity_index"], """with x as (select distinct entity_id, node_id from entity_index)
 select b.entity_id, count(*) as weight from x a join x b on a.node_id = b.node_id and a.entity_id = 'p7' and b.entity_id <> 'p7' group by 1 order by weight desc, entity_id limit 100""")
def co_occurring(index: DataFrame) -> DataFrame:
    return op.co_occurring(index, "p7")


@query("co_occur_all", ["entity_index"], """with x as (select distinct entity_id, node_id from entity_index)
 select a.entity_id as a, b.entity_id as b, count(*) as weight from x a join x b on a.node_id = b.node_id and a.entity_id < b.entity_id group by 1, 2""")
def co_occur_all(index: DataFrame) -> DataFrame:
    return op.co_occur_all(index)


@query("graph_by_weight", ["entity_index"], """with x as (select distinct entity_id, node_id from entity_index),
 n as (select b.entity_id, count(*) as weight from x a join x b on a.node_id = b.node_id and a.entity_id = 'p7' and b.entity_id <> 'p7' group by 1 order by weight desc, entity_id limit 100)
 select weight, string_agg(entity_id, ',' order by entity_id) as entities, count(*) as n from n group by weight""")
def graph_by_weight(index: DataFrame) -> DataFrame:
    return op.by_weight(op.co_occurring(index, "p7"))


@query("summaries_join_trees", ["summaries", "trees"], """select s.id, t.scope, s.sealed_at from summaries s join trees t on s.tree_id = t.tree_id
 where s.sealed_at > 900000000 and not s.deleted order by s.sealed_at desc, s.id limit 8""")
def summaries_join_trees(summaries: DataFrame, trees: DataFrame) -> DataFrame:
    recent = summaries.where("sealed_at > 900000000 and not deleted").select("id", "tree_id", "sealed_at")
    return recent.join(trees.select("tree_id", "scope"), "tree_id").orderBy(F.desc("sealed_at"), "id").limit(8).select("id", "scope", "sealed_at")


@query("latest_digest_join", ["summaries", "trees"], """select s.id, s.content, s.sealed_at from summaries s join trees t on s.tree_id = t.tree_id
 where t.kind = 'global' and s.level = 0 and s.sealed_at > 800000000 order by s.sealed_at desc, s.id limit 1""")
def latest_digest_join(summaries: DataFrame, trees: DataFrame) -> DataFrame:
    digests = summaries.where("level = 0 and sealed_at > 800000000").join(trees.where("kind = 'global'").select("tree_id"), "tree_id")
    return digests.orderBy(F.desc("sealed_at"), "id").limit(1).select("id", "content", "sealed_at")


@query("hotness_semi", ["hotness_now", "entity_index"], "select entity_id, score, exists(select 1 from entity_index e where e.entity_id = hotness_now.entity_id and e.is_user) as is_user from hotness_now")
def hotness_semi(now: DataFrame, index: DataFrame) -> DataFrame:
    users = index.where("is_user").select("entity_id").distinct().withColumn("is_user", F.lit(True))
    return now.join(users, "entity_id", "left").select("entity_id", "score", F.coalesce("is_user", F.lit(False)).alias("is_user"))


@query("hotness_delta", ["hotness_now", "hotness_before"], """select n.entity_id, n.score, n.score - coalesce(b.score, 0) as delta from hotness_now n left join hotness_before b on b.entity_id = n.entity_id
 where n.score <> coalesce(b.score, 0) order by abs(n.score - coalesce(b.score, 0)) desc, n.score desc, n.entity_id limit 10""")
def hotness_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    joined = now.join(before.withColumnRenamed("score", "old"), "entity_id", "left")
    moved = joined.select("entity_id", "score", (F.col("score") - F.coalesce("old", F.lit(0))).alias("delta")).where("delta <> 0")
    return moved.orderBy(F.desc(F.abs("delta")), F.desc("score"), "entity_id").limit(10)


@query("sync_status", ["sync_chunks"], """with resolved as (select *, embedded or skipped as done from sync_chunks where source_id <> ''),
 provider_max as (select provider, max(sec) as last_sec from resolved group by provider), pending as (select provider, count(*) as pending from resolved where not done group by provider),
 wave as (select r.provider, min(r.sec) as wave_start from resolved r where not r.done group by r.provider)
 select m.provider, m.last_sec, coalesce(p.pending, 0) as pending, cast(sum(case when r.done then 1 else 0 end) as bigint) as done, cast(sum(case when w.wave_start is not null and r.sec >= w.wave_start then r.tokens else 0 end) as bigint) as wave_tokens
 from resolved r join provider_max m on m.provider = r.provider left join pending p on p.provider = r.provider left join wave w on w.provider = r.provider group by 1, 2, 3""")
def sync_status(chunks: DataFrame) -> DataFrame:
    rows = chunks.where("source_id <> ''").select("provider", "sec", F.col("tokens").cast("long").alias("tokens"), (F.col("embedded") | F.col("skipped")).alias("done"))
    by = rows.groupBy("provider").agg(
        F.max("sec").alias("last_sec"), F.count_if(~F.col("done")).alias("pending"), F.count_if("done").alias("done_n"), F.min(F.when(~F.col("done"), F.col("sec"))).alias("wave_start")
    )
    wave = rows.join(by.select("provider", "wave_start"), "provider").where("sec >= wave_start").groupBy("provider").agg(F.sum("tokens").alias("t"))
    return by.join(wave, "provider", "left").select("provider", "last_sec", "pending", F.col("done_n").alias("done"), F.coalesce("t", F.lit(0)).cast("long").alias("wave_tokens"))


@query("f_sync_freshness", ["sync_chunks"], """with m as (select max(sec) as now from sync_chunks), l as (select provider, source_id, max(sec) as sec from sync_chunks group by 1, 2)
 select provider, source_id, case when now - sec <= 30 then 'active' when now - sec <= 86400 then 'recent' else 'idle' end as freshness from l, m""")
def f_sync_freshness(chunks: DataFrame) -> DataFrame:
    now = chunks.agg(F.max("sec").alias("now"))
    last = chunks.groupBy("provider", "source_id").agg(F.max("sec").alias("sec")).transform(with_one, now)  # one row
    age = F.col("now") - F.col("sec")
    return last.select("provider", "source_id", F.when(age <= 30, "active").when(age <= 86_400, "recent").otherwise("idle").alias("freshness"))


@query("count_subquery", ["customer", "orders"], "select c_custkey, (select count(*) from orders o where o.o_custkey = customer.c_custkey) as files from customer")
def count_subquery(customer: DataFrame, orders: DataFrame) -> DataFrame:
    files = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return customer.select("c_custkey").join(files, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("files"))


@query("filter_new", ["kv"], """with k as (select min(updated_at) as id, v from kv where updated_at > 300 group by v)
 select id, v from k where v not in (select v from kv where updated_at <= 60)""")
def filter_new(kv: DataFrame) -> DataFrame:
    fresh = kv.where("updated_at > 300").groupBy("v").agg(F.min("updated_at").alias("id"))
    return tables.without(fresh, kv.where("updated_at <= 60"), ["v"]).select("id", "v")


@query("facet_conflict", ["facets"], """with s as (select class, facet_key, facet_value, sum(confidence) as stability from facets group by 1, 2, 3), r as (select *, row_number() over (partition by class, facet_key order by round(stability, 4) desc, facet_value) as rn, count(*) over (partition by class, facet_key) as rivals from s)
 select class, facet_key, facet_value, round(stability, 4) as stability, rivals from r where rn = 1""")
def facet_conflict(facets: DataFrame) -> DataFrame:
    s = facets.groupBy("class", "facet_key", "facet_value").agg(F.round(F.sum("confidence"), 4).alias("stability"))
    top = s.groupBy("class", "facet_key").agg(F.min_by(F.struct("facet_value", "stability"), F.struct(-F.col("stability"), "facet_value")).alias("x"), F.count("*").alias("rivals"))
    return top.select("class", "facet_key", "x.facet_value", "x.stability", "rivals")


@query("batch_lookup", ["interactions"], "select person_id, count(*) as n, max(sec) as last_sec from interactions where person_id in (1, 3, 5, 7, 9) group by 1")
def batch_lookup(interactions: DataFrame) -> DataFrame:
    return interactions.where(F.col("person_id").isin(1, 3, 5, 7, 9)).groupBy("person_id").agg(F.count("*").alias("n"), F.max("sec").alias("last_sec"))


@query("interval_overlap", ["summaries"], """with d as (select *, unnest(range(cast(floor(time_start / 86400.0) as bigint), cast(floor(time_end / 86400.0) as bigint) + 1)) as day_no from summaries where not deleted),
 r as (select *, row_number() over (partition by day_no, tree_id order by level desc, sealed_at desc, id desc) as rn from d) select day_no, tree_id, id, level from r where rn = 1""")
def interval_overlap(summaries: DataFrame) -> DataFrame:
    days = op.overlapping_days(summaries.where("not deleted"), "time_start", "time_end")
    top = days.groupBy("day_no", "tree_id").agg(F.max(F.struct("level", "sealed_at", "id")).alias("x"))
    return top.select("day_no", "tree_id", "x.id", "x.level")


@query("window_cover", ["summaries"], """with w as (select *, count(*) over () as n from summaries where time_end >= 900000000 and time_start <= 901000000 and level = 1),
 f as (select *, row_number() over (order by sealed_at desc, id desc) as rn from summaries where level = 1)
 select id, time_start, 'cover' as how from w union all select id, time_start, 'latest' from f where rn = 1 and not exists (select 1 from w)""")
def window_cover(summaries: DataFrame) -> DataFrame:
    level = summaries.where("level = 1")
    cover = level.where("time_end >= 900000000 and time_start <= 901000000").select("id", "time_start", F.lit("cover").alias("how"))
    some = cover.agg((F.count("*") > 0).alias("some"))
    latest = level.orderBy(F.desc("sealed_at"), F.desc("id")).limit(1).transform(with_one, some).where("not some")  # one row meets one row
    return cover.union(latest.select("id", "time_start", F.lit("latest")))


@query("entity_match", ["entity_index"], """select entity_id, entity_kind, max(surface) as surface, count(*) as mentions, max(timestamp_ms) as last_seen from entity_index
 where (lower(entity_id) like '%p1%' or lower(surface) like '%p1%') and entity_kind in ('person', 'org') group by 1, 2 order by mentions desc, last_seen desc, entity_id, entity_kind limit 100""")
def entity_match(index: DataFrame) -> DataFrame:
    hits = index.where((F.lower("entity_id").like("%p1%") | F.lower("surface").like("%p1%")) & F.col("entity_kind").isin("person", "org"))
    sums = hits.groupBy("entity_id", "entity_kind").agg(F.max("surface").alias("surface"), F.count("*").alias("mentions"), F.max("timestamp_ms").alias("last_seen"))
    return sums.orderBy(F.desc("mentions"), F.desc("last_seen"), "entity_id", "entity_kind").limit(100)


@query("distinct_sources", ["entity_index"], "select entity_id, count(distinct tree_id) as sources from entity_index group by 1")
def distinct_sources(index: DataFrame) -> DataFrame:
    return index.groupBy("entity_id").agg(F.countDistinct("tree_id").alias("sources"))


@query("entity_lookup", ["entity_index"], "select node_id, surface, timestamp_ms from entity_index where entity_id = 'p11'")
def entity_lookup(index: DataFrame) -> DataFrame:
    return index.where("entity_id = 'p11'").select("node_id", "surface", "timestamp_ms")


@query("alias_lookup", ["supplier"], """select s_suppkey, s_name from supplier where list_contains([lower(s_name), 's' || cast(s_suppkey as varchar)], lower('S3'))""")
def alias_lookup(supplier: DataFrame) -> DataFrame:
    aliases = F.array(F.lower("s_name"), F.concat(F.lit("s"), "s_suppkey"))
    return supplier.where(F.array_contains(aliases, "s3")).select("s_suppkey", "s_name")


@query("ref_resolve", ["summaries", "kv"], """with refs as (select updated_at as pos, case when updated_at % 2 = 0 then 'summary' else 'entity' end as kind, updated_at as ref from kv where updated_at < 200)
 select pos, kind, substr(coalesce(s.content, 'entity p' || cast(ref as varchar)), 1, 400) as preview from refs left join summaries s on refs.kind = 'summary' and s.id = refs.ref where kind = 'entity' or s.id is not null""")
def ref_resolve(summaries: DataFrame, kv: DataFrame) -> DataFrame:
    refs = kv.where("updated_at < 200").select(F.col("updated_at").alias("pos"), F.when(F.col("updated_at") % 2 == 0, "summary").otherwise("entity").alias("kind"))
    body = summaries.select(F.col("id").alias("pos"), "content")
    found = refs.where("kind = 'summary'").join(body, "pos").select("pos", "kind", F.substring("content", 1, 400).alias("preview"))
    return found.union(refs.where("kind = 'entity'").select("pos", "kind", F.concat(F.lit("entity p"), "pos")))
