"""Scores, trees, digests and topic routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.functions.scalars import with_one
from loomlake.functions import text as fn
from loomlake.operators import graph
from loomlake.operators import score as sc
from loomlake.operators import trees as op
from loomlake.plans.catalog import query, stand_in

#: Any fixed vector, to rank nodes by.
QUERY = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]

BUDGET, SMALL_BUDGET = 5_000, 400
stand_in("tree_edges", "select l_suppkey as parent, l_suppkey + 1 + l_partkey % 3 as child from {lineitem} group by 1, 2")
#: Chats get headings as canonicalising leaves them; tags stack, so that interaction takes every value.
stand_in("chunk_tags", """select id, source_kind, case when source_kind = 'chat' then '# Chat transcript' || chr(10) || '## 0 — ada@example.com' || chr(10) || content || chr(10) || '## 1 — bob' || chr(10) || 'see https://example.org/x #plan @bob' else content end as content, token_count,
    tags || case when id % 5 = 0 then ',provider:gmail' when id % 5 = 1 then ',provider:notion' else '' end || case id % 6 when 0 then ',sent' when 1 then ',dm,mention' when 2 then ',sent,dm,mention' when 3 then ',mention' else '' end as tags from {chunks}""")
SPOKEN = "case when source_kind = 'chat' then array_to_string(list_filter(string_split(content, chr(10)), lambda x: not (starts_with(x, '# Chat transcript') or starts_with(x, '## '))), chr(10)) else content end"
SCORE = r"""with p as (select *, """ + SPOKEN + r""" as own from chunk_tags),
 w as (select p.*, list_filter(regexp_split_to_array(lower(own), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w, len(list_distinct(list_concat(list_concat(list_concat(list_concat(list_transform(regexp_extract_all(own, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), lambda x: 'email:' || x),
 list_transform(regexp_extract_all(own, 'https?://[^\s<>"'')]+'), lambda x: 'url:' || x)), list_transform(regexp_extract_all(own, '(?:^|[\s(])(@[A-Za-z0-9_][A-Za-z0-9_.\-]+)', 1), lambda x: 'handle:' || x)),
 list_transform(regexp_extract_all(own, '\b[A-Za-z0-9_.\-]{2,32}#[0-9]{4}\b'), lambda x: 'handle:' || x)), list_transform(regexp_extract_all(own, '(?:^|[\s(])(#[A-Za-z][A-Za-z0-9_\-]*)', 1), lambda x: 'hashtag:' || x)))) as ne,
 string_split(tags, ',') as tg from p),
 i as (select *, (case when list_contains(tg, 'sent') then 0.6 else 0 end + case when list_contains(tg, 'reply') then 0.5 else 0 end + case when list_contains(tg, 'dm') then 0.3 else 0 end + case when list_contains(tg, 'mention') then 0.2 else 0 end)::double as touch from w),
 s as (select id, token_count as n, ne, round(case when token_count < 10 then 0 when token_count < 30 then (token_count - 10) / 20.0 when token_count <= 3000 then 1 when token_count < 8000 then 1 - 0.5 * (token_count - 3000) / 5000.0 else 0.5 end, 6)::double as token,
 round(case when len(w) < 5 then 0.5 else least(greatest((len(list_distinct(w)) / len(w) - 0.3) / 0.4, 0), 1) end, 6) as diversity, (case source_kind when 'email' then 0.8 when 'document' then 0.9 else 0.5 end)::double as metadata,
 (case when tags like '%provider:gmail%' then 0.8 when tags like '%provider:notion%' then 0.75 when source_kind = 'email' then 0.75 when source_kind = 'document' then 0.7 else 0.5 end)::double as source, round(case when touch = 0 then 0.5 else least(touch, 1) end, 6) as interaction,
 round(case when token_count > 0 then least(ne / token_count / 0.01, 1) else 0 end, 6) as density, (id % 100) / 100.0 as llm from i),
 c as (select *, least(greatest((token + diversity + 1.5 * metadata + 1.5 * source + 3 * interaction + density) / 9.0, 0), 1) as cheap from s),
 t as (select *, round({total}, 6) as total from c),
 v as (select *, case when n < 10 and ne = 0 then 'short and without entities' when total < 0.3 then 'below threshold' else '' end as reason from t)"""
ASKED = "case when cheap > 0.15 and cheap < 0.85 then (cheap * 9.0 + 2 * llm) / 11.0 else cheap end"


def _scored(chunks: DataFrame, asked: bool = False) -> DataFrame:
    rows = chunks.withColumn("tags", F.split("tags", ",")).withColumn("n_entities", sc.n_entities(sc.spoken("source_kind", "content")))
    return sc.scored(rows, (F.col("id") % 100) / 100 if asked else None)


@query("score_chunks", ["chunk_tags"], SCORE.replace("{total}", "cheap") + " select id, total, reason = '' as kept, reason from v")
def score_chunks(chunks: DataFrame) -> DataFrame:
    return _scored(chunks).select("id", "total", "kept", "reason")


@query("score_llm", ["chunk_tags"], SCORE.replace("{total}", ASKED) + " select id, total, reason = '' as kept, reason from v")
def score_llm(chunks: DataFrame) -> DataFrame:
    """With a rating for the open band, where a caller's model would stand."""
    return _scored(chunks, True).select("id", "total", "kept", "reason")


@query("score_components", ["chunk_tags"], SCORE.replace("{total}", "cheap") + " select id, token, diversity, metadata, source, interaction, density from v")
def score_components(chunks: DataFrame) -> DataFrame:
    return _scored(chunks).select("id", "token", "diversity", "metadata", "source", "interaction", "density")


SEAL = f"""with recursive s as (select source_id, seq, id, token_count, row_number() over (partition by source_id order by seq, id) as rn from chunks),
 f as (select source_id, rn, id, token_count, cast(0 as bigint) as grp, token_count as held from s where rn = 1 union all
 select s.source_id, s.rn, s.id, s.token_count, case when f.held >= {BUDGET} then f.grp + 1 else f.grp end, case when f.held >= {BUDGET} then s.token_count else f.held + s.token_count end from f join s on s.source_id = f.source_id and s.rn = f.rn + 1)"""


def _groups(chunks: DataFrame) -> DataFrame:
    return op.seal_groups(chunks, "source_id", ["seq", "id"], "token_count", BUDGET)


@query("tree_seal_l0", ["chunks"], SEAL + f" select source_id, grp, count(*) as leaves, cast(sum(token_count) as bigint) as tokens, min(id) as first_id, max(id) as last_id, sum(token_count) >= {BUDGET} as full from f group by 1, 2")
def tree_seal_l0(chunks: DataFrame) -> DataFrame:
    return op.sealed(_groups(chunks), "source_id", "token_count", "id", BUDGET)


@query("tree_seal_up", ["chunks"], SEAL.replace(str(BUDGET), str(SMALL_BUDGET)) + f""", g as (select source_id, grp, sum(token_count) as tokens, min(id) as lo, max(id) as hi from f group by 1, 2 having sum(token_count) >= {SMALL_BUDGET}),
 u as (select source_id, cast(l as integer) as level, cast(floor(grp / pow(2, l)) as bigint) as node, count(*) as leaves, cast(sum(tokens) as bigint) as tokens, min(lo) as first_id, max(hi) as last_id from g, range(1, 33) r(l) where pow(2, l) <= (select count(*) from g) group by 1, 2, 3)
 select source_id, level, node, cast(node * 2 as varchar) || ',' || cast(node * 2 + 1 as varchar) as children, tokens, first_id, last_id from u where leaves = pow(2, level)""")
def tree_seal_up(chunks: DataFrame) -> DataFrame:
    groups = op.seal_groups(chunks, "source_id", ["seq", "id"], "token_count", SMALL_BUDGET)
    return op.sealed_up(op.sealed(groups, "source_id", "token_count", "id", SMALL_BUDGET).where("full"), "source_id", 2)


@query("tree_flush", ["chunks"], SEAL + f""", g as (select source_id, grp, sum(token_count) as t, min(id) as lo, max(id) as hi from f group by 1, 2) select source_id, grp, cast(t as bigint) as tokens from g where t < {BUDGET} and (hi - lo) * 3600 > 7 * 86400""")
def tree_flush(chunks: DataFrame) -> DataFrame:
    rest = op.sealed(_groups(chunks), "source_id", "token_count", "id", BUDGET).where("not full")
    return rest.where((F.col("last_id") - F.col("first_id")) * 3600 > 7 * 86_400).select("source_id", "grp", "tokens")


@query("tree_labels", ["summaries"], "select parent_id, string_agg(distinct entity, ',' order by entity) as union_label, string_agg(distinct entity, ',' order by entity) filter (level = 0) as extract_label, '' as empty_label from summaries group by 1")
def tree_labels(summaries: DataFrame) -> DataFrame:
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    own = F.collect_set(F.when(F.col("level") == 0, F.col("entity")))
    extract = F.when(F.size(own) > 0, F.array_join(F.array_sort(own), ","))
    return summaries.groupBy("parent_id").agg(join("entity").alias("union_label"), extract.alias("extract_label"), F.lit("").alias("empty_label"))


@query("node_rollup", ["summaries"], "select parent_id, string_agg(distinct entity, ',' order by entity) as entities, min(time_start) as time_start, max(time_end) as time_end, greatest(max(score), 0) as score from summaries group by 1")
def node_rollup(summaries: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort(F.collect_set("entity")), ",")
    return summaries.groupBy("parent_id").agg(ids.alias("entities"), F.min("time_start").alias("time_start"), F.max("time_end").alias("time_end"), F.greatest(F.max("score"), F.lit(0.0)).alias("score"))


@query("summarise_fallback", ["summaries"], "select parent_id, substr(string_agg('— ' || trim(content), chr(10) || chr(10) order by id, content), 1, 80) as summary from summaries group by 1")
def summarise_fallback(summaries: DataFrame) -> DataFrame:
    children = F.transform(F.array_sort(F.collect_list(F.struct("id", "content"))), lambda x: x["content"])
    return summaries.groupBy("parent_id").agg(children.alias("c")).select("parent_id", op.summary_of(F.col("c"), 20).alias("summary"))


DIGEST = """with d as (select *, unnest(range(cast(floor(time_start / 86400.0) as bigint), cast(floor(time_end / 86400.0) as bigint) + 1)) as day_no from summaries where not deleted),
 r as (select *, row_number() over (partition by day_no, tree_id order by level desc, sealed_at desc, id desc, content desc) as rn from d),
 g as (select day_no, count(*) as contributions, md5(string_agg(content, '|' order by tree_id)) as digest from r where rn = 1 group by 1)"""


def _digests(summaries: DataFrame) -> DataFrame:
    days = graph.overlapping_days(summaries.where("not deleted"), "time_start", "time_end")
    best = days.groupBy("day_no", "tree_id").agg(F.max(F.struct("level", "sealed_at", "id", "content")).alias("x"))
    parts = F.array_sort(F.collect_list(F.struct("tree_id", F.col("x.content").alias("c"))))
    by = best.groupBy("day_no").agg(F.count("*").alias("contributions"), parts.alias("p"))
    return by.select("day_no", "contributions", F.md5(F.array_join(F.transform("p", lambda p: p["c"]), "|")).alias("digest"))


@query("daily_digest", ["summaries"], DIGEST + " select * from g")
def daily_digest(summaries: DataFrame) -> DataFrame:
    return _digests(summaries)


@query("global_seal", ["summaries"], """with d as (select distinct tree_id, cast(floor(time_end / 86400.0) as bigint) as day_no from summaries where not deleted), w as (select tree_id, day_no, row_number() over (partition by tree_id order by day_no) - 1 as rn from d),
 l(level, size) as (values ('week', 7), ('month', 28), ('year', 336))
 select tree_id, level, cast(floor(rn / size) as bigint) as node, count(*) as days, min(day_no) as first, max(day_no) as last from w, l group by 1, 2, 3, size having count(*) = size""")
def global_seal(summaries: DataFrame) -> DataFrame:
    days = summaries.where("not deleted").select("tree_id", F.floor(F.col("time_end") / 86_400).alias("day_no")).distinct()
    return op.calendar_seal(days, "tree_id", "day_no")


@query("recap", ["summaries"], """with n as (select * from summaries where not deleted), t as (select max(time_end) as now from n), w as (select unnest([1, 7, 30, 400]) as days),
 l as (select days, now - days * 86400 as since, case when days < 2 then 0 when days < 14 then 1 when days < 60 then 2 else 3 end as wanted from w, t),
 have as (select distinct level from n), p as (select days, since, max(level) as level from l join have on have.level <= wanted group by 1, 2)
 select cast(p.days as integer) as days, p.level, n.id, n.tree_id, n.time_start, n.time_end, md5(n.content) as h from p join n on n.level = p.level and n.time_end >= p.since""")
def recap(summaries: DataFrame) -> DataFrame:
    return op.recap(summaries.where("not deleted"), (1, 7, 30, 400)).select("days", "level", "id", "tree_id", "time_start", "time_end", F.md5("content").alias("h"))


@query("time_tree", ["events"], """with e as (select year(ts) as y, month(ts) as m, day(ts) as d, hour(ts) as h, event_id % 400 as t from events),
 r as (select y, m, d, h, count(*) as n, sum(t) as tokens, grouping(y, m, d, h) as g from e group by rollup (y, m, d, h))
 select case when g = 15 then 'root' else concat_ws('/', y, lpad(cast(m as varchar), 2, '0'), lpad(cast(d as varchar), 2, '0'), lpad(cast(h as varchar), 2, '0')) end as node, cast(case g when 0 then 4 when 1 then 3 when 3 then 2 when 7 then 1 else 0 end as integer) as level, n, cast(tokens as bigint) as tokens,
 tokens > case g when 0 then 1000 when 1 then 2000 when 3 then 4000 when 7 then 8000 else 20000 end as summarised from r""")
def time_tree(events: DataFrame) -> DataFrame:
    return op.time_tree(events.select("ts", (F.col("event_id") % 400).alias("t")), "ts", "t")


@query("tree_status", ["summaries"], "select tree_id, count(*) as nodes, max(level) as depth, min(time_start) as oldest, max(time_end) as newest from summaries group by 1")
def tree_status(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("tree_id").agg(F.count("*").alias("nodes"), F.max("level").alias("depth"), F.min("time_start").alias("oldest"), F.max("time_end").alias("newest"))


NEAR = "list_dot_product(embedding::double[], {q}) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product({q}, {q})))".replace("{q}", "[" + ", ".join(map(str, QUERY)) + "]::double[]")


@query("drill_down", ["tree_edges", "embeddings"], f"""with recursive w as (select distinct parent as root, parent as node, 0 as depth from tree_edges where parent % 5 = 0 union select w.root, e.child, w.depth + 1 from w join tree_edges e on e.parent = w.node where w.depth < 3),
 m as (select root, node, min(depth) as depth from w group by 1, 2), s as (select m.*, round(case when m.node % 3 = 0 then null else {NEAR} end, 6) as similarity from m left join embeddings e on e.vec_id = m.node),
 r as (select *, row_number() over (partition by root order by similarity desc nulls last, depth, node desc) as pos from s) select root, node, depth, similarity, cast(pos as integer) as pos from r where pos <= 5""")
def drill_down(edges: DataFrame, embeddings: DataFrame) -> DataFrame:
    roots = edges.where("parent % 5 = 0").select(F.col("parent").alias("root")).distinct()
    vectors = embeddings.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("node"), "embedding")  # a third has none
    return op.reranked(graph.bounded_walk(edges, roots, 3), vectors, QUERY, 5)


@query("fetch_leaves", ["chunks"], "with q as (select unnest([5, 3, 9999999, 17, 11]) as id, unnest(range(5)) as pos) select cast(q.pos as integer) as pos, c.id, c.source_id, 0.0::double as score from q join chunks c on c.id = q.id")
def fetch_leaves(chunks: DataFrame) -> DataFrame:
    wanted = chunks.sparkSession.createDataFrame([(i, x) for i, x in enumerate((5, 3, 9999999, 17, 11))], "pos int, id long")
    return chunks.join(F.broadcast(wanted), "id").select("pos", "id", "source_id", F.lit(0.0).alias("score"))  # at most 20 ids


@query("query_source", ["chunks"], "select id, timestamp_ms from chunks where source_id = 'src4' and timestamp_ms >= 1700000000000 order by timestamp_ms desc, id desc limit 10")
def query_source(chunks: DataFrame) -> DataFrame:
    return chunks.where("source_id = 'src4' and timestamp_ms >= 1700000000000").orderBy(F.desc("timestamp_ms"), F.desc("id")).limit(10).select("id", "timestamp_ms")


@query("query_topic", ["entity_index", "trees"], "select e.node_id, e.score, t.scope from entity_index e join trees t on t.tree_id = e.tree_id where e.entity_id = 'p5' order by e.score desc, e.timestamp_ms desc, e.node_id limit 20")
def query_topic(index: DataFrame, trees: DataFrame) -> DataFrame:
    hits = index.where("entity_id = 'p5'").select("node_id", "score", "timestamp_ms", "tree_id").join(trees.select("tree_id", "scope"), "tree_id")
    return hits.orderBy(F.desc("score"), F.desc("timestamp_ms"), "node_id").limit(20).select("node_id", "score", "scope")


@query("query_global", ["summaries"], DIGEST + " select 'recap' as hit, string_agg(cast(day_no as varchar), ',' order by day_no desc) as children from (select * from g order by day_no desc limit 7)")
def query_global(summaries: DataFrame) -> DataFrame:
    last = _digests(summaries).orderBy(F.desc("day_no")).limit(7)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("day_no"), asc=False), lambda d: d.cast("string")), ",")
    return last.agg(ids.alias("children")).select(F.lit("recap").alias("hit"), "children")


HOT = """with m as (select max(timestamp_ms) as now from entity_index), a as (select entity_id, count(*) as n, count(distinct tree_id) as src, max(timestamp_ms) as last, count(distinct node_id) as deg, count(*) filter (is_user) as hits from entity_index group by 1),
 d as (select a.*, (now - last) / 86400000.0 as days from a, m), h as (select *, round(ln(n + 1) + 0.5 * src + case when days <= 0 then 1 when days <= 7 then 1 - days / 14 when days < 30 then 0.5 * (30 - days) / 23 else 0 end + least(deg / 100.0, 1) + 2 * hits, 6) as hotness from d)"""


def _hot(index: DataFrame) -> DataFrame:
    now = index.agg(F.max("timestamp_ms").alias("now"))  # one row
    by = index.groupBy("entity_id").agg(F.count("*").alias("n"), F.countDistinct("tree_id").alias("src"), F.max("timestamp_ms").alias("last"), F.countDistinct("node_id").alias("deg"), F.count_if("is_user").alias("hits"))
    recency = fn.recency_piecewise((F.col("now") - F.col("last")) / 86_400_000.0)
    value = op.hotness(F.col("n"), F.col("src"), recency, F.least(F.col("deg") / 100, F.lit(1.0)), F.col("hits"))
    return by.transform(with_one, now).select("entity_id", "n", F.round(value, 6).alias("hotness"))


@query("hotness", ["entity_index"], HOT + " select entity_id, hotness, case when hotness >= 10 then 'create' when hotness < 2 then 'archive' else 'keep' end as action, n % 100 = 0 as recheck from h")
def hotness(index: DataFrame) -> DataFrame:
    h = F.col("hotness")
    return _hot(index).select("entity_id", "hotness", F.when(h >= 10, "create").when(h < 2, "archive").otherwise("keep").alias("action"), (F.col("n") % 100 == 0).alias("recheck"))


@query("topic_backfill", ["entity_index"], """with r as (select *, row_number() over (partition by entity_id order by timestamp_ms desc, node_id desc, surface, score desc, node_kind, entity_kind, tree_id) as rn from entity_index), m as (select max(timestamp_ms) as now from entity_index)
 select entity_id, count(*) as leaves, min(timestamp_ms) as first_ms from r, m where rn <= 10 and timestamp_ms >= now - cast(2000 as bigint) * 86400000 and node_kind = 'leaf' group by 1""")
def topic_backfill(index: DataFrame) -> DataFrame:
    from loomlake.operators import tables

    order = [F.desc("timestamp_ms"), F.desc("node_id"), F.asc("surface"), F.desc("score"), F.asc("node_kind"), F.asc("entity_kind"), F.asc("tree_id")]
    top = tables.newest(index, ["entity_id"], 10, order)  # the limit precedes the window
    now = index.agg(F.max("timestamp_ms").alias("now"))  # one row
    fresh = top.transform(with_one, now).where("timestamp_ms >= now - 2000L * 86400000 and node_kind = 'leaf'")
    return fresh.groupBy("entity_id").agg(F.count("*").alias("leaves"), F.min("timestamp_ms").alias("first_ms"))


@query("topic_route", ["entity_index", "trees"], "select e.node_id, t.tree_id as topic, count(*) as entities from entity_index e join trees t on t.kind = 'topic' and t.status = 'active' and t.tree_id = e.tree_id where e.node_kind = 'leaf' group by 1, 2")
def topic_route(index: DataFrame, trees: DataFrame) -> DataFrame:
    active = trees.where("kind = 'topic' and status = 'active'").select("tree_id")
    return index.where("node_kind = 'leaf'").join(active, "tree_id").groupBy("node_id", F.col("tree_id").alias("topic")).agg(F.count("*").alias("entities"))
