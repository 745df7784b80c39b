"""Upserts, deletes, filters, paging and set operations on the memory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.functions.scalars import with_one
from loomlake.functions import text as fn
from loomlake.operators import tables as op
from loomlake.plans.catalog import query, stand_in

stand_in("doc_writes", "select document_id, namespace, doc_key, title, content, priority, updated_at, document_id as created_at from {memory_docs}")

NORM_S = "upper(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
NORM_P = "upper(trim(regexp_replace(regexp_replace({c}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')))"


@query("src_parquet", ["orders"], "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def src_parquet(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("src_table_scan", ["kv"], "select namespace, k, v, updated_at from kv where namespace = 'ns1'")
def src_table_scan(kv: DataFrame) -> DataFrame:
    return kv.where("namespace = 'ns1'")


DOC = """with r as (select *, row_number() over (partition by namespace, doc_key order by updated_at desc) as rn,
 first_value(document_id) over (partition by namespace, doc_key order by updated_at) as first_id,
 min(created_at) over (partition by namespace, doc_key) as first_at, count(*) over (partition by namespace, doc_key) as writes from doc_writes)"""


@query("upsert_doc", ["doc_writes"], DOC + """ select namespace, doc_key, first_id as document_id, first_at as created_at, title, priority, updated_at, writes,
 sha256(content) as content_sha, 'local/hash/64' as signature from r where rn = 1""")
def upsert_doc(writes: DataFrame) -> DataFrame:
    out = op.upsert(writes, ["namespace", "doc_key"], "updated_at", ["document_id", "created_at"])
    return out.select("namespace", "doc_key", "document_id", "created_at", "title", "priority", "updated_at", "writes", F.sha2("content", 256).alias("content_sha"), F.lit("local/hash/64").alias("signature"))


def rechunked(writes: DataFrame, old: DataFrame, tokens: int = 225) -> DataFrame:
    """The chunks (document_id, seq, heading, content, embedding, signature, dim) after the writes: a written document's
    old chunks go, its new text is cut and embedded; the chunks of other documents stay."""
    from loomlake.functions import extensions as ext
    from loomlake.functions.pandas_text import chunk_markdown

    own = ext.HashEmbedder(64)
    docs = op.upsert(writes, ["namespace", "doc_key"], "updated_at", ["document_id", "created_at"]).select("document_id", "content")
    cut = docs.select("document_id", F.explode(chunk_markdown(tokens)("content")).alias("c")).select("document_id", F.col("c.index").alias("seq"), "c.heading", "c.content")
    new = cut.withColumn("embedding", ext.embedded(own)("content")).withColumns({"signature": F.lit(own.signature()), "dim": F.lit(own.dims)})
    return op.without(old, docs, ["document_id"]).unionByName(new)


@query("upsert_chunks", ["doc_writes"])
def upsert_chunks(writes: DataFrame) -> DataFrame:
    """Chunks of a first version for all documents, then of the writes."""
    stale = writes.select("document_id", F.lit(0).alias("seq"), F.lit("").alias("heading"), F.lit("old").alias("content"), F.array(F.lit(0.0)).alias("embedding"), F.lit("old").alias("signature"), F.lit(1).alias("dim"))
    now = rechunked(writes, stale.distinct())
    return now.select("document_id", "seq", "heading", F.md5("content").alias("h"), F.size("embedding").alias("dims"), "signature")


@query("upsert_doc_light", ["doc_writes"], DOC + " select namespace, doc_key, first_id as document_id, first_at as created_at, title, priority, updated_at from r where rn = 1")
def upsert_doc_light(writes: DataFrame) -> DataFrame:
    return op.upsert(writes.drop("content"), ["namespace", "doc_key"], "updated_at", ["document_id", "created_at"]).drop("writes")


@query("kv_upsert", ["kv"], "select namespace, k, arg_max(v, updated_at) as v, max(updated_at) as updated_at from kv group by 1, 2")
def kv_upsert(kv: DataFrame) -> DataFrame:
    return op.latest(kv, ["namespace", "k"], ["updated_at"])


@query("kv_delete", ["kv"], "select namespace, k, count(*) > 0 as deleted from kv where k like 'click%' group by 1, 2")
def kv_delete(kv: DataFrame) -> DataFrame:
    return kv.where(F.col("k").startswith("click")).groupBy("namespace", "k").agg((F.count("*") > 0).alias("deleted"))


@query("graph_upsert", ["triples"], f"""select namespace, {NORM_S.format(c='subject')} as subject, {NORM_P.format(c='predicate')} as predicate, {NORM_S.format(c='object')} as object,
 cast(sum(evidence_count) as bigint) as evidence_count, string_agg(distinct document_id, ',' order by document_id) as document_ids, max(updated_at) as updated_at from triples group by 1, 2, 3, 4""")
def graph_upsert(triples: DataFrame) -> DataFrame:
    # raw triples are merged first, so that few are normalised
    raw = triples.groupBy("namespace", "subject", "predicate", "object").agg(F.sum("evidence_count").alias("e"), F.collect_set("document_id").alias("d"), F.max("updated_at").alias("u"))
    keys = ["namespace", fn.norm_entity("subject").alias("subject"), fn.norm_predicate("predicate").alias("predicate"), fn.norm_entity("object").alias("object")]
    ids = F.array_join(op.merged_set(F.collect_list("d")), ",")
    return raw.groupBy(*keys).agg(F.sum("e").cast("long").alias("evidence_count"), ids.alias("document_ids"), F.max("u").alias("updated_at"))


@query("graph_replace_doc", ["triples"], """select document_id, subject, predicate, object from (
 select distinct document_id, subject, predicate, object from triples where document_id <> 'doc-3' union all select distinct document_id, subject, 'replaced', object from triples where document_id = 'doc-3')""")
def graph_replace_doc(triples: DataFrame) -> DataFrame:
    rows = triples.select("document_id", "subject", "predicate", "object").distinct()
    fresh = rows.where("document_id = 'doc-3'").withColumn("predicate", F.lit("replaced")).distinct()
    return op.replace_for(rows, fresh, ["document_id"])


@query("embedding_upsert", ["vectors"], """select namespace, coalesce(signature, '') as signature, max(id) as id, round(arg_max(list_sum(embedding), id), 4) as total from vectors group by 1, 2""")
def embedding_upsert(vectors: DataFrame) -> DataFrame:
    rows = vectors.select("namespace", F.coalesce("signature", F.lit("")).alias("signature"), "id", "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return op.latest(rows, ["namespace", "signature"], ["id"]).select("namespace", "signature", "id", F.round(total, 4).alias("total"))


@query("entity_index_replace", ["entity_index"], """select entity_id, node_id from entity_index where node_id % 10 <> 0
 union all select distinct 'fresh' || cast(node_id as varchar), node_id from entity_index where node_id % 10 = 0""")
def entity_index_replace(index: DataFrame) -> DataFrame:
    fresh = index.where("node_id % 10 = 0").select(F.concat(F.lit("fresh"), "node_id").alias("entity_id"), "node_id").distinct()
    return op.replace_for(index.select("entity_id", "node_id"), fresh, ["node_id"])


@query("facet_upsert", ["facets"], """select class, facet_key, arg_max(facet_value, confidence * 100000000 + seen) as value, max(confidence) as confidence, count(*) as evidence_count,
 min(seen) as first_seen, max(seen) as last_seen, count(distinct segment_id) as segments from facets group by 1, 2""")
def facet_upsert(facets: DataFrame) -> DataFrame:
    # a value is overwritten by one of at least its confidence: the last of the most confident stays
    value = F.max_by("facet_value", F.struct("confidence", "seen"))
    return facets.groupBy("class", "facet_key").agg(
        value.alias("value"), F.max("confidence").alias("confidence"), F.count("*").alias("evidence_count"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.countDistinct("segment_id").alias("segments")
    )


@query("msg_upsert", ["messages"], """with m as (select max(sec) as now from messages), k as (select account, chat_id, message_id, max(sec) as sec from messages, m where body <> '' and sec >= now - 90 * 86400 group by 1, 2, 3)
 select account, chat_id, count(*) as messages, max(sec) as last_sec from k group by 1, 2""")
def msg_upsert(messages: DataFrame) -> DataFrame:
    now = messages.agg(F.max("sec").alias("now"))
    fresh = messages.where("body <> ''").transform(with_one, now).where(F.col("sec") >= F.col("now") - 90 * 86400)  # one row
    kept = fresh.groupBy("account", "chat_id", "message_id").agg(F.max("sec").alias("sec"))
    return kept.groupBy("account", "chat_id").agg(F.count("*").alias("messages"), F.max("sec").alias("last_sec"))


@query("person_resolve", ["customer"], """with h as (select c_custkey, 'name' as kind, lower(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))) as handle from customer
 union all select c_custkey, 'email', lower('User' || cast(c_custkey % 100 as varchar) || '@Mail.com') from customer) select kind, handle, min(c_custkey) as person, count(*) as claims from h group by 1, 2""")
def person_resolve(customer: DataFrame) -> DataFrame:
    from loomlake.sources.contacts import handles

    # the first writer of a handle owns it
    return handles(customer).groupBy("kind", "handle").agg(F.min("person").alias("person"), F.count("*").alias("claims"))


@query("delete_ns", ["memory_docs"], "select namespace, count(*) as n from memory_docs where namespace <> 'src1' group by 1")
def delete_ns(docs: DataFrame) -> DataFrame:
    return docs.where("namespace <> 'src1'").groupBy("namespace").agg(F.count("*").alias("n"))


@query("delete_doc", ["memory_docs", "chunks"], "select c.id, c.source_id from chunks c where c.id not in (select document_id from memory_docs where priority = 0)")
def delete_doc(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    gone = docs.where("priority = 0").select(F.col("document_id").alias("id"))
    return op.without(chunks, gone, ["id"]).select("id", "source_id")


@query("ledger_diff", ["orders"], """with b as (select o_orderkey as path, o_orderstatus as h from orders where o_orderdate < timestamp '2000-01-01'),
 a as (select o_orderkey as path, case when o_custkey % 10 = 0 then 'X' else o_orderstatus end as h from orders where o_orderkey % 3 > 0)
 select case when path % 7 = 0 then 'unsupported' when b.h is null then 'new' when a.h is null then 'removed' when a.h = b.h then 'unchanged' else 'changed' end as status, count(*) as n
 from b full join a using (path) group by 1""")
def ledger_diff(orders: DataFrame) -> DataFrame:
    path = F.col("o_orderkey").alias("path")
    before = orders.where("o_orderdate < timestamp_ntz '2000-01-01'").select(path, F.col("o_orderstatus").alias("h"))
    after = orders.where("o_orderkey % 3 > 0").select(path, F.when(F.col("o_custkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")).alias("h"))
    return op.ledger_diff(before, after, "path", "h", F.col("path") % 7 != 0)


@query("retention_prune", ["jobs"], "select job_key, job_id, rn from (select job_key, job_id, row_number() over (partition by job_key order by next_run desc, job_id desc) as rn from jobs) where rn <= 5")
def retention_prune(jobs: DataFrame) -> DataFrame:
    return op.newest(jobs.select("job_key", "job_id", "next_run"), ["job_key"], 5, [F.desc("next_run"), F.desc("job_id")]).select("job_key", "job_id", F.col("rn").cast("long").alias("rn"))


@query("ns_migration", ["kv"], """with g as (select distinct split_part(k, 'e', 1) as target, k from kv where namespace = 'global')
 select target, k, not exists (select 1 from kv where kv.namespace <> 'global' and kv.k = g.k and kv.namespace = 'ns1') as moves from g""")
def ns_migration(kv: DataFrame) -> DataFrame:
    rows = kv.where("namespace = 'global'").select(F.split_part("k", F.lit("e"), F.lit(1)).alias("target"), "k").distinct()
    taken = kv.where("namespace = 'ns1'").select("k").distinct().withColumn("taken", F.lit(True))
    return rows.join(taken, "k", "left").select("target", "k", F.col("taken").isNull().alias("moves"))


# filters and paging


@query("param_tag_search", ["chunks"], """select id, source_id, timestamp_ms from (select * from chunks where source_kind = 'email' and timestamp_ms between 1700000000000 and 1800000000000
 order by timestamp_ms desc, id desc limit 100) where list_contains(string_split(tags, ','), 'reply') and list_contains(string_split(tags, ','), 'en')""")
def param_tag_search(chunks: DataFrame) -> DataFrame:
    page = chunks.where("source_kind = 'email' and timestamp_ms between 1700000000000 and 1800000000000").orderBy(F.desc("timestamp_ms"), F.desc("id")).limit(100)
    wanted = F.array(F.lit("reply"), F.lit("en"))
    return page.where(F.size(F.array_except(wanted, F.split("tags", ","))) == 0).select("id", "source_id", "timestamp_ms")  # the limit comes first


@query("raw_chunks", ["chunks"], "select id, source_kind, owner, token_count from chunks where source_id = 'src2' order by timestamp_ms desc limit 100")
def raw_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where("source_id = 'src2'").orderBy(F.desc("timestamp_ms")).limit(100).select("id", "source_kind", "owner", "token_count")


@query("audit_list", ["audit"], "select id, client, tool, success from audit where tool = 'click' and success order by ts_ms desc, id desc limit 50 offset 10")
def audit_list(audit: DataFrame) -> DataFrame:
    return audit.where("tool = 'click' and success").orderBy(F.desc("ts_ms"), F.desc("id")).offset(10).limit(50).select("id", "client", "tool", "success")


@query("msgs_list", ["messages"], "select message_id, chat_id, sec from messages where account = 'acc1' and sec >= 7200 order by sec desc, message_id desc limit 100")
def msgs_list(messages: DataFrame) -> DataFrame:
    return messages.where("account = 'acc1' and sec >= 7200").orderBy(F.desc("sec"), F.desc("message_id")).limit(100).select("message_id", "chat_id", "sec")


@query("msgs_search", ["messages"], "select message_id, chat_id from messages where body ilike '%la%' order by sec desc, message_id desc limit 20")
def msgs_search(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("body").ilike("%la%")).orderBy(F.desc("sec"), F.desc("message_id")).limit(20).select("message_id", "chat_id")


@query("chats_list", ["messages"], "select account, chat_id, count(*) as messages, max(sec) as last_sec from messages group by 1, 2 order by last_sec desc, chat_id limit 50")
def chats_list(messages: DataFrame) -> DataFrame:
    return messages.groupBy("account", "chat_id").agg(F.count("*").alias("messages"), F.max("sec").alias("last_sec")).orderBy(F.desc("last_sec"), "chat_id").limit(50)


@query("events_by_type", ["memory_events"], "select event_id, content, sec from memory_events where namespace = 'ns1' and event_type = 'decision' order by sec desc, event_id desc limit 25")
def events_by_type(events: DataFrame) -> DataFrame:
    return events.where("namespace = 'ns1' and event_type = 'decision'").orderBy(F.desc("sec"), F.desc("event_id")).limit(25).select("event_id", "content", "sec")


@query("due_jobs", ["jobs"], "select job_id, next_run from jobs where enabled and next_run <= 900000000 order by next_run, job_id limit 30")
def due_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where("enabled and next_run <= 900000000").orderBy("next_run", "job_id").limit(30).select("job_id", "next_run")


@query("docs_in_scope", ["memory_docs"], "select document_id, title from memory_docs where namespace = 'src3'")
def docs_in_scope(docs: DataFrame) -> DataFrame:
    return docs.where("namespace = 'src3'").select("document_id", "title")


@query("list_docs", ["memory_docs"], "select document_id, namespace, doc_key, title, priority, category, updated_at from memory_docs")
def list_docs(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", "namespace", "doc_key", "title", "priority", "category", "updated_at")


@query("list_namespaces", ["memory_docs"], "select distinct namespace from memory_docs")
def list_namespaces(docs: DataFrame) -> DataFrame:
    return docs.select("namespace").distinct()


@query("signature_filter", ["vectors"], "select id, namespace from vectors where signature = 'local/hash/64' or (signature is null and dim = 64)")
def signature_filter(vectors: DataFrame) -> DataFrame:
    return vectors.where("signature = 'local/hash/64' or (signature is null and dim = 64)").select("id", "namespace")


@query("noise_filter", ["sentences"], """select doc_id, text from sentences where doc_id % 9 <> 0 and length(trim(text)) >= 20
 and regexp_replace(lower(trim(text)), '[.!?]+$', '') not in ('thanks', 'thank you', 'thx', 'ok cool', 'sounds good', 'got it')""")
def noise_filter(sentences: DataFrame) -> DataFrame:
    useful = sentences.where("doc_id % 9 <> 0")  # tool and system turns
    return useful.where(~fn.is_filler("text")).select("doc_id", "text")


@query("clip_conversation", ["messages"], "select conv_id, turn, role from messages where role <> 'tool'")
def clip_conversation(messages: DataFrame) -> DataFrame:
    return messages.where("role <> 'tool'").select("conv_id", "turn", "role")


@query("dismissed_filter", ["notifications"], "select id, provider from notifications where not is_read")
def dismissed_filter(rows: DataFrame) -> DataFrame:
    return rows.where("not is_read").select("id", "provider")


# set operations


@query("scope_union", ["kv"], "select namespace, k, v, updated_at from kv where namespace = 'ns2' union all select namespace, k, v, updated_at from kv where namespace = 'global'")
def scope_union(kv: DataFrame) -> DataFrame:
    return kv.where("namespace = 'ns2'").unionByName(kv.where("namespace = 'global'"))


@query("set_merge", ["triples"], "select subject, string_agg(distinct document_id, ',' order by document_id) as ids, count(distinct document_id) as n from triples group by 1")
def set_merge(triples: DataFrame) -> DataFrame:
    sets = triples.groupBy("subject").agg(F.array_sort(F.collect_set("document_id")).alias("s"))
    return sets.select("subject", F.array_join("s", ",").alias("ids"), F.size("s").cast("long").alias("n"))


@query("content_dedupe", ["documents"], """with k as (select doc_id, sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g')))) as h from documents)
 select min(doc_id) as doc_id, count(*) as copies, h as content_key from k group by h""")
def content_dedupe(docs: DataFrame) -> DataFrame:
    keyed = docs.select("doc_id", F.sha2(F.lower(fn.collapse_ws("text")), 256).alias("content_key"))
    return keyed.groupBy("content_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("sync_dedupe", ["kv"], """with old as (select namespace, max(updated_at) as cursor, arg_max(k, updated_at) as last_seen from kv where updated_at <= 60 group by 1), new as (select * from kv where updated_at > 100 and updated_at <= 2000),
 head as (select namespace, arg_max(k, updated_at) as newest from new group by 1), live as (select h.namespace, coalesce(cursor, -1) as cursor from head h left join old using (namespace) where last_seen is null or last_seen <> newest)
 select namespace, k, min(updated_at) as first_seen, count(*) as n from new join live using (namespace) where updated_at > cursor and (namespace, k) not in (select namespace, k from kv where updated_at <= 60) group by 1, 2""")
def sync_dedupe(kv: DataFrame) -> DataFrame:
    synced, items = kv.where("updated_at <= 60"), kv.where("updated_at > 100 and updated_at <= 2000")
    return op.unsynced(items, synced, "namespace", "k", "updated_at").groupBy("namespace", "k").agg(F.min("updated_at").alias("first_seen"), F.count("*").alias("n"))


@query("merge_entities", ["entity_index"], "select entity_kind, lower(surface) as surface, node_id, max(score) as importance, count(*) as n from entity_index group by 1, 2, 3")
def merge_entities(index: DataFrame) -> DataFrame:
    return index.groupBy("entity_kind", F.lower("surface").alias("surface"), "node_id").agg(F.max("score").alias("importance"), F.count("*").alias("n"))


@query("chunk_id_idempotent", ["chunks"], r"""select id, substr(sha256(encode(source_kind) || '\x00'::blob || encode(source_id) || '\x00'::blob || unhex(lpad(to_hex(seq), 8, '0')) || '\x00'::blob || encode(content)), 1, 32) as chunk_id from chunks""")
def chunk_id_idempotent(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", fn.chunk_id("source_kind", "source_id", "seq", "content").alias("chunk_id"))


@query("layer_override", ["part"], """with r as (select 'rule' || cast(p_partkey % 40 as varchar) as rule_id, cast(p_partkey % 3 as integer) as layer, p_name as body, p_partkey from part)
 select rule_id, arg_max(body, layer * 1000000 + p_partkey) as body, max(layer) as layer from r group by 1""")
def layer_override(part: DataFrame) -> DataFrame:
    rules = part.select(F.concat(F.lit("rule"), F.col("p_partkey") % 40).alias("rule_id"), (F.col("p_partkey") % 3).cast("int").alias("layer"), F.col("p_name").alias("body"), "p_partkey")
    return op.latest(rules, ["rule_id"], ["layer", "p_partkey"]).select("rule_id", "body", "layer")


@query("counts", ["memory_docs", "entity_index", "vectors"], "select 'docs' as what, count(*) as n from memory_docs union all select 'index', count(*) from entity_index union all select 'vectors', count(*) from vectors")
def counts(docs: DataFrame, index: DataFrame, vectors: DataFrame) -> DataFrame:
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(w).alias("what"), "n") for w, t in (("docs", docs), ("index", index), ("vectors", vectors))]
    return parts[0].union(parts[1]).union(parts[2])


@query("ns_summary", ["memory_docs"], "select namespace, count(*) as n, max(updated_at) as last_updated from memory_docs group by 1")
def ns_summary(docs: DataFrame) -> DataFrame:
    return docs.groupBy("namespace").agg(F.count("*").alias("n"), F.max("updated_at").alias("last_updated"))
