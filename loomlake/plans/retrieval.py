"""Vector, lexical and hybrid queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.functions.scalars import with_one
from loomlake.functions import vectors as vec
from loomlake.operators import search as op
from loomlake.plans.catalog import query, stand_in
from loomlake.plans.texts import RELATIONS

Q = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
QL = "[" + ", ".join(map(str, Q)) + "]::double[]"
W = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
stand_in("episodes", "select conv_id * 100 + turn as id, conv_id as session_id, role, text, turn as sec from {conversations}")
COS = "list_dot_product(embedding::double[], {q}) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product({q}, {q})))".replace("{q}", QL)


@query("f_cosine", ["embeddings"], f"""select vec_id, round(least(greatest({COS}, 0), 1), 6) as stored, round(least(greatest({COS}, -1), 1), 6) as segment, round({COS}, 6) as rerank from embeddings""")
def f_cosine(rows: DataFrame) -> DataFrame:
    q = F.array(*(F.lit(x) for x in Q))
    kinds = (("stored", 0.0, 1.0), ("segment", -1.0, 1.0), ("rerank", None, None))
    return rows.select("vec_id", *(F.round(vec.cosine("embedding", q, lo, hi), 6).alias(n) for n, lo, hi in kinds))


@query("vec_search", ["vectors"], f"select id, round(least(greatest({COS}, 0), 1), 6) as similarity from vectors where namespace = 'ns3' order by similarity desc, id limit 10")
def vec_search(rows: DataFrame) -> DataFrame:
    return op.vec_search(rows.where("namespace = 'ns3'"), Q, 10)


@query("vec_gate", ["vectors"], f"select id, round(least(greatest({COS}, 0), 1), 6) as similarity from vectors where round(least(greatest({COS}, 0), 1), 6) >= 0.1 order by similarity desc, id limit 200")
def vec_gate(rows: DataFrame) -> DataFrame:
    return op.vec_search(rows, Q, 200, 0.1)


@query("centroid", ["embeddings"], "with e as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) select label, cast(i as integer) as pos, round(avg(x::double), 5) as value from e group by 1, 2")
def centroid(rows: DataFrame) -> DataFrame:
    exploded = rows.select("label", F.posexplode("embedding").alias("p", "x"))
    return exploded.groupBy("label", (F.col("p") + 1).alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("value"))


def _bm25_sql(table: str, key: str, text: str, terms: list[str], tag: str = "", first: str = "with") -> str:
    d = f"{first} r{tag} as (select {key}, {W.format(text)} as w from {table}), c{tag} as (select {key}, len(w) as n, {', '.join(f'len(list_filter(w, lambda x: x = {t!r})) as t{i}' for i, t in enumerate(terms))} from r{tag}),"
    d += f" s{tag} as (select count(*) as total, avg(n) as mean, {', '.join(f'count(*) filter (t{i} > 0) as d{i}' for i in range(len(terms)))} from c{tag}),"
    parts = " + ".join(f"ln(1 + (total - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(terms)))
    return d + f" h{tag} as (select {key}, round({parts}, 6) as score from c{tag}, s{tag} where {' and '.join(f't{i} > 0' for i in range(len(terms)))})"


@query("fts_search", ["documents"], _bm25_sql("documents", "doc_id", "text", ["of", "the"]) + " select doc_id, score from h order by score desc, doc_id limit 50")
def fts_search(docs: DataFrame) -> DataFrame:
    return op.bm25(docs, "doc_id", "text", ["the", "of"]).orderBy(F.desc("score"), "doc_id").limit(50)


@query("fts_join", ["documents"], _bm25_sql("documents", "doc_id", "text", ["for", "the"]) + " select h.doc_id, d.source, d.lang, h.score from h join documents d on d.doc_id = h.doc_id")
def fts_join(docs: DataFrame) -> DataFrame:
    return op.bm25(docs, "doc_id", "text", ["the", "for"]).join(docs.select("doc_id", "source", "lang"), "doc_id")


@query("fts_cross_session", ["episodes"], _bm25_sql("(select * from episodes where session_id <> 0)", "id", "text", ["de"]) + " select id, score from h order by score desc, id limit 50")
def fts_cross_session(rows: DataFrame) -> DataFrame:
    return op.bm25(rows.where("session_id <> 0"), "id", "text", ["de"]).orderBy(F.desc("score"), "id").limit(50)


@query("session_entries", ["episodes"], "select id, role, md5(text) as h from episodes where session_id = 3")
def session_entries(rows: DataFrame) -> DataFrame:
    return rows.where("session_id = 3").select("id", "role", F.md5("text").alias("h"))


@query("intersect_postings", ["part"], "select p_partkey from part where lower(p_name) like '%rin%' and lower(p_name) like '%ing%'")
def intersect_postings(part: DataFrame) -> DataFrame:
    from loomlake.functions.text import ngrams

    grams = part.select("p_partkey", F.explode(F.array_distinct(ngrams(F.lower("p_name")))).alias("g")).where(F.col("g").isin("rin", "ing"))
    return grams.groupBy("p_partkey").agg(F.count("*").alias("n")).where("n = 2").select("p_partkey")


XTHREAD = """with t as (select id, sec, lower(text) as l from episodes), c as (select * from t where (contains(l, 'ent')) or (contains(l, 'tio') and contains(l, 'ion'))), n as (select count(*) as n from c),
 m as (select id, sec, n, (case when contains(l, 'ent') then 1 else 0 end) + (case when contains(l, 'tion') then 1 else 0 end) * 2 as hits from c, n),
 r as (select id, sec, cast(case when n > {guard} then 0 else hits end as integer) as matched from m where n > {guard} or hits > 0)
 select id, matched, round(matched / 3, 6) as score from r order by matched desc, sec desc, id limit 100"""


def _xthread(rows: DataFrame, guard: int) -> DataFrame:
    hits = op.gram_match(rows, "id", "text", "sec", ["ent", "Tion", "tion", "a"], guard=guard)
    return hits.orderBy(F.desc("matched"), F.desc("sec"), "id").limit(100).select("id", "matched", "score")


@query("xthread_search", ["episodes"], XTHREAD.format(guard=10_000))
def xthread_search(rows: DataFrame) -> DataFrame:
    return _xthread(rows, 10_000)


@query("xthread_fallback", ["episodes"], XTHREAD.format(guard=3))
def xthread_fallback(rows: DataFrame) -> DataFrame:
    """More candidates than the guard lets through: the newest ones, unscored."""
    return _xthread(rows, 3)


#: Keyword, vector, graph and freshness of documents, and keyword and freshness of episodes, in one ranking.
HY = (
    _bm25_sql("documents", "doc_id", "text", ["the"]) + ", " + _bm25_sql("episodes", "id", "text", ["de"], "2", "") + f""", rel as ({RELATIONS}),
 sup as (select doc_id, count(*) as n, string_agg(distinct subject || ' -[' || predicate || ']-> ' || object, '; ' order by subject || ' -[' || predicate || ']-> ' || object) as relations from rel group by 1),
 top as (select max(score) as most from h), top2 as (select max(score) as most from h2), last as (select max(doc_id) as now from documents), last2 as (select max(sec) as now from episodes),
 u as (select 'document' as kind, doc_id as id, 'keyword' as branch, score / most as s, 0.35 as w from h, top
 union all select 'document', vec_id, 'vector', least(greatest({COS}, 0), 1), 0.35 from embeddings where vec_id in (select doc_id from documents)
 union all select 'document', doc_id, 'graph', least(n / 2.0, 1), 0.15 from sup union all select 'document', doc_id, 'freshness', 1 / (1 + (now - doc_id) / 24.0), 0.10 from documents, last
 union all select 'episodic', id, 'episodic', score / most, 0.05 from h2, top2 union all select 'episodic', id, 'freshness', 1 / (1 + (now - sec) / 24.0), 0.10 from episodes, last2 where id in (select id from h2)),
 hy as (select kind, id, {', '.join(f"round(max(s) filter (branch = '{b}'), 6) as {b}" for b in ("keyword", "vector", "graph", "episodic", "freshness"))}, round(sum(w * least(greatest(s, 0), 1)) / sum(w), 6) as final, count(*) as signals from u group by 1, 2)"""
)


def _share(hits: DataFrame) -> DataFrame:
    most = hits.agg(F.max("score").alias("most"))  # one row
    return hits.transform(with_one, most).withColumn("score", F.col("score") / F.col("most")).drop("most")


def _hybrid(docs: DataFrame, embeddings: DataFrame, lines: DataFrame, episodes: DataFrame) -> DataFrame:
    """Hits of both kinds with the share of each signal and the relations that support them."""
    from loomlake.functions.text import recency
    from loomlake.operators.relations import relations

    own = docs.select("doc_id")
    q = F.array(*(F.lit(x) for x in Q))
    fact = F.concat("subject", F.lit(" -["), "predicate", F.lit("]-> "), "object")
    # a document states a bounded number of facts: those of its own lines
    support = relations(lines).groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(fact)), "; ").alias("relations"))
    now = own.agg(F.max("doc_id").alias("now"))  # one row
    found = op.hybrid(
        {
            "keyword": _share(op.bm25(docs, "doc_id", "text", ["the"])),
            "vector": embeddings.select(F.col("vec_id").alias("doc_id"), vec.cosine("embedding", q).alias("score")).join(own, "doc_id", "left_semi"),
            "graph": support.select("doc_id", (F.col("n") / 2).alias("score")),
            "freshness": own.transform(with_one, now).select("doc_id", recency((F.col("now") - F.col("doc_id")).cast("double")).alias("score")),
        },
        "doc_id",
    )
    found = found.join(support.select("doc_id", "relations"), "doc_id", "left").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "*").drop("doc_id")
    said = _share(op.bm25(episodes, "id", "text", ["de"]))
    then = episodes.agg(F.max("sec").alias("now"))  # one row
    fresh = episodes.select("id", "sec").join(said.select("id"), "id", "left_semi").transform(with_one, then)
    told = op.hybrid({"episodic": said, "freshness": fresh.select("id", recency((F.col("now") - F.col("sec")).cast("double")).alias("score"))}, "id")
    return found.unionByName(told.withColumn("kind", F.lit("episodic")), allowMissingColumns=True)


@query("hybrid", ["documents", "embeddings", "fact_lines", "episodes"], HY + " select hy.*, sup.relations from hy left join sup on hy.kind = 'document' and sup.doc_id = hy.id")
def hybrid(docs: DataFrame, embeddings: DataFrame, lines: DataFrame, episodes: DataFrame) -> DataFrame:
    return _hybrid(docs, embeddings, lines, episodes)


@query("recall", ["documents", "embeddings", "fact_lines", "episodes"], HY + """, own as (select id, (case when contains(lower(text), 'ent') then 1 else 0 end + case when contains(lower(text), 'tion') then 1 else 0 end) / 2 as score from episodes where session_id = 3),
 a as (select 'document' as kind, hy.id, hy.final as score from hy join documents d on d.doc_id = hy.id where hy.kind = 'document' and final >= 0.1 and d.lang = 'en'
 union all select 'same session', id, score from own where score > 0 union all select 'cross session', h2.id, round(h2.score / most, 6) from h2 join episodes e on e.id = h2.id, top2 where e.session_id <> 3)
 select * from a order by score desc, kind, id limit 25""")
def recall(docs: DataFrame, embeddings: DataFrame, lines: DataFrame, episodes: DataFrame) -> DataFrame:
    """Ranked documents above a floor and of a category, substring hits of the own session, word hits of the others."""
    hits = _hybrid(docs, embeddings, lines, episodes).where("kind = 'document' and final >= 0.1").join(docs.where("lang = 'en'").select(F.col("doc_id").alias("id")), "id")
    terms = ("ent", "tion")
    share = sum((F.contains(F.lower("text"), F.lit(t)).cast("int") for t in terms), F.lit(0)) / len(terms)
    same = episodes.where("session_id = 3").select(F.lit("same session").alias("kind"), "id", share.alias("score")).where("score > 0")
    cross = _share(op.bm25(episodes, "id", "text", ["de"])).join(episodes.where("session_id <> 3").select("id"), "id")
    every = hits.select("kind", "id", F.col("final").alias("score")).union(same).union(cross.select(F.lit("cross session"), "id", F.round("score", 6)))
    return every.orderBy(F.desc("score"), "kind", "id").limit(25)


@query("context_render", ["triples"], """with f as (select distinct namespace, trim(subject) as subject, predicate, object from triples), t as (select namespace, subject || ' (' || case when subject like 'supp %' then 'supplier' else 'topic' end || ') -[' || predicate || ']-> ' || object || ' (' || case when object like 'part %' then 'part' else 'topic' end || ')' as line from f),
 r as (select namespace, line, row_number() over (partition by namespace order by line) as pos, count(*) over (partition by namespace) as facts from t)
 select namespace, facts, md5(string_agg(line, chr(10) order by line)) as context from r where pos <= 200 group by 1, 2""")
def context_render(triples: DataFrame) -> DataFrame:
    """The first 200 facts of a namespace as lines with the types of both ends; a context holds no more."""
    facts = triples.select("namespace", F.trim("subject").alias("subject"), "predicate", "object").distinct()
    types = {"subject": F.when(F.col("subject").startswith("supp "), "supplier").otherwise("topic"), "object": F.when(F.col("object").startswith("part "), "part").otherwise("topic")}
    return op.context(facts, "namespace", types, 200).select("namespace", "facts", F.md5("context").alias("context"))
