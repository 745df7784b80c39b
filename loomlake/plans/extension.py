"""Queries over the extension points with their defaults, and intake limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomlake.functions import extensions as ext
from loomlake.functions import vectors
from loomlake.memory import Memory
from loomlake.operators import trees
from loomlake.plans.catalog import query
from loomlake.plans.streams import stream
from loomlake.plans.texts import ENTITIES
from loomlake.streaming import jobs


@query("summarise_llm", ["summaries"], "select parent_id, substr(string_agg('— ' || trim(content), chr(10) || chr(10) order by id, content), 1, 400) as summary from summaries group by 1")
def summarise_llm(summaries: DataFrame) -> DataFrame:
    # a caller's model goes where the deterministic default stands
    pairs = summaries.select("parent_id", F.struct("id", "content").alias("at"), "content")
    return ext.summarised(pairs, "parent_id", "at", "content", 100, trees.summary_of)


@query("embed_default", ["sentences"], "select doc_id, 32 as dims, case when regexp_matches(text, '\\S') then 1.0 else 0.0 end::double as norm, 'local/hash/32' as signature from sentences")
def embed_default(rows: DataFrame) -> DataFrame:
    own = ext.HashEmbedder(32)
    made = rows.select("doc_id", ext.embedded(own)("text").alias("v"))
    return made.select("doc_id", F.size("v").alias("dims"), F.round(vectors.norm("v"), 6).alias("norm"), F.lit(own.signature()).alias("signature"))


@query("extract_default", ["sentences"], ENTITIES + "select distinct doc_id, kind, surface from e")
def extract_default(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.explode(ext.extracted("text")).alias("e")).select("doc_id", "e.kind", "e.surface")


@query("memory_list", ["memory_docs"], "select namespace, doc_key as key, arg_max(category, updated_at) as category, max(updated_at) as updated_at from memory_docs group by 1, 2")
def memory_list(docs: DataFrame) -> DataFrame:
    memory = Memory(docs.withColumnRenamed("doc_key", "key"))
    return memory.list().select("namespace", "key", "category", "updated_at")


@query("st_rate_limit", ["usage"], """with r as (select session_id, id, sec, row_number() over (partition by session_id order by sec, id) as rn from usage)
 select session_id, id, rn * 60 + max(sec - rn * 60) over (partition by session_id order by rn) - sec as wait from r""")
def st_rate_limit(usage: DataFrame) -> DataFrame:
    """One call a minute and endpoint: a call goes a minute after the one before it or at once, whichever is later."""
    w = Window.partitionBy("session_id").orderBy("sec", "id")
    ranked = usage.select("session_id", "id", "sec", F.row_number().over(w).alias("rn"))
    start = F.col("rn") * 60 + F.max(F.col("sec") - F.col("rn") * 60).over(Window.partitionBy("session_id").orderBy("rn"))
    return ranked.select("session_id", "id", (start - F.col("sec")).cast("long").alias("wait"))


@stream("st_ingest_queue", "select event_type, count(*) as n from events group by 1")
def st_ingest_queue(spark: SparkSession, events: DataFrame) -> DataFrame:
    # files a trigger bound what is in flight: nothing is dropped when the queue is full
    return jobs.drained(events.select("event_type")).groupBy("event_type").agg(F.count("*").alias("n"))
