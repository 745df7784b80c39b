"""A corpus preparation pipeline of five stages, each on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir). Null ids, sources and texts are allowed: a null text counts as empty, a
null source is a source of its own; an empty table stays empty; columns beyond those used pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm import bpe, mixing, queries, secrets, simhash, toxicity
from loomlake.llm.common import documents, fresh, scratch, spread, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    return toxicity.keep_clean(docs, queries.toxicity_index(docs, spark, sf_dir))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.deduplicated(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark; n_chars follows the text."""
    out = secrets.redacted(docs)
    if "n_chars" not in out.columns:
        return out
    changed = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, those that it repeats twice."""
    _, sizes, _, drawn = queries.source_plan(docs)
    key = mixing.pattern_key(F.array(F.col("source").cast("string")))
    copies = fresh("copies", docs.columns)
    copy = fresh("copy", [*docs.columns, copies])
    taken = mixing.with_copies(docs, drawn, len(sizes), key, mixing.place_of(), copies).where(f"{copies} > 0")
    repeated = taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether the ids decode to the text."""
    return bpe.encode_checked(docs, queries.byte_bpe()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_of_each),
    ("secret_scans", hide_secrets),
    ("source_mixing", mix_sources),
    ("byte_level_bpe", encode_texts),
]

#: No stage but the mix's sizes has an SQL form (nearest examples, Hamming components, redaction by offsets, BPE).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written as Parquet and read as the next one's documents.

    What a stage wrote for itself goes when its result is written, and a result goes when the next one is: the shared
    folder never holds more than two copies of the corpus, and the last one stays for the lazy last stage."""
    docs, before = spread(documents(spark, sf_dir)), None
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as made:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{i}-{name}")
            before, last = made.pop(), before
            if last:
                made.append(last)
    return STAGES[-1][1](spark, docs, sf_dir)
