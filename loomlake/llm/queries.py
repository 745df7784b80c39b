"""The queries of the corpus operators: thin digests over the operators' real outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm.common import documents, held_out, n_words, spread


def op1_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm import lm

    scored, totals = lm.score(documents(spark, sf_dir), ~held_out("doc_id", 7, 2))
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out("id", 7, 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(totals["tokens"]).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm import rules

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    found, _ = rules.judged(spread(documents(spark, sf_dir)), labels)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select(F.col("id").alias("doc_id"), *counts, "base_failed", "kept", "rule")


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm import flac

    return flac.digests(flac.encode(spread(documents(spark, sf_dir)))).withColumnRenamed("id", "doc_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm import secrets

    found = secrets.with_spans(spread(documents(spark, sf_dir)), keep=["doc_id"])
    base = F.col("secret_spans.base")

    def number(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(number(k) for k in secrets.KINDS[:3]),
        F.sha2(secrets.spelled(base), 256).alias("base_sha256"),
        secrets.spelled(F.col("secret_spans.all")).alias("spans"),
    )


def source_plan(docs: DataFrame):
    """Rows (id, key, size, bucket), sizes and targets by key, and what is drawn, by repeating source weights."""
    from loomlake.llm import mixing

    rows = mixing.sized(docs, F.array(F.col("source").cast("string")), n_words("text"))
    sizes = mixing.totals(rows)
    targets = mixing.weighted_quotas(sizes)
    return rows, sizes, targets, mixing.draw(rows, sizes, {mixing.members_of(k)[0]: round(t) for k, t in targets.items()})


def source_mix(docs: DataFrame) -> DataFrame:
    """id, key, size, bucket, copies, source_size and target of each document."""
    from loomlake.llm import mixing

    rows, sizes, targets, drawn = source_plan(docs)
    mixed = mixing.with_copies(rows, drawn, len(sizes), F.col("key"), F.col("bucket"))
    of_source = docs.sparkSession.createDataFrame(
        [(k, sizes[k], float(targets[k])) for k in sizes], "key string, source_size long, target double"
    )
    return mixed.join(mixing.small(of_source, len(sizes)), "key")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op6_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loomlake.llm import huffman

    coded, book = huffman.write(spread(documents(spark, sf_dir)), public_tokenizers.path("word_bpe_49k.json"))
    return huffman.read(coded, book, with_tokens=False).withColumnRenamed("id", "doc_id")


def byte_bpe():
    import public_tokenizers

    from loomlake.llm.bpe import ByteBpe

    return ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm import bpe

    own = byte_bpe()
    return bpe.digests(bpe.encode(spread(documents(spark, sf_dir)), own), own).withColumnRenamed("id", "doc_id")


def toxicity_index(docs: DataFrame, spark: SparkSession, sf_dir: str):
    from loomlake.llm import toxicity

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 5, 0))
    return toxicity.fit(docs, labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm import toxicity

    docs = spread(documents(spark, sf_dir))
    found = toxicity.score(docs, toxicity_index(docs, spark, sf_dir))
    evidence = F.array_join(F.transform("evidence", lambda e: e["example"].cast("string")), ",").alias("nearest")
    return found.select(
        F.col("id").alias("doc_id"), held_out("id", 5, 0).alias("held_out"), "score", "predicted", evidence
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm.simhash import near_duplicates

    found = near_duplicates(spread(documents(spark, sf_dir)))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm import pii

    docs = spread(documents(spark, sf_dir))
    found = pii.scan(docs, pii.fit(docs))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def spelled(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        F.col("id").alias("doc_id"),
        *(number(k) for k in pii.KINDS),
        F.sha2(spelled("base"), 256).alias("base_sha256"),
        spelled("spans").alias("spans"),
    )


QUERIES = {
    "op1_backoff_lm": op1_backoff_lm,
    "op2_quality_rules": op2_quality_rules,
    "op3_flac": op3_flac,
    "op4_secrets": op4_secrets,
    "op5_mixing": op5_mixing,
    "op6_huffman": op6_huffman,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {}
