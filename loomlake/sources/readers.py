"""Scans: JSON lines, folders, mail threads, chat and document batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parsed_lines(lines: DataFrame, text: str, schema: str) -> DataFrame:
    """Rows of JSON texts: blank and malformed lines are skipped, never fatal."""
    full = lines.where(F.trim(text) != "")
    read = full.select(F.from_json(text, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    return read.where("x._bad is null and x is not null").select("x.*").drop("_bad")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parsed_lines(spark.read.text(path), "value", schema)


def dir_walk(spark: SparkSession, path: str, include: str = "*", extensions: tuple[str, ...] = ()) -> DataFrame:
    """(path, bytes, mtime, digest, supported) of a folder's files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", include).option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    supported = ext.isin(*extensions) if extensions else F.lit(True)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("digest"), supported.alias("supported"))


def transcript(rows: DataFrame, key: str, order: str, author: str, text: Column) -> DataFrame:
    """(key, markdown): messages in order under `## order — author` headings."""
    line = F.concat(F.lit("## "), F.col(order).cast("string"), F.lit(" — "), F.col(author), F.lit("\n"), text)
    lines = F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line"))))
    by = rows.groupBy(key).agg(lines.alias("l"))
    return by.select(key, F.concat(F.lit("# Chat transcript\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("markdown"))


def document_time(stamp: Column, now: Column) -> Column:
    """Epoch milliseconds from a number, a numeric text or an ISO text; now if none reads."""
    text = stamp.cast("string")
    iso = F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return F.coalesce(F.when(text.rlike("^[0-9]+$"), text.cast("long")), iso, now)


def split_messages(markdown: Column) -> Column:
    """Parts of a response that holds several messages, cut at rules and second or third headings."""
    return F.filter(F.transform(F.split(markdown, r"\n(?:---\n|(?=#{2,3} ))"), lambda p: F.trim(p)), lambda p: p != "")


def verified_messages(markdown: Column, subjects: Column) -> Column:
    """The parts of a response that belong to messages of known subjects, in order; null if their numbers differ or a
    part doesn't name its subject, for then no part can be trusted."""
    parts = split_messages(markdown)
    named = F.zip_with(parts, subjects, lambda p, s: F.contains(F.lower(p), F.lower(s)))
    return F.when((F.size(parts) == F.size(subjects)) & F.forall(named, lambda x: F.coalesce(x, F.lit(False))), parts)


def write_if_new(rows: DataFrame, path: str) -> DataFrame:
    """Writes once; a later call leaves the files alone. The result is what is stored, with whether each digest holds."""
    rows.withColumn("sha", F.sha2("content", 256)).write.mode("ignore").parquet(path)
    stored = rows.sparkSession.read.parquet(path)
    return stored.withColumn("intact", F.sha2("content", 256) == F.col("sha"))
