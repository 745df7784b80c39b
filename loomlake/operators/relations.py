"""Facts stated in lines of text, checked against types and resolved by the people that a document names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.functions import text as fn


def people(lines: DataFrame) -> DataFrame:
    """(doc_id, alias, person): full and first names, in upper case, of the people in address headers; of those who
    share a first name the one named first has it."""
    value = F.regexp_extract("line", fn.HEADER, 1)
    named = lines.where(F.col("line").rlike(fn.HEADER)).select("doc_id", "pos", F.posexplode(F.regexp_extract_all(value, F.lit(fn.NAMED_ADDRESS), F.lit(1))).alias("at", "name"))
    named = named.select("doc_id", F.struct("pos", "at").alias("place"), fn.entity_name("name").alias("person")).where("person <> ''")
    both = named.select("doc_id", "place", "person", F.explode(F.array_distinct(F.array("person", F.substring_index("person", " ", 1)))).alias("alias"))
    return both.groupBy("doc_id", "alias").agg(F.min_by("person", "place").alias("person"))


def relations(docs: DataFrame, products: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, subject, subject_type, predicate, object, object_type) of all facts that the rules allow.

    docs has doc_id and text; only lines with a fact or a header are shuffled."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    facts = lines.select("doc_id", F.explode(fn.stated_facts("line")).alias("f")).select("doc_id", "f.*")
    known = people(lines)
    for end in ("subject", "object"):
        alias = known.select("doc_id", F.col("alias").alias(f"{end}_name"), F.col("person").alias(f"{end}_person"))
        facts = facts.withColumn(f"{end}_name", fn.entity_name(end)).join(alias, ["doc_id", f"{end}_name"], "left")
        facts = facts.withColumn(f"{end}_type", fn.entity_type(end, F.col(f"{end}_person").isNotNull(), products))
        facts = facts.withColumn(f"{end}_name", F.when(F.col(f"{end}_type") == "PERSON", F.coalesce(f"{end}_person", f"{end}_name")).otherwise(F.col(f"{end}_name")))
    rules = docs.sparkSession.createDataFrame([(p, *r) for p, r in fn.RELATIONS.items()], "predicate string, canonical string, heads array<string>, tails array<string>")
    met = facts.join(F.broadcast(rules), "predicate")  # a fixed table of rules
    met = met.where("subject_name <> '' and object_name <> '' and subject_name <> object_name and array_contains(heads, subject_type) and array_contains(tails, object_type)")
    return met.select("doc_id", F.col("subject_name").alias("subject"), "subject_type", F.col("canonical").alias("predicate"), F.col("object_name").alias("object"), "object_type")
