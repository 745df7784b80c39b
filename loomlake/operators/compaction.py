"""Rule-driven compaction of tool output: rules are classified by a ranked join, texts are reduced by the chosen rule."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits of the operator.
LEAST_BYTES, MOST_RATIO, MOST_CHARS = 512, 0.95, 1200


def classified(inputs: DataFrame, rules: DataFrame) -> DataFrame:
    """inputs (id, tool, argv0) with the best rule: priority, then a matching program, then rule id; fallback else.

    The rule table is broadcast: it is written by hand, and its size is checked by the session's threshold."""
    match = (F.col("r_tool") == F.col("tool")) | (F.col("r_tool") == "*")
    r = rules.select(F.col("rule_id"), F.col("tool").alias("r_tool"), F.col("argv0").alias("r_argv0"), "priority")
    score = F.col("priority") * 1000 + F.when(F.col("r_argv0") == F.col("argv0"), 100).otherwise(0)
    by_tool = inputs.join(r.where("r_tool <> '*'"), inputs.tool == F.col("r_tool"), "left")
    ranked = by_tool.select(inputs.id, "rule_id", F.when(match, score).alias("score"))
    best = ranked.groupBy("id").agg(F.min_by("rule_id", F.struct(-F.col("score"), "rule_id")).alias("rule_id"), F.max("score").alias("score"))
    return best.select("id", F.coalesce("rule_id", F.lit("fallback")).alias("rule_id"), F.when(F.col("rule_id").isNull(), 0.2).otherwise(0.9).alias("confidence"))


def plain_reduce(text: str, skip: str = "", keep: str = "", most: int = MOST_CHARS) -> str:
    """Lines without skipped ones, only kept ones if any is, adjacent repeats once, middle cut out."""
    lines = [x.rstrip() for x in text.replace("\r\n", "\n").split("\n")]
    if skip:
        lines = [x for x in lines if not re.search(skip, x)]
    if keep:
        lines = [x for x in lines if re.search(keep, x)] or lines
    out: list[str] = []
    for x in lines:
        if not out or out[-1] != x:
            out.append(x)
    body = "\n".join(out).strip()
    if len(body) > most:
        head = most * 7 // 10
        body = body[:head] + "\n… omitted …\n" + body[len(body) - (most - head) :]
    return body


def compacted(rows: DataFrame) -> DataFrame:
    """rows (id, text, skip, keep) with the reduced text where it is large enough and reduction pays."""

    @F.pandas_udf("string")
    def reduce(text: pd.Series, skip: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else plain_reduce(t, s or "", k or "") for t, s, k in zip(text, skip, keep)])

    tried = rows.withColumn("reduced", F.when(F.octet_length("text") >= LEAST_BYTES, reduce("text", "skip", "keep")))
    pays = F.length("reduced") <= MOST_RATIO * F.length("text")
    return tried.select("id", F.length("text").alias("raw_chars"), F.when(pays, F.col("reduced")).otherwise(F.col("text")).alias("text"), F.coalesce(pays, F.lit(False)).alias("compacted"))
