"""Relationship scores, profile facets, stability and budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Weights of cue families, state thresholds and places by class.
CUE_WEIGHTS = {"explicit": 1.0, "structural": 0.9, "behavioral": 0.7, "recurrence": 0.6}
STATES = ((1.5, "active"), (0.7, "provisional"), (0.4, "candidate"))
PLACES = {"style": 4, "identity": 4, "tooling": 5, "veto": 3, "goal": 3, "channel": 1}
OVERFLOW = 5


def person_scores(interactions: DataFrame, now: Column, half_life_days: float = 14, window_days: int = 30, often: float = 50, deep: float = 500) -> DataFrame:
    """Recency, frequency, reciprocity and depth, each within 0 and 1, and their product; one aggregation."""
    age = (now - F.col("sec")) / 86_400.0
    recent = age <= window_days
    by = interactions.groupBy("person_id").agg(
        F.max("sec").alias("last"),
        F.count_if(recent).alias("n"),
        F.count_if(F.col("is_outbound")).alias("sent"),
        F.count_if(~F.col("is_outbound")).alias("got"),
        F.avg("length").alias("mean"),
    )

    def unit(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))

    most = F.greatest("sent", "got")
    parts = {
        "recency": unit(F.exp(-((now - F.col("last")) / 86_400.0) * math.log(2) / half_life_days)),
        "frequency": unit(F.col("n") / often),
        "reciprocity": F.when(most == 0, 0.0).otherwise(F.least("sent", "got") / most),
        "depth": unit(F.col("mean") / deep),
    }
    score = parts["recency"] * parts["frequency"] * parts["reciprocity"] * parts["depth"]
    return by.select("person_id", *(F.round(c, 6).alias(k) for k, c in parts.items()), F.round(score, 6).alias("score"))


def stability(facets: DataFrame, now: Column, life_days: float = 30) -> DataFrame:
    """Sum over cue families of weight, decay since the family's last cue, and log of its cues; explicit cues double it."""
    families = facets.groupBy("class", "facet_key", "cue").agg(F.max("sec").alias("last"), F.count("*").alias("n"))
    weight = F.create_map(*(F.lit(x) for pair in CUE_WEIGHTS.items() for x in pair))[F.col("cue")]
    part = weight * F.exp(-((now - F.col("last")) / 86_400.0) / life_days) * F.log(1 + F.col("n"))
    sums = families.groupBy("class", "facet_key").agg(F.sum(part).alias("s"), F.bool_or(F.col("cue") == "explicit").alias("explicit"))
    return sums.select("class", "facet_key", F.round(F.col("s") * F.when(F.col("explicit"), 2).otherwise(1), 6).alias("stability"))


def budgeted(stable: DataFrame) -> DataFrame:
    """States by threshold, places by class, and a few more places for the best of the rest."""
    state = F.lit("dropped")
    for limit, name in reversed(STATES):
        state = F.when(F.col("stability") >= limit, name).otherwise(state)
    places = F.create_map(*(F.lit(x) for pair in PLACES.items() for x in pair))[F.col("class")]
    order = (F.desc("stability"), F.col("facet_key"))
    ranked = stable.withColumn("rn", F.row_number().over(Window.partitionBy("class").orderBy(*order)))
    ranked = ranked.withColumn("placed", F.col("rn") <= places)
    rest = ranked.where("not placed").orderBy(F.desc("stability"), "class", "facet_key").limit(OVERFLOW).select("class", "facet_key", F.lit(True).alias("extra"))
    out = ranked.join(F.broadcast(rest), ["class", "facet_key"], "left")  # at most OVERFLOW rows
    return out.select("class", "facet_key", "stability", state.alias("state"), (F.col("placed") | F.coalesce("extra", F.lit(False))).alias("kept"))
