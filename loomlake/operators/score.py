"""The admission score of chunks: one projection of built-ins over chunks and their entity counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions.text import entities

# Weights of the signals, of metadata kinds and of sources; limits of the gate.
WEIGHTS = {"token": 1.0, "diversity": 1.0, "metadata": 1.5, "source": 1.5, "interaction": 3.0, "density": 1.0}
LLM_WEIGHT = 2.0
KIND = {"email": 0.8, "document": 0.9, "chat": 0.5}
SOURCE_KIND = {"email": 0.75, "document": 0.7, "chat": 0.5}
PROVIDERS = {"gmail": 0.8, "other_email": 0.7, "whatsapp": 0.75, "telegram": 0.6, "discord": 0.5, "notion": 0.75, "drive_docs": 0.6, "meeting_notes": 0.85}
TAGS = {"sent": 0.6, "reply": 0.5, "dm": 0.3, "mention": 0.2}
KEEP, LEAST_TOKENS = 0.3, 10
OPEN = (0.15, 0.85)


def _lookup(table: dict[str, float], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def token_signal(n: Column) -> Column:
    """0 below 10, up to 1 at 30, 1 to 3000, down to 0.5 at 8000."""
    return F.when(n < 10, 0.0).when(n < 30, (n - 10) / 20.0).when(n <= 3000, 1.0).when(n < 8000, 1 - 0.5 * (n - 3000) / 5000.0).otherwise(0.5)


def diversity_signal(words: Column) -> Column:
    """Share of distinct words, 0 at 0.3 and 1 at 0.7; half below five words."""
    ratio = F.size(F.array_distinct(words)) / F.size(words)
    return F.when(F.size(words) < 5, 0.5).otherwise(F.least(F.greatest((ratio - 0.3) / 0.4, F.lit(0.0)), F.lit(1.0)))


def interaction_signal(tags: Column) -> Column:
    total = sum((F.when(F.array_contains(tags, t), w).otherwise(0.0) for t, w in TAGS.items()), F.lit(0.0))
    return F.when(total == 0, 0.5).otherwise(F.least(total, F.lit(1.0)))


def spoken(kind: str | Column, content: str | Column) -> Column:
    """A chat's content without the headings that canonicalising put between its messages; other kinds as they are."""
    kind, content = (F.col(x) if isinstance(x, str) else x for x in (kind, content))
    lines = F.filter(F.split(content, "\n"), lambda s: ~(s.startswith("# Chat transcript") | s.startswith("## ")))
    return F.when(kind == "chat", F.array_join(lines, "\n")).otherwise(content)


def n_entities(text: str | Column) -> Column:
    """Distinct entities of all kinds in a text."""
    return F.size(F.array_distinct(entities(text)))


def scored(chunks: DataFrame, llm: Column | None = None) -> DataFrame:
    """chunks (id, source_kind, content, token_count, tags array, n_entities) with signals, total, verdict and reason.

    llm is a model's rating, asked only where the cheap signals leave the verdict open."""
    words = F.filter(F.split(F.lower(spoken("source_kind", "content")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    provider = F.regexp_extract(F.array_join("tags", ","), r"(?:^|,)provider:([a-z_]+)", 1)
    tagged = chunks.withColumn("w", words)
    n = F.col("token_count")
    signals = {
        "token": token_signal(n),
        "diversity": diversity_signal(F.col("w")),
        "metadata": _lookup(KIND, F.col("source_kind")),
        "source": F.coalesce(_lookup(PROVIDERS, provider), _lookup(SOURCE_KIND, F.col("source_kind"))),
        "interaction": interaction_signal(F.col("tags")),
        "density": F.when(n > 0, F.least(F.col("n_entities") / n / 0.01, F.lit(1.0))).otherwise(0.0),
    }
    rated = tagged.select("id", n.alias("tokens"), "n_entities", *(F.round(s, 6).alias(k) for k, s in signals.items()), *([llm.alias("llm")] if llm is not None else []))
    parts, whole = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)), F.lit(sum(WEIGHTS.values()))
    cheap = F.least(F.greatest(parts / whole, F.lit(0.0)), F.lit(1.0))
    total = cheap
    if llm is not None:
        total = F.when((cheap > OPEN[0]) & (cheap < OPEN[1]), (parts + LLM_WEIGHT * F.col("llm")) / (whole + LLM_WEIGHT)).otherwise(cheap)
    short = (F.col("tokens") < LEAST_TOKENS) & (F.col("n_entities") == 0)
    rated = rated.withColumn("total", F.round(total, 6))
    reason = F.when(short, "short and without entities").when(F.col("total") < KEEP, "below threshold").otherwise("")
    return rated.withColumn("reason", reason).withColumn("kept", F.col("reason") == "").drop("llm")
