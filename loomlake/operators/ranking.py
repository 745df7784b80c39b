"""Ordered and ranked operators: rolling shifts, cooldowns, overlap ranks, pages with totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from loomlake.functions.scalars import with_one
from loomlake.operators.passes import ordered_pass


def rolling_shift(turns: DataFrame, size: int = 15, limits: Sequence[tuple[float, str]] = ((0.3, "terse"), (0.5, "short"), (0.8, "brief"))) -> DataFrame:
    """First turn at which the mean length ratio of the last turns falls below a limit of the ones before."""
    w = Window.partitionBy("session_id").orderBy("turn")
    ratio = F.col("user_len") / F.col("agent_len")
    seen = turns.select(
        "session_id", "turn", F.row_number().over(w).alias("n"), F.avg(ratio).over(w.rowsBetween(1 - size, 0)).alias("now"), F.avg(ratio).over(w.rowsBetween(1 - 2 * size, -size)).alias("before")
    ).where(F.col("n") >= 2 * size)
    value = F.lit(None).cast("string")
    for limit, name in reversed(limits):
        value = F.when(F.col("now") / F.col("before") < limit, name).otherwise(value)
    return seen.select("session_id", "turn", value.alias("value")).where("value is not null").groupBy("session_id", "value").agg(F.min("turn").alias("turn"))


# What users say to correct an answer and the style that it asks for; seconds after an answer in which it
# counts, seconds between two signals of a style, and the repeat that turns into a veto.
CORRECTIONS = (
    ("shorter", "verbosity", "terse"), ("too long", "verbosity", "terse"), (" less ", "verbosity", "terse"), ("just code", "format", "code-only"),
    ("not bullets", "format", "prose"), ("more detail", "verbosity", "detailed"), ("more verbose", "verbosity", "detailed"),
)
EDIT_WINDOW, COOLDOWN, VETO_REPEAT = 30, 300, 3


def corrections(turns: DataFrame) -> DataFrame:
    """(session_id, turn, class, key, value) of turns (session_id, turn, sec, role, body): the style that a user's words
    soon after an answer ask for, at most once in COOLDOWN seconds, and a veto at the third time, once."""
    before = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    answered = F.max_by(F.when(F.col("role") == "assistant", F.col("sec")), F.when(F.col("role") == "assistant", F.col("turn"))).over(before)
    soon = turns.withColumn("gap", F.col("sec") - answered).where(f"role = 'user' and gap >= 0 and gap < {EDIT_WINDOW}")
    low = F.lower("body")
    cues = [F.when(low.contains(p), F.struct(F.lit(i).alias("at"), F.lit(k).alias("key"), F.lit(v).alias("value"))) for i, (p, k, v) in enumerate(CORRECTIONS)]
    hits = soon.select("session_id", "turn", "sec", F.explode(F.filter(F.array(*cues), lambda x: x.isNotNull())).alias("c")).select("session_id", "turn", "sec", "c.*")
    hits = hits.withColumn("cue", F.concat_ws("|", F.col("session_id").cast("string"), "key", "value"))

    def step(last, row):
        now = row[2]
        go = last is None or now - last >= COOLDOWN
        return (now if go else last), (go,)

    told = ordered_pass(hits, "cue", ["turn", "at"], step, lambda: None, [T.StructField("told", T.BooleanType())])
    nth = F.row_number().over(Window.partitionBy("cue").orderBy("turn", "at"))
    rows = told.withColumn("nth", nth).select(
        "session_id", "turn", "key", "value", F.explode(F.filter(F.array(F.when(F.col("told"), "style"), F.when(F.col("nth") == VETO_REPEAT, "veto")), lambda x: x.isNotNull())).alias("class")
    )
    return rows.select("session_id", "turn", "class", "key", "value")


def _overlap(words: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_intersect(words, F.array(*(F.lit(w) for w in wanted))))


def tool_rank(tools: DataFrame, verb: str, wanted: Sequence[str], bonus: str, n: int) -> DataFrame:
    """Token overlap behind a verb gate, with a bonus; stable by id."""
    score = _overlap(F.split("words", " "), wanted) + F.col("words").contains(bonus).cast("int")
    return tools.where(F.col("verb") == verb).select("tool_id", score.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "tool_id").limit(n)


def experience_rank(rows: DataFrame, tools: Sequence[str], tags: Sequence[str], agent: str, n: int) -> DataFrame:
    """Confidence, shared tools and tags, same agent; ties by update, then id."""
    t, g = _overlap(F.split("tools", " "), tools), _overlap(F.split("tags", " "), tags)
    score = 0.2 * F.col("confidence") + F.when(t > 0, 3 + 0.5 * t).otherwise(0) + F.when(g > 0, 2 + 0.25 * g).otherwise(0) + (F.col("agent") == agent).cast("int")
    scored = rows.select("id", "updated", F.round(score.cast("double"), 6).alias("score"))
    return scored.orderBy(F.desc("score"), F.desc("updated"), "id").limit(n).select("id", "score")


def response(hits: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First hits with the number of all and whether some are left out; the count is its own aggregation, no global window."""
    total = hits.agg(F.count("*").alias("total"))  # one row
    return hits.orderBy(*order).limit(n).transform(with_one, total).withColumn("truncated", F.col("total") > n)
