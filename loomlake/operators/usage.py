"""Cost, usage and interface aggregations. The latest day in the data stands for today, never the wall clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomlake.functions.scalars import with_one


def last_day(usage: DataFrame) -> DataFrame:
    """One row with the latest day."""
    return usage.agg(F.max("day").alias("last_day"))


def calendar(usage: DataFrame, days: int) -> DataFrame:
    """The days consecutive days that end with the latest one; days is clamped to 1..366."""
    days = min(max(days, 1), 366)
    span = F.sequence(F.date_sub("last_day", days - 1), F.col("last_day"))
    return last_day(usage).select(F.explode(span).alias("day"))


def daily_history(usage: DataFrame, days: int) -> DataFrame:
    """Costs and tokens by day and model with gaps filled; a day without usage has one row of zeros."""
    sums = usage.groupBy("day", "model").agg(
        F.sum("cost_usd").alias("cost"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.count("*").alias("requests"),
    )
    full = calendar(usage, days).join(sums, "day", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens", "requests")]
    return full.select("day", F.coalesce("model", F.lit("")).alias("model"), F.round(F.coalesce("cost", F.lit(0.0)), 4).alias("cost"), *zero)


def dashboard(usage: DataFrame, monthly_limit: float, warn: float) -> DataFrame:
    """Week total, average, 30-day pace, month to date, clamped utilisation and status."""
    dated = usage.transform(with_one, last_day(usage))  # one row
    month = F.trunc("day", "month") == F.trunc("last_day", "month")
    sums = dated.agg(
        F.round(F.coalesce(F.sum(F.when(F.col("day") > F.date_sub("last_day", 7), F.col("cost_usd"))), F.lit(0.0)), 4).alias("week_total"),
        F.round(F.coalesce(F.sum(F.when(month, F.col("cost_usd"))), F.lit(0.0)), 4).alias("month_to_date"),
    )
    spent = F.col("month_to_date")
    status = F.when(spent >= monthly_limit, "alert").when(spent >= monthly_limit * warn, "warn").otherwise("ok")
    return sums.select(
        "week_total",
        F.round(F.col("week_total") / 7, 4).alias("daily_average"),
        F.round(F.col("week_total") / 7 * 30, 4).alias("monthly_pace"),
        "month_to_date",
        F.round(F.least(F.greatest(spent / monthly_limit, F.lit(0.0)), F.lit(1.0)), 6).alias("utilization"),
        status.alias("status"),
    )


def by_model(usage: DataFrame) -> DataFrame:
    """Sums and share of the whole by model; the provider stands before the first slash."""
    sums = usage.groupBy("model").agg(
        F.sum("cost_usd").alias("c"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.count("*").alias("requests")
    )
    whole = sums.agg(F.sum("c").alias("total"))  # one row
    percent = F.when(F.col("total") == 0, 0.0).otherwise(100 * F.col("c") / F.col("total"))
    return sums.transform(with_one, whole).select(
        "model", F.split_part("model", F.lit("/"), F.lit(1)).alias("provider"), F.round("c", 4).alias("cost"), "total_tokens", "requests", F.round(percent, 4).alias("percent")
    )


def budget(usage: DataFrame, projected: float, daily: float, monthly: float, warn: float) -> DataFrame:
    """Daily limit, then monthly limit, then the warning shares, for each session and day."""
    month = (F.year("day") * 100 + F.month("day")).alias("ym")
    days = usage.groupBy("session_id", "day", month).agg(F.sum("cost_usd").alias("d"))
    days = days.withColumn("m", F.sum("d").over(Window.partitionBy("session_id", "ym")))
    d, m = F.col("d") + projected, F.col("m") + projected
    verdict = (
        F.when(d > daily, "exceeded_daily").when(m > monthly, "exceeded_monthly").when(d >= daily * warn, "warning_daily").when(m >= monthly * warn, "warning_monthly")
    )
    return days.select("session_id", "day", F.round("d", 4).alias("day_cost"), F.round("m", 4).alias("month_cost"), verdict.otherwise("allowed").alias("verdict"))


def tool_stats(calls: DataFrame, keep: int = 5, width: int = 80) -> DataFrame:
    """Calls, outcomes, mean duration and the last distinct error prefixes in order of first appearance."""
    stats = calls.groupBy("tool").agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failure"), F.round(F.avg("duration_ms"), 4).alias("mean_ms")
    )
    errors = calls.where("not ok").groupBy("tool", F.substring("message", 1, width).alias("msg")).agg(F.min("seq").alias("first"))
    ranked = errors.withColumn("rn", F.row_number().over(Window.partitionBy("tool").orderBy(F.desc("first")))).where(F.col("rn") <= keep)
    last = ranked.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("first", "msg"))).alias("e"))  # at most keep each
    joined = F.array_join(F.transform("e", lambda x: x["msg"]), "|")
    return stats.join(last, "tool", "left").select("tool", "calls", "success", "failure", "mean_ms", F.coalesce(joined, F.lit("")).alias("last_errors"))


def compaction(texts: DataFrame, by: str) -> DataFrame:
    """Characters before and after, and their ratio."""
    sums = texts.groupBy(by).agg(F.sum(F.length("raw")).alias("raw_chars"), F.sum(F.length("reduced")).alias("reduced_chars"))
    return sums.withColumn("ratio", F.round(F.col("reduced_chars") / F.col("raw_chars"), 6))


def heatmap(usage: DataFrame, days: int) -> DataFrame:
    """Events by day with an intensity level and the weekday (Sunday is 0)."""
    counts = usage.groupBy("day").agg(F.count("*").alias("c"))
    n = F.coalesce("c", F.lit(0))
    level = F.when(n == 0, 0).when(n == 1, 1).when(n <= 3, 2).when(n <= 6, 3).otherwise(4)
    return calendar(usage, days).join(counts, "day", "left").select("day", n.alias("n"), level.alias("level"), (F.dayofweek("day") - 1).alias("weekday"))


def age_buckets(usage: DataFrame) -> DataFrame:
    age = F.date_diff("last_day", "day")
    bucket = F.when(age == 0, "TODAY").when(age == 1, "YESTERDAY").when(age < 7, "THIS WEEK").otherwise("OLDER")
    # days are aggregated first, so the one-row side meets few rows
    return usage.groupBy("day").agg(F.count("*").alias("c")).transform(with_one, last_day(usage)).groupBy(bucket.alias("bucket")).agg(F.sum("c").alias("n"))
