"""Structured Streaming twins of the stateful steps.

Each takes a stream and gives a stream; `drained` runs one to the end of its input and returns what it wrote to the
shared folder, so a query can be compared with its batch form. Deduplication state is bounded by a watermark, a
deliberate difference from an unbounded set of ids.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.streaming import StatefulProcessor

from loomlake.functions.scalars import with_one
from loomlake.session import fresh_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream, one file a micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All output up to the end of the present input; in complete mode the last state.

    A micro-batch has a folder by its number, so one that is tried again replaces what it wrote before."""
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-state")
    spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema)).write.parquet(f"{out}/batch=-1")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:  # a query keeps the settings that it starts with
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    query.awaitTermination()
    folders = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(folders).parquet(out).drop("batch")


def timed(events: DataFrame, late: str) -> DataFrame:
    """Event time with a watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    return timed(events, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Tumbling counts and sums by type."""
    by = timed(events, late).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    by = timed(events, late).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return by.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


class BucketSeal(StatefulProcessor):
    """Per key: values add up in order; a bucket seals when the sum reaches the budget, or when it is older than age_ms
    at the next value or, without one, at the watermark."""

    COLUMNS = ("user_id", "grp", "n", "total", "reason")

    def __init__(self, budget: float, age_ms: int):
        self.budget, self.age = budget, age_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "grp long, held double, n long, since long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        grp, held, n, since = self.state.get() if self.state.exists() else (0, 0.0, 0, 0)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        out = []
        frame = pd.concat(list(rows)).sort_values("event_id")
        for value, at in zip(frame["value"], frame["at"]):
            now = int(at.timestamp() * 1000)
            if n and now - since > self.age:
                out.append((key[0], grp, n, round(held, 4), "age"))
                grp, held, n = grp + 1, 0.0, 0
            since = since if n else now
            held, n = held + float(value), n + 1
            if held >= self.budget:
                out.append((key[0], grp, n, round(held, 4), "size"))
                grp, held, n = grp + 1, 0.0, 0
        self.state.update((grp, held, n, since))
        if n:
            self.handle.registerTimer(since + self.age)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        grp, held, n, since = self.state.get()
        self.state.update((grp + 1, 0.0, 0, since))
        yield pd.DataFrame([(key[0], grp, n, round(held, 4), "age")] if n else [], columns=self.COLUMNS)

    def close(self) -> None:
        pass


class Ring(StatefulProcessor):
    """Per key the newest items; what falls out is counted."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle) -> None:
        self.state = handle.getValueState("ring", "items array<long>, dropped long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        items, dropped = self.state.get() if self.state.exists() else ([], 0)
        held = sorted([*items, *(int(x) for x in pd.concat(list(rows))["event_id"])])
        dropped += max(0, len(held) - self.size)
        held = held[-self.size :]
        self.state.update((held, dropped))
        yield pd.DataFrame([(key[0], held[0], len(held), dropped)], columns=["user_id", "oldest", "n", "dropped"])

    def close(self) -> None:
        pass


class Segments(StatefulProcessor):
    """Per key: a segment ends before a turn that would be one too many, comes after a gap, or carries a marker."""

    def __init__(self, most: int, gap_ms: int):
        self.most, self.gap = most, gap_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("segment", "segment long, n long, last long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        segment, n, last = self.state.get() if self.state.exists() else (0, 0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("event_id").itertuples():
            now = int(r.at.timestamp() * 1000)
            reason = "" if not n else "count" if n >= self.most else "gap" if now - last > self.gap else "marker" if r.event_type == "error" else ""
            segment, n = (segment + 1, 1) if reason else (segment, n + 1)
            last = now
            out.append((key[0], int(r.event_id), segment, reason))
        self.state.update((segment, n, last))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "segment", "reason"])

    def close(self) -> None:
        pass


class ExtractTrigger(StatefulProcessor):
    """Per key: fires when tokens, tool calls and turns since the last firing have all grown enough."""

    def __init__(self, tokens: int, calls: int, turns: int):
        self.least = (tokens, calls, turns)

    def init(self, handle) -> None:
        self.state = handle.getValueState("since", "tokens long, calls long, turns long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        since = list(self.state.get()) if self.state.exists() else [0, 0, 0]
        out = []
        for r in pd.concat(list(rows)).sort_values("event_id").itertuples():
            since = [since[0] + int(r.event_id) % 97 * 10, since[1] + (r.event_type == "click"), since[2] + 1]
            if all(s >= m for s, m in zip(since, self.least)):
                out.append((key[0], int(r.event_id)))
                since = [0, 0, 0]
        self.state.update(tuple(int(s) for s in since))
        yield pd.DataFrame(out, columns=["user_id", "event_id"])

    def close(self) -> None:
        pass


def stateful(events: DataFrame, key: str, processor: StatefulProcessor, schema: str, timers: str = "None") -> DataFrame:
    return events.groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode=timers)


# Seconds of a worker's lease, of the first retry and of a put-off job, and how often a job may fail.
LEASE, RETRY, DEFER, MOST_FAILURES = 300, 60, 300, 5


def queue_state(log: DataFrame, now: DataFrame) -> DataFrame:
    """(job, failures, status, next_run) of jobs from their log (job, seq, action, sec); now is one row.

    Only failures since the last success count, put-off runs never do. A claim that is older than the lease was lost
    with its worker: the job is ready again."""
    w = Window.partitionBy("job")
    done = F.max(F.when(F.col("action") == "done", F.col("seq"))).over(w)
    since = log.withColumn("done", F.coalesce(done, F.lit(-1)))
    by = since.groupBy("job").agg(
        F.count_if((F.col("action") == "fail") & (F.col("seq") > F.col("done"))).alias("failures"),
        F.max(F.struct("seq", "action", "sec")).alias("last"),
    )
    last, at = F.col("last.action"), F.col("last.sec")
    by = by.transform(with_one, now)
    status = F.when(last == "claim", F.when(F.col("now") - at <= LEASE, "running").otherwise("ready")).when(last == "defer", "deferred")
    status = status.when(last == "fail", F.when(F.col("failures") >= MOST_FAILURES, "failed").otherwise("retry")).otherwise("done")
    wait = F.when(last == "defer", DEFER).when(last == "fail", RETRY * F.pow(F.lit(2.0), F.least("failures", F.lit(MOST_FAILURES)) - 1)).otherwise(0)
    runs = F.when(status.isin("retry", "deferred"), at + wait.cast("long")).when(status == "ready", F.col("now"))
    return by.select("job", "failures", status.alias("status"), runs.alias("next_run"))


# Seconds between ticks, requests a day, pages a tick, and pages where the last tick was so recent.
TICK, DAILY, PAGES, FEW_PAGES, RECENT = 1_200, 500, 20, 2, 300


def sync_plan(items: DataFrame, page: int) -> DataFrame:
    """(connection, tick, items, pages, requests_before, taken) of new items (connection, sec), beyond a cursor.

    Each tick asks for as many pages as its items fill, PAGES at most; the budget of the UTC day bounds all of them."""
    tick = F.floor(F.col("sec") / TICK)
    by = items.groupBy("connection", tick.alias("tick")).agg(F.count("*").alias("items"), F.min("sec").alias("first"))
    last = F.lag("first").over(Window.partitionBy("connection").orderBy("tick"))
    most = F.when(F.col("first") - last < RECENT, FEW_PAGES).otherwise(PAGES)
    asked = by.withColumn("pages", F.least(F.ceil(F.col("items") / page), most)).withColumn("day", F.floor(F.col("tick") * TICK / 86_400))
    before = F.coalesce(F.sum("pages").over(Window.partitionBy("connection", "day").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = asked.withColumn("requests_before", before).where(F.col("requests_before") < DAILY)
    allowed = F.least("pages", DAILY - F.col("requests_before"))
    return kept.select("connection", "tick", "items", "pages", "requests_before", F.least("items", allowed * page).alias("taken"))
