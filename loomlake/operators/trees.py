"""Summary trees: sealing folds, time rollups, digests, retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from loomlake.functions.scalars import with_one
from loomlake.functions.vectors import cosine

TOKEN_BUDGET, FAN_OUT, MOST_LEVELS = 50_000, 10, 32


def seal_groups(leaves: DataFrame, tree: str, order: Sequence[str], tokens: str, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Each leaf with the number of its group: a buffer seals when its sum reaches the budget, and starts over at zero.

    The next group depends on where the last one closed, so a tree is one ordered pass. Rows stream through Python in
    Arrow batches, sorted and dealt by tree; the only state is a counter a tree, so trees of any length fit."""
    spark = leaves.sparkSession
    names = [tree, *order, tokens]
    dealt = leaves.select(*names).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), tree).sortWithinPartitions(tree, *order)

    def run(batches):
        import pyarrow as pa

        last, group, held = object(), 0, 0
        for batch in batches:
            out = []
            for t, n in zip(batch.column(0).to_pylist(), batch.column(len(names) - 1).to_pylist()):
                if t != last:
                    last, group, held = t, 0, 0
                out.append(group)
                held += n or 0
                if held >= budget:
                    group, held = group + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*names, "grp"])

    return dealt.mapInArrow(run, T.StructType([*dealt.schema.fields, T.StructField("grp", T.LongType())]))


def sealed(groups: DataFrame, tree: str, tokens: str, first: str, budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row a group: leaves, tokens, whether the budget closed it."""
    by = groups.groupBy(tree, "grp").agg(F.count("*").alias("leaves"), F.sum(tokens).alias("tokens"), F.min(first).alias("first_id"), F.max(first).alias("last_id"))
    return by.withColumn("full", F.col("tokens") >= budget)


def sealed_up(level0: DataFrame, tree: str, fan_out: int = FAN_OUT) -> DataFrame:
    """(tree, level, node, children, tokens, first_id, last_id): parents of full groups of fan_out siblings, all levels.

    Nodes of a level are numbered from 0 without gaps, so the node above a group is its number over fan_out ** level,
    and a parent is sealed if it has that many groups below. A group counts in one row a level."""
    n = F.count("*").over(Window.partitionBy(tree))
    top = F.floor(F.log(n.cast("double")) / F.log(F.lit(float(fan_out))) + 1e-9)
    levels = F.filter(F.sequence(F.lit(1), F.lit(MOST_LEVELS)), lambda l: l <= F.col("top"))
    rows = level0.withColumn("top", top).withColumn("level", F.explode(levels))
    span = F.pow(F.lit(float(fan_out)), F.col("level").cast("double")).cast("long")
    by = rows.groupBy(tree, "level", F.floor(F.col("grp") / span).alias("node")).agg(
        F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")
    )
    own = F.sequence(F.col("node") * fan_out, F.col("node") * fan_out + fan_out - 1)
    children = F.array_join(F.transform(own, lambda c: c.cast("string")), ",")
    return by.where(F.col("n") == span).select(tree, "level", "node", children.alias("children"), "tokens", "first_id", "last_id")


# Days of a week, weeks of a month and months of a year, as sealing counts them.
CALENDAR = (("week", 7), ("month", 4), ("year", 12))


def calendar_seal(days: DataFrame, tree: str, day: str) -> DataFrame:
    """(tree, level, node, days, first, last): full weeks of days, full months of weeks and full years of months.

    Sealing counts what there is, so a node is a run of so many consecutive rows; a day is one row a level."""
    sizes, size = [], 1
    for name, n in CALENDAR:
        size *= n
        sizes.append(F.struct(F.lit(name).alias("level"), F.lit(size).alias("size")))
    rn = F.row_number().over(Window.partitionBy(tree).orderBy(day)) - 1
    rows = days.withColumn("rn", rn).withColumn("x", F.explode(F.array(*sizes))).select("*", "x.level", "x.size")
    by = rows.groupBy(tree, "level", "size", F.floor(F.col("rn") / F.col("size")).alias("node")).agg(F.count("*").alias("days"), F.min(day).alias("first"), F.max(day).alias("last"))
    return by.where(F.col("days") == F.col("size")).select(tree, "level", "node", "days", "first", "last")


def recap(nodes: DataFrame, windows: Sequence[int]) -> DataFrame:
    """The nodes (level, time_end, ...) that cover the last so many days, for each window, at the level that suits its
    length or else the highest one below that has any."""
    now = nodes.agg(F.max("time_end").alias("now"))  # one row
    days = nodes.sparkSession.createDataFrame([(d,) for d in windows], "days int").withColumn("wanted", pick_level(F.col("days")))
    have = nodes.select(F.col("level").alias("have")).distinct()  # levels are few: MOST_LEVELS at most
    picked = days.join(F.broadcast(have), F.col("have") <= F.col("wanted")).groupBy("days").agg(F.max("have").alias("level"))
    picked = picked.transform(with_one, now).select("days", "level", (F.col("now") - F.col("days") * 86_400).alias("since"))
    return nodes.join(F.broadcast(picked), "level").where("time_end >= since")  # one row a window


def reranked(walk: DataFrame, vectors: DataFrame, query: Sequence[float], limit: int) -> DataFrame:
    """The limit best nodes of each root (root, node, depth) by cosine; nodes without a vector last, then by depth."""
    q = F.array(*(F.lit(float(x)) for x in query))
    near = walk.join(vectors, "node", "left").withColumn("similarity", F.round(cosine("embedding", q, None, None), 6))
    order = Window.partitionBy("root").orderBy(F.desc_nulls_last("similarity"), "depth", F.desc("node"))
    return near.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).select("root", "node", "depth", "similarity", "pos")


def summary_of(children: Column, budget: int) -> Column:
    """Deterministic summary: a dash and each trimmed child, blank lines between, cut at four characters a token."""
    lines = F.transform(F.filter(F.transform(children, lambda c: F.trim(c)), lambda c: c != ""), lambda c: F.concat(F.lit("— "), c))
    return F.substring(F.array_join(lines, "\n\n"), 1, budget * 4)


def time_tree(rows: DataFrame, ts: str, tokens: str) -> DataFrame:
    """Counts and tokens of hour, day, month, year and root nodes by one rollup."""
    keyed = rows.select(F.year(ts).alias("y"), F.month(ts).alias("m"), F.dayofmonth(ts).alias("d"), F.hour(ts).alias("h"), F.col(tokens).alias("t"))
    rolled = keyed.rollup("y", "m", "d", "h").agg(F.count("*").alias("n"), F.sum("t").alias("tokens"), F.grouping_id().alias("g"))
    limits = F.create_map(*(F.lit(x) for x in (0, 1000, 1, 2000, 3, 4000, 7, 8000, 15, 20000)))
    depth = F.create_map(*(F.lit(x) for x in (0, 4, 1, 3, 3, 2, 7, 1, 15, 0)))
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    node = F.when(F.col("g") == 15, "root").otherwise(F.concat_ws("/", F.col("y").cast("string"), two("m"), two("d"), two("h")))
    return rolled.select(node.alias("node"), depth[F.col("g").cast("int")].alias("level"), "n", "tokens", (F.col("tokens") > limits[F.col("g").cast("int")]).alias("summarised"))


def pick_level(days: Column) -> Column:
    return F.when(days < 2, 0).when(days < 14, 1).when(days < 60, 2).otherwise(3)


def hotness(mentions: Column, sources: Column, recency: Column, centrality: Column, hits: Column) -> Column:
    return F.log(mentions + 1) + 0.5 * sources + recency + centrality + 2 * hits
