"""Graph and interval joins over the entity index and the summary trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomlake.session import written


def co_occurring(index: DataFrame, subject: str, limit: int = 100) -> DataFrame:
    """Entities that share most nodes with the subject; ties by id."""
    pairs = index.select("entity_id", "node_id").distinct()
    mine = pairs.where(F.col("entity_id") == subject).select("node_id")
    near = pairs.where(F.col("entity_id") != subject).join(mine, "node_id", "left_semi")
    return near.groupBy("entity_id").agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "entity_id").limit(limit)


def co_occur_all(index: DataFrame) -> DataFrame:
    """Weights of all co-occurring entity pairs a < b, from each node's distinct entities.

    A node joins its entities with each other, so callers drop boilerplate nodes first; the result is the graph itself."""
    pairs = index.select("entity_id", "node_id").distinct()
    other = pairs.select(F.col("entity_id").alias("b"), "node_id")
    joined = pairs.withColumnRenamed("entity_id", "a").join(other, "node_id").where("a < b")
    return joined.groupBy("a", "b").agg(F.count("*").alias("weight"))


def by_weight(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("weight").agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("entities"), F.count("*").alias("n"))


def bounded_walk(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): nodes reached within depth steps, each at its least depth; edges are (parent, child).

    One join a level; nodes seen before leave the frontier, so cycles end. Each level is written down: a level's plan
    would else hold all those before it twice."""
    seen = written(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "walk")
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.join(edges, frontier.node == edges.parent).select("root", F.col("child").alias("node")).distinct()
        fresh = step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(level))
        frontier = written(fresh, "walk")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def overlapping_days(spans: DataFrame, start: str, end: str, seconds: int = 86_400) -> DataFrame:
    """Each span once for each half-open day that it touches: an equi-join on the day replaces a range join."""
    first, last = F.floor(F.col(start) / seconds), F.floor(F.col(end) / seconds)
    return spans.withColumn("day_no", F.explode(F.sequence(first, F.greatest(first, last))))


def best_by(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
