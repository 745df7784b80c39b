"""Connected components of a link table by alternating large-star and small-star contraction.

Nodes may be of any type with an order and without nulls inside; a component's label is its smallest node. Every round
is a groupBy with map-side minimum and an equi-join; the links of a round are written to the shared folder, so lineage
stays short. Contraction makes hubs: a node with a thousandth of all links or more (so there are few) gets its minimum
by broadcast, and its links stay where they are. Only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import discard, stored

#: Links that a single task may have of one node in any case.
HUB = 100_000


def _stars(links: DataFrame, large: bool, rows: int, hub: int) -> DataFrame:
    """Links node -> smaller node in; each node's (large: larger, else smaller) neighbours move to its minimum."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.count("*").alias("n"))
    if rows > hub:
        hubs = F.broadcast(least.where(F.col("n") > max(hub, rows // 1000)))  # at most 2,000 rows
        rest = both.join(hubs, "a", "left_anti").join(least, "a")
        moved = both.join(hubs, "a").union(rest)
    else:
        moved = both.join(least, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select("a", F.col("least").alias("b"))
        )
    return out.where("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(links: DataFrame, hub: int = HUB) -> DataFrame:
    """(node, label): each linked node with the smallest node of its component; links has columns a and b."""
    now = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links"
    )
    mark = _mark(now)
    while mark[0]:
        nxt = stored(_stars(_stars(now, True, mark[0], hub), False, mark[0], hub), "links")
        then, mark = mark, _mark(nxt)
        discard(now)
        now = nxt
        if mark == then:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
