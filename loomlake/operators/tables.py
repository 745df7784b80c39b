"""Keyed tables without a table format: latest-per-key views, merges, deletes, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key; one aggregation with map-side combine, no window."""
    by = F.struct(*order)
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_row"))
    return top.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def upsert(rows: DataFrame, keys: Sequence[str], version: str, keep_first: Sequence[str]) -> DataFrame:
    """Last write wins, but for the columns that keep their first value."""
    rest = [c for c in rows.columns if c not in (*keys, *keep_first)]
    merged = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), version).alias("_new"), F.min_by(F.struct(*keep_first), version).alias("_old"), F.count("*").alias("writes")
    )
    return merged.select(*keys, *(F.col(f"_old.{c}") for c in keep_first), *(F.col(f"_new.{c}") for c in rest), "writes")


def without(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in gone."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def replace_for(rows: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the keys in fresh give way to fresh."""
    return without(rows, fresh, keys).unionByName(fresh)


def newest(rows: DataFrame, keys: Sequence[str], n: int, order: Sequence[Column]) -> DataFrame:
    """The first n rows of each key; the group limit is pushed below the shuffle by the optimizer."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def ledger_diff(before: DataFrame, after: DataFrame, key: str, digest: str, supported: Column) -> DataFrame:
    """Status counts of a re-sync between two snapshots of (key, digest)."""
    a, b = before.select(key, F.col(digest).alias("_was")), after.select(key, F.col(digest).alias("_is"))
    status = (
        F.when(~supported, "unsupported")
        .when(F.col("_was").isNull(), "new")
        .when(F.col("_is").isNull(), "removed")
        .when(F.col("_was") == F.col("_is"), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, key, "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def merged_set(lists: Column) -> Column:
    """Sorted distinct union of collected arrays."""
    return F.array_sort(F.array_distinct(F.flatten(lists)))


def unsynced(items: DataFrame, synced: DataFrame, connection: str, key: str, at: str) -> DataFrame:
    """The items that a connection has not stored: beyond its cursor, with an unknown id. Where the newest item is the
    one stored last, nothing is new and the connection is left alone."""
    state = synced.groupBy(connection).agg(F.max(at).alias("_cursor"), F.max_by(key, at).alias("_last"))
    head = items.groupBy(connection).agg(F.max_by(key, at).alias("_newest")).join(state, connection, "left")
    live = head.where("_last is null or _last <> _newest").select(connection, "_cursor")
    fresh = items.join(live, connection).where(F.col("_cursor").isNull() | (F.col(at) > F.col("_cursor"))).drop("_cursor")
    return without(fresh, synced.select(connection, key), [connection, key])
