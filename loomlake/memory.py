"""A backend-neutral memory over DataFrames: every call gives a new, lazy table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.functions.text import namespace
from loomlake.operators import search, tables


class Memory:
    """Entries (namespace, key, content, category, updated_at); the last write of a key counts."""

    columns = ("namespace", "key", "content", "category", "updated_at")

    def __init__(self, writes: DataFrame):
        self.writes = writes.select(namespace("namespace").alias("namespace"), *self.columns[1:])

    def entries(self) -> DataFrame:
        return tables.latest(self.writes, ["namespace", "key"], ["updated_at"]).select(*self.columns)

    def store(self, rows: DataFrame) -> Memory:
        return Memory(self.writes.unionByName(rows.select(*self.columns)))

    def get(self, ns: str, key: str) -> DataFrame:
        return self.entries().where((F.col("namespace") == ns) & (F.col("key") == key))

    def list(self, ns: str | None = None, category: str | None = None) -> DataFrame:
        rows = self.entries()
        if ns is not None:
            rows = rows.where(F.col("namespace") == ns)
        return rows if category is None else rows.where(F.col("category") == category)

    def forget(self, keys: DataFrame) -> Memory:
        return Memory(tables.without(self.writes, keys, ["namespace", "key"]))

    def namespaces(self) -> DataFrame:
        return self.entries().groupBy("namespace").agg(F.count("*").alias("n"), F.max("updated_at").alias("last_updated"))

    def recall(self, ns: str, terms: Sequence[str], limit: int, least: float = 0.0, category: str | None = None) -> DataFrame:
        """Best entries of a namespace by BM25 of any term; the category is filtered after the limit."""
        rows = self.list(ns)
        hits = search.bm25(rows, "key", "content", terms, all_terms=False).where(F.col("score") >= least)
        top = hits.orderBy(F.desc("score"), "key").limit(limit).join(rows, "key")
        return top if category is None else top.where(F.col("category") == category)
