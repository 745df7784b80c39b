"""Extension points: embedding providers, entity extractors and summarisers, each with a deterministic default."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.functions import text as fn


class EmbeddingProvider(Protocol):
    """Turns texts into vectors of a fixed size; the signature tells vectors of different models apart."""

    dims: int

    def signature(self) -> str: ...

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Signed hashed words, normalised; needs no model and no network."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def signature(self) -> str:
        return f"local/hash/{self.dims}"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dims
            for word in text.lower().split():
                h = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
                v[h % self.dims] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out


def embedded(provider: EmbeddingProvider) -> Callable[[str | Column], Column]:
    """The provider as a column function; batches go to it whole."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(provider.embed([t or "" for t in texts]))

    return run


#: An extractor makes an array of (kind, surface) from a text column; several are joined.
Extractor = Callable[[Column], Column]


def extracted(text: str, extractors: Sequence[Extractor] = (fn.entities,)) -> Column:
    return F.array_distinct(F.concat(*(e(F.col(text)) for e in extractors)))


#: A summariser makes one text of an ordered array of children within a token budget.
Summariser = Callable[[Column, int], Column]


def summarised(rows: DataFrame, key: str, order: str, content: str, budget: int, summariser: Summariser) -> DataFrame:
    children = F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda x: x[content])
    return rows.groupBy(key).agg(children.alias("_c")).select(key, summariser(F.col("_c"), budget).alias("summary"))
