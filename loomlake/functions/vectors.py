"""Vector functions on array<float> columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: str | Column, b: str | Column, low: float | None = 0.0, high: float | None = 1.0) -> Column:
    """Cosine; 0 for zero vectors and different sizes. Stored vectors clamp to 0..1, segments to -1..1, reranking not at all."""
    n = norm(a) * norm(b)
    value = F.when((F.size(_col(a)) != F.size(_col(b))) | (n == 0), 0.0).otherwise(dot(a, b) / n)
    if low is not None:
        value = F.greatest(value, F.lit(low))
    return F.least(value, F.lit(high)) if high is not None else value
