"""Values of a one-row table beside each row, as a scalar subquery instead of a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_one(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows with the columns of one, a table of a single row; for rows.transform(with_one, one)."""
    packed = one.select(F.struct(*one.columns).alias("_one")).scalar()
    wide = rows.withColumn("_one", packed)
    return wide.select(*(F.col(f"`{c}`") for c in rows.columns), *(F.col("_one").getField(c).alias(c) for c in one.columns))
