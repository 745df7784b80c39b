"""Conversation segments: a turn opens a new one by count, then time gap, then marker, then drift from the centroid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomlake.operators.passes import ordered_pass

MOST_TURNS, GAP_SECONDS, DRIFT = 20, 600, 0.4


def segments(turns: DataFrame, key: str, order: str, clock: str, marker: str, embedding: str | None = None, most: int = MOST_TURNS, gap: int = GAP_SECONDS, drift: float = DRIFT) -> DataFrame:
    """turns with segment (from 0) and reason; marker is a boolean column, embedding an array of numbers."""
    names = [key, order, clock, marker, *([embedding] if embedding else [])]

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    def step(state, row):
        number, n, last, center = state
        time, marked, vector = row[2], row[3], row[4] if embedding else None
        reason = ""
        if n:
            if n >= most:
                reason = "count"
            elif time is not None and last is not None and time - last > gap:
                reason = "gap"
            elif marked:
                reason = "marker"
            elif vector and center and cosine(vector, center) < drift:
                reason = "drift"
        if reason:
            number, n, center = number + 1, 0, None
        if vector:
            center = list(vector) if not center else [c + (x - c) / (n + 1) for c, x in zip(center, vector)]
        return (number, n + 1, time, center), (number, reason)

    out = [T.StructField("segment", T.LongType()), T.StructField("reason", T.StringType())]
    return ordered_pass(turns.select(*names), key, [order], step, lambda: (0, 0, None, None), out)
