"""One ordered pass over each key: rows are dealt and sorted by Spark, then stream through Python with one small state.

For folds whose next step depends on the last decision. Keys of any length fit; one key is one task's work, as the
decisions are sequential by nature."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ordered_pass(rows: DataFrame, key: str, order: Sequence[str], step: Callable, start: Callable[[], object], out: Sequence[T.StructField]) -> DataFrame:
    """rows with columns out: step(state, row as a tuple) gives (state, values); start() is each key's first state."""
    spark = rows.sparkSession
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, *order)
    at, names = rows.columns.index(key), [*rows.columns, *(f.name for f in out)]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        last, state = object(), None
        for batch in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[at] != last:
                    last, state = row[at], start()
                state, values = step(state, row)
                made.append(values)
            columns = zip(*made) if made else [() for _ in out]
            arrays = [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, out)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names)

    return dealt.mapInArrow(run, T.StructType([*dealt.schema.fields, *out]))
