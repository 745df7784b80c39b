"""Helpers of the corpus operators: shared storage, Arrow access to texts, bounded blocks."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of the word rule `[^\x20\x09-\x0D]+`; bytes.split() splits at exactly these.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(docs: DataFrame) -> DataFrame:
    """docs over all cores where the scan has fewer splits than there are cores (one file of one row group, say).

    A scan of many splits, so any large table, stays as it is: its rows don't move."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session without the setting gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="loomlake-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders of stored() tables, by the scratch() blocks that are open.
_made: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables stored inside go at the end, but for those that the block takes off the list; nothing lazy may read them
    any more. A block that fails leaves them for a look."""
    own: list[str] = []
    _made.append(own)
    try:
        yield own
    except BaseException:
        _made.pop()
        raise
    _made.pop()
    for at in own:
        _remove(spark, at)


def _remove(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here and lost executors cost nothing."""
    at = place(df.sparkSession, name)
    df.write.parquet(at)
    if _made:
        _made[-1].append(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def discard(df: DataFrame) -> None:
    """Removes the files of a stored() table that no later plan reads."""
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.startswith(("file:", "/", "hdfs:", "s3", "viewfs:", "gs:", "abfs")):
            _remove(df.sparkSession, root)


def fresh(name: str, taken: Sequence[str]) -> str:
    """name, or name with as many underscores as no column has, in whatever case."""
    own = {c.lower() for c in taken}
    while name.lower() in own:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str | Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo folds, equals fold; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % folds == fold


def n_words(text: str | Column) -> Column:
    """Number of words `[^\x20\x09-\x0D]+` of a text, 0 for null, without Python."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for c in SPACES[1:]:
        col = F.replace(col, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(col, " "), "")).cast("long")


#: Bounds of an Arrow batch. Both sides hold a batch several times over, and texts differ in length by orders.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 2_000


def in_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow in batches of bounded bytes; the session's own limits stay where they are smaller."""
    conf = df.sparkSession.conf
    for name, most in (("Bytes", BATCH_BYTES), ("Records", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        now = re.fullmatch(r"(-?\d+)[bB]?", conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            conf.set(key, str(most))
    return df.mapInArrow(function, schema)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def trim() -> None:
    """Gives freed memory back to the system: workers live on from stage to stage, and so would their largest heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def blocks(lengths: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose lengths sum to the limit at most (single longer items alone)."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
