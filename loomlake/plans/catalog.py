"""All queries of the memory data plane: each is a function of tables, with an SQL twin over the same tables.

A stand-in table is one SELECT over the driver's tables that both SQL dialects read; @sec(x) and @ms(x) are a
timestamp's epoch seconds and milliseconds. Queries take tables or stand-ins by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from loomlake.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, tuple[Sequence[str], str]] = {}
STAND_INS: dict[str, str] = {}
#: Tables whose rows cost much more than their reading does.
TEXTS = {"documents", "pages", "conversations"}


def stand_in(name: str, sql: str) -> None:
    STAND_INS[name] = sql


def _spark_sql(sql: str) -> str:
    sql = re.sub(r"@sec\((\w+)\)", r"unix_seconds(cast(\1 as timestamp))", sql)
    return re.sub(r"@ms\((\w+)\)", r"unix_millis(cast(\1 as timestamp))", sql)


def _plain_sql(sql: str) -> str:
    sql = re.sub(r"@sec\((\w+)\)", r"cast(floor(epoch(\1)) as bigint)", sql)
    sql = re.sub(r"@ms\((\w+)\)", r"epoch_ms(\1)", sql)
    return re.sub(r"\{([a-z]\w*)\}", r"\1", sql)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a stand-in, as a lazy plan: filters and column choice still reach the scan."""
    if name not in STAND_INS:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(rows) if name in TEXTS else rows
    sql = STAND_INS[name]
    used = {n: load(spark, sf_dir, n) for n in set(re.findall(r"\{([a-z]\w*)\}", sql))}
    return spark.sql(_spark_sql(sql), **used)


def _needs(names: Sequence[str], found: dict[str, str] | None = None) -> dict[str, str]:
    found = {} if found is None else found
    for n in names:
        if n in STAND_INS and n not in found:
            _needs(re.findall(r"\{([a-z]\w*)\}", STAND_INS[n]), found)
            found[n] = _plain_sql(STAND_INS[n])
    return found


def twin(inputs: Sequence[str], sql: str) -> str:
    """The whole oracle text: stand-ins as common table expressions before the query."""
    sql = _plain_sql(sql.strip())
    parts = [f"{n} AS ({s})" for n, s in _needs(inputs).items()]
    recursive = ""
    if m := re.match(r"with\s+(recursive\s+)?", sql, re.I):
        recursive, sql = m[1] or "", sql[m.end() :]
        return f"WITH {recursive}{', '.join([*parts, sql])}"
    return (f"WITH {', '.join(parts)} " if parts else "") + sql


def query(name: str, inputs: Sequence[str], sql: str | None = None):
    """Registers f(*tables) under name."""

    def keep(f: Callable[..., DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} twice")
        QUERIES[name] = lambda spark, sf_dir: f(*(load(spark, sf_dir, i) for i in inputs))
        if sql is not None:
            TWINS[name] = (inputs, sql)
        return f

    return keep


def oracle_sql() -> dict[str, str]:
    return {name: twin(*t) for name, t in TWINS.items()}


def all_loaded() -> None:
    """Imports the modules that register queries."""
    from loomlake.plans import extension, forest, intake, joins, people, ranking, retrieval, stand_ins, stores, streams, texts, usage  # noqa: F401
