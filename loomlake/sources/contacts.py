"""Address book and chat sources reshaped to the engine's records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def handles(customer: DataFrame) -> DataFrame:
    """(person, kind, handle): canonical name and e-mail handles; empty ones are skipped."""
    name = F.lower(F.trim(F.regexp_replace("c_name", r"\s+", " ")))
    email = F.lower(F.concat(F.lit("User"), F.col("c_custkey") % 100, F.lit("@Mail.com")))
    pairs = F.array(F.struct(F.lit("name").alias("kind"), name.alias("handle")), F.struct(F.lit("email").alias("kind"), email.alias("handle")))
    rows = customer.select(F.col("c_custkey").alias("person"), F.explode(pairs).alias("x"))
    return rows.select("person", "x.kind", "x.handle").where("handle <> ''")
