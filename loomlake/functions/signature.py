"""Facts of an e-mail signature: name, role, employer, time zone, place, address."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("email", "name", "role", "employer", "timezone", "location")
NAME = re.compile(r"^[A-Z][\w'-]+( [A-Z]\.?)?( [A-Z][\w'-]+){1,2}$")
ROLE = re.compile(r"\b(engineer|manager|director|officer|designer|developer|analyst|founder|consultant|lead|president|scientist)\b", re.I)
ZONE = re.compile(r"\b(UTC[+-]?\d*|GMT[+-]?\d*|[ECMP]S?T|CES?T)\b")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
MOST_LINES = 8


def plain_facts(body: str) -> dict[str, str | None]:
    """Looks at the lines below the last `--`, or at the last few lines without one."""
    lines = [x.strip() for x in body.strip().split("\n")]
    at = max((i for i, x in enumerate(lines) if x in ("--", "-- ")), default=-1)
    block = lines[at + 1 :][:MOST_LINES] if at >= 0 else lines[-MOST_LINES // 2 :]
    out: dict[str, str | None] = dict.fromkeys(FIELDS)
    for line in block:
        if m := EMAIL.search(line):
            out["email"] = out["email"] or m[0].lower()
            continue
        if NAME.match(line) and not out["name"] and not ROLE.search(line):
            out["name"] = line
            continue
        if ROLE.search(line) and not out["role"]:
            head, _, tail = re.sub(r"\s+(at|@)\s+", ", ", line).partition(",")
            out["role"], out["employer"] = head.strip(), tail.strip() or None
            continue
        if m := ZONE.search(line):
            out["timezone"] = out["timezone"] or m[0]
        if (m := re.match(r"^(?:Based in |Location: )?([A-Z][a-z]+, [A-Z][A-Za-z]+)$", line)) and not out["location"]:
            out["location"] = m[1]
    return out


def _facts(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([plain_facts(x) if x is not None else dict.fromkeys(FIELDS) for x in s], columns=list(FIELDS))


facts = F.pandas_udf(_facts, T.StructType([T.StructField(f, T.StringType()) for f in FIELDS]))
