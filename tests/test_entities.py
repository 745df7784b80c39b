"""Entities with spans, and the footers of mails."""

from __future__ import annotations

import pytest

from loomlake.functions import pandas_text as pt
from loomlake.functions import text as fn

TEXT = "é (@ann.bsky-1 met bob.b#1234) and @cy, #launch-q2 (#Tag) a@b.org x@y"
WANT = [("email", "a@b.org"), ("handle", "@ann.bsky-1"), ("handle", "@cy"), ("handle", "bob.b#1234"), ("hashtag", "#launch-q2"), ("hashtag", "#Tag")]


def test_forms(spark):
    found = spark.createDataFrame([(TEXT,)], "t string").select(fn.entities("t").alias("e")).first().e
    assert [tuple(e) for e in found] == WANT


def test_spans_and_topics(spark):
    found = spark.createDataFrame([(TEXT,)], "t string").select(pt.entity_spans("t").alias("e")).first().e
    assert [(e.kind, e.surface) for e in found if e.kind != "topic"] == WANT
    assert [e.surface for e in found if e.kind == "topic"] == ["launch-q2", "tag"]
    assert all(TEXT[e.start : e.end].lower() == e.surface.lower() for e in found)


@pytest.mark.parametrize("line", pt.FOOTER_TRIGGERS)
def test_footer_goes_from_any_trigger(line):
    assert pt.plain_clean_email(f"Hi\n\nBody\n* Please {line.title()} 24 now\nmore") == "Hi\n\nBody"
