from __future__ import annotations

import itertools
import math
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from loomlake.llm import pii
from loomlake.llm.queries import op10_pii


def plain_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="ab.@1+- ()49é\n%", max_size=50), st.text(alphabet="12.", max_size=40)))
def test_base_matches_plain_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_on_documents(spark):
    sf = "/root/testdata/sf0.1"
    model = pii.SemiCrf()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(3000).collect():
        base, spans = pii.find(r.text, model)
        assert base == plain_base(r.text) and set(base) <= set(spans)


def test_dynamic_programme_and_gradient_against_enumeration():
    text = "x 555-123-4567 a.b@cd.ef 1.2.3.4 "
    lo, hi = next(pii.islands(text))
    lat = pii.lattice(text, lo, hi)
    model = pii.SemiCrf({f: (hash_ % 7 - 3) / 4 for hash_, f in enumerate(sorted({f for s in lat.segments for f in s[3]}))})
    n = len(lat.places) - 1

    def paths(i):
        if i == n:
            yield ()
            return
        for rest in paths(i + 1):
            yield rest
        for s in lat.segments:
            if s[0] == i:
                for rest in paths(s[1]):
                    yield (s, *rest)

    every = [(sum(model._score(s[3]) for s in p), p) for p in paths(0)]
    best = max(v for v, _ in every)
    scores = {s[:3]: model._score(s[3]) for s in lat.segments}
    assert math.isclose(sum(scores[s] for s in model.best(lat)), best, abs_tol=1e-9)
    assert model.entities(text, lo, hi) == [(lat.places[x], lat.places[y], k) for x, y, k in model.best(lat)]
    total = sum(math.exp(v) for v, _ in every)
    expected = {}
    for v, p in every:
        for f in itertools.chain.from_iterable(s[3] for s in p):
            expected[f] = expected.get(f, 0.0) + math.exp(v) / total
    got: dict = {f: 0.0 for s in lat.segments for f in s[3]}
    model._gradient(lat, set(), got)
    for f, v in got.items():
        assert math.isclose(-v, expected.get(f, 0.0), abs_tol=0.01)


def test_model_finds_forms_beyond_the_patterns():
    model = pii.SemiCrf().fit([m for t, s in pii.drawn(500, 3) for m in pii.marked(t, s)])
    right = missed = wrong = 0
    for text, spans in pii.drawn(300, 99):
        got = set(pii.find(text, model)[1])
        right += len(got & set(spans))
        missed += len(set(spans) - got)
        wrong += len(got - set(spans))
    assert right > 0.85 * (right + missed) and wrong < 0.12 * right
    assert pii.find("no numbers here", model) == ([], [])
    assert pii.find("in 2024 we sold 12.5 of 3,000 units", model)[1] == []


def test_very_long_runs_take_linear_time():
    """A million characters of each kind that made a pattern or an island look again and again."""
    model = pii.SemiCrf()
    for text in ("7" * 10**6, "1." * (5 * 10**5), "1.2 " * 250_000, "a@" * (5 * 10**5), "x" * 10**6 + "@" + "y" * 10**6, "+1" + " " * 10**6, "1 " * (5 * 10**5), "12345678901234567.8." * 50_000):
        start = time.time()
        base, spans = pii.find(text, model)
        assert time.time() - start < 60, text[:10]
        assert set(base) <= set(spans)


def test_ip_pattern_beside_long_runs():
    for text in ("1" * 500 + ".2.3.4", "1.2.3." + "9" * 400, "1.2.3.4.5.6.7.8", "x1.2.3.4", "99991.2.3.4 0001.2.3.4"):
        assert pii.base_spans(text) == plain_base(text)


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op10_pii(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_base(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in base) for k in pii.KINDS)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(",")) | {""}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "+1 (017) 555-7713"), (2, "+1 (017) 555-7713"), (3, "1 " * 20000 + "@" * 500)], "doc_id long, text string").selectExpr("*", "1 as id", "2 as spans")
    got = pii.scan(docs, pii.fit(docs, max_islands=10, drawn_islands=50)).collect()
    assert len(got) == 5 and [len(r.base) for r in got if r.id == 2] == [1, 1]
    assert pii.scan(docs.limit(0), pii.SemiCrf()).collect() == []
