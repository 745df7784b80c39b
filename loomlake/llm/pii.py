"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

Around digits and at signs a text is cut into islands, and an island into atoms (letter runs, digit runs, single other
characters, white space). A segmentation covers the atoms with single outside atoms and entity segments of at most
MOST_ATOMS atoms; a segment is scored as a whole, by features of its form, checksums and surroundings. The dynamic
programme over segment ends picks boundaries and types together, in time linear in the atoms. Weights maximise the
conditional likelihood (forward-backward over all segmentations) of a bounded sample of islands of the corpus, marked
by the fixed patterns, and of drawn islands that show forms which the patterns don't cover.

Results for odd input: null and empty texts have no spans; equal texts equal spans; null ids are kept; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import in_arrow

KINDS = ("email", "ip", "card", "phone")

# The base patterns and their limits.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match takes whole digit runs, and where one run's start fails, so do all places inside it: none is tried twice.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TRIGGER = re.compile(r"[0-9@]+")
ATOM = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^A-Za-z0-9\s]")
MOST_ATOMS = 16
#: Scores of segments of so many characters are remembered, so many at a time.
LONGEST_KNOWN, MOST_KNOWN = 64, 50_000
SPACE = frozenset(" \t\n\x0b\x0c\r")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def small_parts(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, at sign and dotted domain, each at sign looked at once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Passing matches of the fixed patterns, by kind and place."""
    if not TRIGGER.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if small_parts(m[0])]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return out


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of words with a digit or an at sign, one space apart."""
    start = end = -1
    for m in TRIGGER.finditer(text):
        if m.start() < end:
            continue
        a, b = m.span()
        floor = max(end, 0)
        while a > floor and text[a - 1] not in SPACE:
            a -= 1
        while b < len(text) and text[b] not in SPACE:
            b += 1
        if start >= 0 and a == end + 1 and text[end] == " ":
            end = b
            continue
        if start >= 0:
            yield start, end
        start, end = a, b
    if start >= 0:
        yield start, end


@dataclass
class Lattice:
    """Atoms of an island and its candidate segments (first atom, end atom, kind, features)."""

    places: list[int]
    segments: list[tuple[int, int, str, tuple[str, ...]]] = field(default_factory=list)


def _near(text: str, at: int) -> str:
    c = text[at] if 0 <= at < len(text) else ""
    return "#" if "0" <= c <= "9" else "a" if c.isalpha() else "_" if c in SPACE or not c else c


def _shape(s: str) -> str:
    """Digit runs as their length, the rest as it is."""
    return re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 9)) if len(m[0]) < 10 else "L", s)


def _number_features(text: str, a: int, b: int, kind: str) -> tuple[str, ...]:
    s = text[a:b]
    d = only_digits(s)
    seps = "".join(sorted(set(re.sub(r"[0-9]", "", s))))
    groups = re.findall(r"[0-9]+", s)
    last, runs = len(groups[-1]), len(groups)
    facts = [f"n{len(d)}", f"sep{seps}", f"runs{min(runs, 6)}", f"last{min(last, 5)}", f"before{_near(text, a - 1)}", f"after{_near(text, b)}"]
    facts.append(f"even{len({len(g) for g in groups}) == 1}")
    if kind == "card":
        facts += [f"luhn{luhn(d)}", f"long{13 <= len(d) <= 19}"]
    elif kind == "phone":
        facts += [f"plus{s[0] == '+'}", f"round{'(' in s and ')' in s}", f"size{9 <= len(d) <= 15}", f"shape{_shape(s)}"]
    else:
        facts += [f"parts{runs == 4 and small_parts(s)}", f"lead{any(len(g) > 1 and g[0] == '0' for g in groups)}"]
    return tuple(f"{kind}:{x}" for x in facts)


def _email_features(text: str, a: int, at: int, b: int) -> tuple[str, ...]:
    local, domain = text[a:at], text[at + 1 : b]
    top = domain.rpartition(".")[2]
    facts = [f"dots{min(domain.count('.'), 3)}", f"top{min(len(top), 7) if top.isalpha() else '?'}", f"edge{local[0].isalnum()}{local[-1].isalnum()}"]
    facts += [f"before{_near(text, a - 1)}", f"after{_near(text, b)}", f"hyphen{domain[0] == '-' or domain[-1] == '-'}", f"double{'..' in local or '..' in domain}"]
    return tuple(f"email:{x}" for x in facts)


NUMERIC = frozenset(" ().-+")


def candidates(text: str, atoms: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, int]]:
    """(first atom, end atom, kind, place of the at sign or -1) of all segments that may be an entity."""
    n = len(atoms)
    for i, (a, b) in enumerate(atoms):
        c = text[a]
        if c == "@":
            left = i
            while left and i - left < MOST_ATOMS // 2 and (text[atoms[left - 1][0]] in LOCAL):
                left -= 1
            right = i + 1
            while right < n and right - i <= MOST_ATOMS // 2 and (text[atoms[right][0]].isascii() and (text[atoms[right][0]].isalnum() or text[atoms[right][0]] in ".-")):
                right += 1
            for x in range(left, i):
                if not text[atoms[x][0]].isalnum():
                    continue
                for y in range(i + 2, right + 1):
                    end = atoms[y - 1][1]
                    if text[end - 1].isalnum() and "." in text[b:end]:
                        yield x, y, "email", a
            continue
        if not ("0" <= c <= "9" or c in "+("):
            continue
        digits = dots = 0
        for j in range(i, min(n, i + MOST_ATOMS)):
            x, y = atoms[j]
            if "0" <= text[x] <= "9":
                digits += y - x
                if digits > 19:
                    break
                if digits < 4:
                    continue
                if dots == 3 and j - i == 6 and "0" <= c <= "9":
                    yield i, j + 1, "ip", -1
                if digits >= 7:
                    yield i, j + 1, "phone", -1
                if digits >= 12 and "0" <= c <= "9":
                    yield i, j + 1, "card", -1
            elif y - x > 1 or text[x] not in NUMERIC or (text[x] == "+" and j > i):
                break
            dots += text[x] == "."


def features(text: str, a: int, b: int, kind: str, at: int) -> tuple[str, ...]:
    return _email_features(text, a, at, b) if kind == "email" else _number_features(text, a, b, kind)


def lattice(text: str, lo: int, hi: int) -> Lattice:
    """Atoms and candidate segments of text[lo:hi]; surroundings are read from the whole text."""
    atoms = [m.span() for m in ATOM.finditer(text, lo, hi)]
    out = Lattice([a for a, _ in atoms] + [hi])
    for x, y, kind, at in candidates(text, atoms):
        out.segments.append((x, y, kind, features(text, atoms[x][0], atoms[y - 1][1], kind, at)))
    return out


def _best(n: int, scored: Iterable[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """Entity segments (first atom, end atom, kind) of the best segmentation of n atoms."""
    by_end = defaultdict(list)
    for x, y, kind, s in scored:
        if s > 0:  # nothing else beats the same atoms outside
            by_end[y].append((x, kind, s))
    value, came = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        for x, kind, s in by_end.get(j, ()):
            if value[x] + s > value[j]:
                value[j], came[j] = value[x] + s, (x, kind)
    out, j = [], n
    while j:
        if came[j]:
            out.append((came[j][0], j, came[j][1]))
            j = came[j][0]
        else:
            j -= 1
    return out[::-1]


class SemiCrf:
    """Weights of segment features; an outside atom scores zero."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}
        self.known: dict[tuple, float] = {}

    def _score(self, features: tuple[str, ...]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def best(self, lat: Lattice) -> list[tuple[int, int, str]]:
        return _best(len(lat.places) - 1, ((x, y, kind, self._score(f)) for x, y, kind, f in lat.segments))

    def entities(self, text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the best segmentation of text[lo:hi]; features aren't kept, so long islands are fine."""
        atoms = [m.span() for m in ATOM.finditer(text, lo, hi)]

        def scored() -> Iterator[tuple[int, int, str, float]]:
            for x, y, kind, at in candidates(text, atoms):
                a, b = atoms[x][0], atoms[y - 1][1]
                # all that features depend on
                key = (kind, text[a:b], max(at - a, -1), _near(text, a - 1), _near(text, b)) if b - a <= LONGEST_KNOWN else None
                if key is None or key not in self.known:
                    value = self._score(features(text, a, b, kind, at))
                    if key is None:
                        yield x, y, kind, value
                        continue
                    if len(self.known) >= MOST_KNOWN:
                        self.known.clear()
                    self.known[key] = value
                yield x, y, kind, self.known[key]

        return [(atoms[x][0], atoms[y - 1][1], kind) for x, y, kind in _best(len(atoms), scored())]

    def _gradient(self, lat: Lattice, truth: set[tuple[int, int, str]], grad: dict[str, float]) -> None:
        """Adds observed minus expected feature counts."""
        n = len(lat.places) - 1
        scored = [(x, y, self._score(f)) for x, y, _, f in lat.segments]
        by_end, by_start = defaultdict(list), defaultdict(list)
        for x, y, s in scored:
            by_end[y].append((x, s))
            by_start[x].append((y, s))
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = _logsum([ahead[j - 1], *(ahead[x] + s for x, s in by_end.get(j, ()))])
        for i in range(n - 1, -1, -1):
            behind[i] = _logsum([behind[i + 1], *(s + behind[y] for y, s in by_start.get(i, ()))])
        for (x, y, kind, features), (_, _, s) in zip(lat.segments, scored):
            change = ((x, y, kind) in truth) - math.exp(min(0.0, ahead[x] + s + behind[y] - ahead[n]))
            if abs(change) > 1e-4:
                for f in features:
                    grad[f] += change

    def fit(self, sample: list[tuple[Lattice, set[tuple[int, int, str]]]], rounds: int = 40, decay: float = 0.01) -> SemiCrf:
        """Gradient ascent with steps scaled by past gradients; the decay keeps weights finite."""
        past: dict[str, float] = defaultdict(float)
        weights = defaultdict(float, self.weights)
        self.weights = weights
        for _ in range(rounds):
            grad: dict[str, float] = defaultdict(float)
            for lat, truth in sample:
                self._gradient(lat, truth, grad)
            for f in sorted(set(grad) | set(weights)):
                g = grad[f] - decay * weights[f]
                past[f] += g * g
                weights[f] += 0.5 * g / math.sqrt(past[f] + 1e-8)
        self.weights = {f: round(w, 6) for f, w in weights.items()}
        self.known.clear()
        return self


def _logsum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def marked(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[Lattice, set[tuple[int, int, str]]]]:
    """Lattices of a text's islands with the spans that fall on atom bounds."""
    out = []
    for lo, hi in islands(text):
        lat = lattice(text, lo, hi)
        number = {p: i for i, p in enumerate(lat.places)}
        own = {(number[a], number[b], k) for k, a, b in spans if lo <= a < b <= hi and a in number and b in number}
        if lat.segments:
            out.append((lat, {t for t in own if any(t == s[:3] for s in lat.segments)}))
    return out


def drawn(n: int, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with marked personal data in forms beyond the fixed patterns, and with other numbers."""
    rng = random.Random(seed)

    def digits(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = rng.choice("3456") + digits(rng.choice((13, 14, 14, 14)))
        d += next(c for c in "0123456789" if luhn(d + c))
        return rng.choice((d, d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4))))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice((f"({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"+44 {digits(4)} {digits(6)}", f"({a}) {b} {c}"))

    def ip() -> str:
        return ".".join(str(rng.randrange(256)) for _ in range(4))

    def email() -> str:
        word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
        return f"{word()}{rng.choice(('', '.', '_'))}{word()}{rng.choice(('', digits(2)))}@{word()}.{rng.choice(('com', 'org', 'example.com', 'de'))}"

    def other() -> str:
        return rng.choice((
            digits(rng.randint(1, 12)), f"{digits(2)}.{digits(2)}", f"20{digits(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", digits(16), f"{digits(3)},{digits(3)},{digits(3)}",
            f"{digits(1)}.{digits(1)}.{digits(1)}", f"{rng.randint(256, 999)}.{digits(2)}.{digits(3)}.{digits(1)}", f"@{digits(3)}", f"{digits(4)} {digits(4)}", f"{digits(8)}-{digits(2)}",
            f"{digits(3)} {digits(2)} {digits(3)} {digits(2)}",
        ))

    makers = {"card": card, "phone": phone, "ip": ip, "email": email, "": other}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            kind = rng.choice(("card", "phone", "ip", "email", "", "", ""))
            item = makers[kind]()
            text += rng.choice(("see ", "", "to ", "word, "))
            passes = not kind and any(13 <= len(only_digits(item)) <= 19 and luhn(only_digits(item)) for _ in (0,))
            if kind or passes:
                spans.append((kind or "card", len(text), len(text) + len(item)))
            text += item + rng.choice((" ", ". ", ", ", " and "))
        out.append((text, spans))
    return out


#: Characters of the longest island that may be an example.
LONGEST_EXAMPLE = 200


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            if text and TRIGGER.search(text):
                spans = base_spans(text)
                for lo, hi in islands(text):
                    if hi - lo <= LONGEST_EXAMPLE and any(lo <= a and b <= hi for _, a, b in spans):
                        rows.append(text[max(0, lo - 1) : hi + 1])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["island"])


def fit(docs: DataFrame, text_col: str = "text", max_islands: int = 800, drawn_islands: int = 800) -> SemiCrf:
    """A model from at most max_islands distinct islands of the corpus, by hash order, and drawn ones.

    Examples are islands of LONGEST_EXAMPLE characters at most that hold a base span; scanning has no such limit."""
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    found = in_arrow(texts, _sampled, "island string").groupBy("island").agg(F.xxhash64("island").alias("h"))
    rows = found.orderBy("h", "island").limit(max_islands).collect()
    sample = [m for r in rows for m in marked(r.island, base_spans(r.island))]
    sample += [m for text, spans in drawn(drawn_islands) for m in marked(text, spans)]
    return SemiCrf().fit(sample)


def find(text: str, model: SemiCrf) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans with those that the model adds beside them; by kind, then place."""
    if not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else starts
    added = []
    for lo, hi in islands(text):
        for a, b, kind in model.entities(text, lo, hi):
            i = int(np.searchsorted(starts, b))  # base spans that start before b; none may reach beyond a
            if not i or reach[i - 1] <= a:
                added.append((kind, a, b))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


FOUND = "id long, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"


def _found(model: SemiCrf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            got = [find(t or "", model) for t in batch.column(1).to_pylist()]
            lists = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in g[i]] for g in got], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["id", "base", "spans"])

    return run


def scan(docs: DataFrame, model: SemiCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): spans as (kind, start, end) in code points, by kind as listed, then start."""
    pair = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return in_arrow(pair, _found(model), FOUND)
