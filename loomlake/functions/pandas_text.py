"""Text functions that need Python: Arrow-batched pandas functions, null in, null out."""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.functions.text import ENTITY_FORMS, FOLDED, REDACTED, SECRET_BLOCKS, SECRET_FORMS

_FOLD = str.maketrans(FOLDED)


def _each(f, kind):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return F.pandas_udf(run, kind)


def plain_normalize(x: str) -> str:
    """Decomposed, marks dropped, lower case, composed, and letters without a decomposition folded."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    return unicodedata.normalize("NFKC", bare.lower()).translate(_FOLD)


normalize = _each(plain_normalize, T.StringType())

CJK = re.compile("[぀-ヿ㐀-鿿가-힯]+")


def plain_mixed_grams(x: str) -> list[str]:
    """Pairs within CJK runs, triples within the other runs."""
    out, at = [], 0
    for m in [*CJK.finditer(x), None]:
        other = x[at : m.start() if m else len(x)]
        out += [other[i : i + 3] for i in range(len(other) - 2)]
        if m:
            run = m[0]
            out += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
            at = m.end()
    return out


mixed_grams = _each(plain_mixed_grams, T.ArrayType(T.StringType()))
pack_vector = _each(lambda v: struct.pack(f"<{len(v)}f", *v), T.BinaryType())
unpack_vector = _each(lambda b: list(struct.unpack(f"<{len(b) // 4}f", b[: len(b) // 4 * 4])), T.ArrayType(T.FloatType()))

WIDE = {"W", "F"}


def plain_graphemes(x: str) -> list[str]:
    """Clusters: a base with its marks, joiners and variation selectors; pairs of regional letters."""
    out: list[str] = []
    for c in x:
        joins = out and (unicodedata.combining(c) or c in "‍️" or "\U0001f3fb" <= c <= "\U0001f3ff" or out[-1].endswith("‍"))
        pair = out and "\U0001f1e6" <= c <= "\U0001f1ff" and len(out[-1]) == 1 and "\U0001f1e6" <= out[-1] <= "\U0001f1ff"
        if joins or pair:
            out[-1] += c
        else:
            out.append(c)
    return out


def plain_width(x: str) -> int:
    """Terminal cells: two for wide clusters, none for controls."""
    return sum(2 if any(unicodedata.east_asian_width(c) in WIDE for c in g) else 0 if unicodedata.category(g[0]) in ("Cc", "Mn") else 1 for g in plain_graphemes(x))


graphemes = _each(lambda x: len(plain_graphemes(x)), T.IntegerType())
width = _each(plain_width, T.IntegerType())

# Keys whose values never stay, what their letters and digits may end in or hold, and the depth.
SENSITIVE = {"apikey", "token", "accesstoken", "refreshtoken", "authorization", "password", "secret", "clientsecret"}
SENSITIVE_ENDS, SENSITIVE_PARTS = ("token", "apikey", "clientsecret", "key"), ("password", "secret")
DEEPEST = 128
_SECRETS = tuple((re.compile(p, re.ASCII), mark.replace("$1", r"\1")) for p, mark in (*((b, REDACTED) for b in SECRET_BLOCKS), *SECRET_FORMS))


def is_sensitive(key: str) -> bool:
    own = "".join(c for c in key.lower() if c.isascii() and c.isalnum())
    return own in SENSITIVE or own.endswith(SENSITIVE_ENDS) or any(p in own for p in SENSITIVE_PARTS)


def plain_redact_json(x: str) -> str:
    """Values of sensitive keys, secrets in other texts and what lies too deep give way to a mark; other texts stay."""

    def walk(v, depth):
        if depth >= DEEPEST:
            return REDACTED
        if isinstance(v, dict):
            return {k: REDACTED if is_sensitive(k) else walk(u, depth + 1) for k, u in v.items()}
        if isinstance(v, list):
            return [walk(u, depth + 1) for u in v]
        if isinstance(v, str):
            for form, mark in _SECRETS:
                v = form.sub(mark, v)
        return v

    try:
        return json.dumps(walk(json.loads(x), 0), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return x


redact_json = _each(plain_redact_json, T.StringType())


def plain_chunks(text: str, max_tokens: int) -> list[dict]:
    """Sections by heading, packed by paragraph, then line, then word, within max_tokens * 4 bytes; the heading repeats."""
    limit = max_tokens * 4
    size = lambda s: len(s.encode())
    out: list[dict] = []

    def parts(s: str, level: int):
        seps = ("\n\n", "\n", " ")
        if size(s) <= limit:
            yield s
        elif level < 3:
            held = ""
            for piece in s.split(seps[level]):
                joined = held + seps[level] + piece if held else piece
                if size(joined) <= limit:
                    held = joined
                    continue
                if held:
                    yield held
                held = ""
                if size(piece) <= limit:
                    held = piece
                else:
                    yield from parts(piece, level + 1)
            if held:
                yield held
        else:
            at = 0
            while at < len(s):
                n = max(1, limit // 4)
                while at + n < len(s) and size(s[at : at + n + 1]) <= limit:
                    n += 1
                yield s[at : at + n]
                at += n

    heading, body = "", []
    sections = []
    for line in text.split("\n"):
        if re.match(r"#{1,6}\s", line):
            sections.append((heading, "\n".join(body)))
            heading, body = line.strip(), []
        else:
            body.append(line)
    sections.append((heading, "\n".join(body)))
    for h, b in sections:
        if not (h or b.strip()):
            continue
        for piece in list(parts(b.strip("\n"), 0)) or [""]:
            out.append({"index": len(out), "heading": h, "content": piece})
    return out


def chunk_markdown(max_tokens: int):
    kind = T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("heading", T.StringType()), T.StructField("content", T.StringType())]))
    return _each(lambda x: plain_chunks(x, max_tokens), kind)


# Lines that begin a quoted reply or a footer.
REPLY = re.compile(r"^(On .{5,200} wrote:|-+ ?Original Message ?-+|From: .+|Begin forwarded message:)\s*$", re.I)
FOOTER = re.compile(r"^(--\s*|unsubscribe\b.*|you (are receiving|received) this.*|view (this email )?in (your )?browser.*|sent from my .*)$", re.I)
FOOTER_TRIGGERS = (
    "unsubscribe", "view in browser", "view this email in your browser", "view it in your browser", "update your email settings", "manage your subscription",
    "manage preferences", "email preferences", "you are receiving this email because", "you received this email because", "you're receiving this email because",
    "to stop receiving", "all rights reserved", "© 20", "(c) 20", "copyright 20", "powered by mailchimp", "sent via sendgrid", "this email and any files",
    "confidentiality notice", "if you are not the intended recipient", "this communication may contain",
)


def plain_clean_email(x: str) -> str:
    """Body before the reply chain and footer, blank runs collapsed."""
    out: list[str] = []
    lines = x.replace("\r\n", "\n").split("\n")
    for i, line in enumerate(lines):
        s = line.strip()
        if REPLY.match(s) or FOOTER.match(s) or any(y in s.lower() for y in FOOTER_TRIGGERS) or (s.startswith(">") and all(y.strip().startswith(">") for y in lines[i : i + 3]) and i + 3 <= len(lines)):
            break
        if s or (out and out[-1]):
            out.append(line.rstrip())
    return "\n".join(out).strip()


clean_email = _each(plain_clean_email, T.StringType())
_ENTITIES = tuple((kind, re.compile(form, re.ASCII)) for kind, form in ENTITY_FORMS)


def plain_entity_spans(x: str) -> list[dict]:
    """Entities with their places in characters, and a topic for each hashtag."""
    out = []
    for kind, form in _ENTITIES:
        for m in form.finditer(x):
            out.append({"kind": kind, "surface": m[0], "start": m.start(), "end": m.end()})
            if kind == "hashtag":
                out.append({"kind": "topic", "surface": m[0][1:].lower(), "start": m.start() + 1, "end": m.end()})
    return out


entity_spans = _each(
    plain_entity_spans,
    T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("surface", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])),
)
URL = re.compile(r"https?://[^\s<>\"')\]]+")
LONG_URL = 80


def plain_shorten(x: str, digest) -> str:
    """Long URLs give way to ids; trailing punctuation stays outside."""

    def short(m):
        url = m[0].rstrip(".,;:!?")
        return m[0] if len(url.encode()) < LONG_URL else f"link://{digest(url)}{m[0][len(url):]}"

    return URL.sub(short, x)


def _sha(url: str) -> str:
    import hashlib

    return hashlib.sha256(url.encode()).hexdigest()[:12]


shorten_urls = _each(lambda x: plain_shorten(x, _sha), T.StringType())
long_urls = _each(lambda x: [u for m in URL.finditer(x) if len((u := m[0].rstrip(".,;:!?")).encode()) >= LONG_URL], T.ArrayType(T.StringType()))
