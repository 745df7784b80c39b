"""Secret scans in DataFrame functions only: fixed patterns, and a randomness test battery for other tokens.

Positions come from cutting the text at the matches: the lengths of the pieces and of the matches, added up, are the
code point offsets. What the base spans leave of a token has its encoding inferred (hex, base 32, 36, 62 or 64) and
is tested against a uniform draw from that alphabet: chi-squared over the symbols, runs above and below the middle,
serial correlation of neighbours; the smallest of the three p-values counts three times. Among all tokens of a
length class, Benjamini-Hochberg over a histogram of p-values sets structured tokens aside, so that at most
FALSE_SHARE of those set aside are expected to be random. What is left and carries LEAST_BITS is a `random` span.

The texts are scanned once: spans and tokens with their p-values are written down, a histogram of them (bounded: length
classes times bins) gives the cut, and the cut is applied to what was written.

What the cut doesn't set aside is flagged, so tokens too short to be told apart from random ones are flagged as well:
an error of this kind hides a code or an identifier, one of the other kind shows a key.

Results for odd input: null and empty texts have no spans; equal rows have equal results; null ids are kept; an
empty table gives no rows; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import fresh, stored

# The base patterns and the least lengths of their matches.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_-]{20,}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (rule, alphabet): the first rule that a token follows gives its encoding; all but hex ask for digits and letters.
ENCODINGS = (
    (r"^(?=.*[a-f])(?=.*[0-9])[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^(?=.*[A-F])(?=.*[0-9])[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^(?=.*[A-Z])(?=.*[2-7])[A-Z2-7]+$", UPPER + "234567"),
    (r"^(?=.*[A-Z])(?=.*[0-9])[0-9A-Z]+$", DIGITS + UPPER),
    (r"^(?=.*[a-z])(?=.*[0-9])[0-9a-z]+$", DIGITS + LOWER),
    (r"^(?=.*[A-Z])(?=.*[0-9])[0-9A-Z_-]+$", DIGITS + UPPER + "-_"),
    (r"^(?=.*[a-z])(?=.*[0-9])[0-9a-z_-]+$", DIGITS + LOWER + "-_"),
    (r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    (r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    (r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
LEAST_BITS = 80.0
FALSE_SHARE = 0.05
BINS_PER_DECADE, MOST_BIN = 20, 400
SCAN = 256


def _scan(values: Column, first: Column) -> Column:
    """Sums of the values before each one, plus first."""
    return F.aggregate(
        values,
        F.struct(first.cast("int").alias("sum"), F.array().cast("array<int>").alias("out")),
        lambda a, v: F.struct((a["sum"] + v).cast("int").alias("sum"), F.array_append(a["out"], a["sum"]).alias("out")),
        lambda a: a["out"],
    )


def sums_before(values: Column) -> Column:
    """Exclusive running sums in two levels, so that long arrays don't copy themselves for each element."""
    runs = F.when(
        F.size(values) > 0,
        F.transform(
            F.sequence(F.lit(0), F.floor((F.size(values) - 1) / SCAN).cast("int")),
            lambda c: F.slice(values, c * SCAN + 1, F.lit(SCAN)),
        ),
    ).otherwise(F.array().cast("array<array<int>>"))
    totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, v: a + v))
    return F.flatten(F.zip_with(runs, _scan(totals, F.lit(0)), lambda r, s: _scan(r, s)))


def _with_matches(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Column out: array of (start, end, hit) of the pattern's leftmost matches, in code points."""
    df = df.withColumn(f"{out}h", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    some = F.size(f"{out}h") > 0
    pieces = F.transform(F.split(F.col(text), pattern, -1), lambda p: F.length(p))
    df = df.withColumn(f"{out}p", F.when(some, pieces))
    df = df.withColumn(f"{out}l", F.when(some, F.transform(f"{out}h", lambda h: F.length(h))))
    steps = F.zip_with(F.slice(F.col(f"{out}p"), 2, F.size(f"{out}h")), F.col(f"{out}l"), lambda p, n: p + n)
    df = df.withColumn(f"{out}s", F.when(some, steps))
    first = F.element_at(f"{out}p", 1)
    spans = F.zip_with(
        F.zip_with(F.when(some, sums_before(F.col(f"{out}s"))), F.col(f"{out}l"), lambda s, n: F.struct((s + first).alias("s"), (s + first + n).alias("e"))),
        F.col(f"{out}h"),
        lambda x, h: F.struct(x["s"].alias("start"), x["e"].alias("end"), h.alias("hit")),
    )
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return df.withColumn(out, F.coalesce(spans, none)).drop(f"{out}h", f"{out}p", f"{out}l", f"{out}s")


def _span(x: Column, kind: str) -> Column:
    return F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")
    )


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0, by the usual rational approximation of the error function."""
    x = z / 2**0.5
    t = 1 / (1 + 0.5 * x)
    # Coefficients of the approximation, lowest power first.
    poly = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    total = F.lit(poly[-1])
    for c in reversed(poly[:-1]):
        total = total * t + c
    return 0.5 * t * F.exp(total - x * x)


def _pairs(x: Column, of) -> Column:
    """Sum of `of` over neighbouring elements."""
    n = F.size(x) - 1
    return F.aggregate(F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(2), n), of), F.lit(0.0), lambda a, v: a + v)


def battery(codes: Column, k: Column) -> Column:
    """p-value of symbol codes under a uniform draw from k symbols: thrice the least of three tests'."""
    n, d, mid = F.size(codes).cast("double"), k - 1, (k - 1) / 2
    squares = F.aggregate(
        F.sequence(F.lit(0), d.cast("int")),
        F.lit(0.0),
        lambda a, v: a + F.pow(F.size(F.filter(codes, lambda y: y == v)).cast("double"), 2),
    )
    # Wilson-Hilferty: the cube root of chi-squared over its mean is nearly normal
    z_chi = (F.pow(F.greatest(k / n * squares - n, F.lit(0.0)) / d, 1 / 3) - (1 - 2 / (9 * d))) / F.sqrt(2 / (9 * d))
    turns = _pairs(codes, lambda a, b: ((a < k / 2) != (b < k / 2)).cast("double"))
    z_runs = (turns - (n - 1) / 2) / (F.sqrt(n - 1) / 2)
    products = _pairs(codes, lambda a, b: (a - mid) * (b - mid))
    z_serial = products / (F.sqrt(n - 1) * ((k * k - 1) / 12))
    # the least p-value belongs to the largest statistic
    return F.least(F.lit(1.0), 6 * _normal_tail(F.greatest(F.abs(z_chi), F.abs(z_runs), F.abs(z_serial))))


def _alphabet(token: Column) -> Column:
    found = F.lit(None).cast("string")
    for rule, alphabet in reversed(ENCODINGS):
        found = F.when(token.rlike(rule), F.lit(alphabet)).otherwise(found)
    return found


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS_PER_DECADE).cast("int"), F.lit(MOST_BIN))


def _length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n.cast("double"))).cast("int"), F.lit(16))


def _blanked(text: Column, spans: Column) -> Column:
    """text with the spans, in order of their starts, as blanks: offsets stay."""
    made = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    a["out"],
                    F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))),
                    F.repeat(F.lit(" "), s["end"] - F.greatest(s["start"], a["at"])),
                ).alias("out"),
            )
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, made).otherwise(text)


def scanned(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(_row, _found): the kept columns of each row (all, if not told) as a struct, its base spans and tested tokens."""
    names = docs.columns if keep is None else keep
    row = F.struct(*(F.col(f"`{c}`") for c in names)) if names else F.struct(F.lit(0).alias("none"))
    df = docs.select(row.alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    for pattern, out in ((ASSIGN, "_a"), (ACCESS, "_k"), (HEX, "_x")):
        df = _with_matches(df, "_t", pattern, out)
    long_enough = F.filter("_a", lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= ASSIGN_LEAST)
    spans = F.concat(
        F.transform(long_enough, lambda x: _span(x, "assign")),
        F.transform("_k", lambda x: _span(x, "access")),
        F.transform("_x", lambda x: _span(x, "hex")),
    )
    df = df.withColumn("_b", F.array_sort(spans)).withColumn("_t", _blanked(F.col("_t"), F.col("_b")))
    df = _with_matches(df, "_t", TOKEN, "_o")
    df = df.withColumn("_o", F.filter("_o", lambda x: x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]")))

    coded = F.transform("_o", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), _alphabet(x["hit"]).alias("symbols")))
    heavy = F.filter(coded, lambda x: F.length(x["hit"]) * F.log2(F.length(x["symbols"]).cast("double")) >= LEAST_BITS)
    df = df.withColumn(
        "_c",
        F.transform(
            heavy,
            lambda x: F.struct(
                x["start"].alias("start"),
                x["end"].alias("end"),
                F.transform(F.split(x["hit"], ""), lambda c: F.instr(x["symbols"], c) - 1).alias("codes"),
                F.length(x["symbols"]).cast("double").alias("k"),
            ),
        ),
    )
    tested = F.transform(
        "_c",
        lambda x: F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            _bin(battery(x["codes"], x["k"])).alias("bin"),
            _length_class(F.size(x["codes"])).alias("class"),
        ),
    )
    return df.select("_row", F.struct(F.col("_b").alias("base"), tested.alias("tokens")).alias("_found"))


def cutoffs(found: DataFrame) -> dict[int, int]:
    """By length class the least bin of p-values that is set aside as structured; found as scanned() gives it."""
    tokens = found.select(F.explode("_found.tokens").alias("x"))
    rows = tokens.groupBy("x.class", "x.bin").agg(F.count("*").alias("n")).collect()  # at most 17 x 401 rows
    by: dict[int, dict[int, int]] = {}
    for r in rows:
        by.setdefault(r["class"], {})[r["bin"]] = r["n"]
    cuts = {}
    for length, bins in by.items():
        m, above = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if b and 10 ** (-b / BINS_PER_DECADE) * m <= FALSE_SHARE * above:
                cuts[length] = b
    return cuts


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "secret_spans", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all, if not told) with struct column out: base and all spans, arrays of (start, rank,
    end, kind) in order. A kept column of the name out is replaced."""
    names = [c for c in (docs.columns if keep is None else keep) if c != out]
    found = stored(scanned(docs, text_col, names), "secret-spans")
    cuts = cutoffs(found)
    limits = F.create_map(*(F.lit(x) for pair in cuts.items() for x in pair)) if cuts else None

    def keeps(x):
        if limits is None:
            return F.lit(True)
        return x["bin"] < F.coalesce(limits[x["class"]], F.lit(MOST_BIN + 1))

    kept = F.transform(F.filter("_found.tokens", keeps), lambda x: _span(x, "random"))
    every = F.array_sort(F.concat(F.col("_found.base"), kept))
    return found.select(
        *(F.col("_row").getField(c).alias(c) for c in names), F.struct(F.col("_found.base").alias("base"), every.alias("all")).alias(out)
    )


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each run of overlapping spans in the text replaced by the mark; its columns are those of docs."""
    text, out = F.col(f"`{text_col}`"), fresh("spans", docs.columns)
    made = F.aggregate(
        F.col(f"{out}.all"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    new = F.when(F.size(f"{out}.all") > 0, made).otherwise(text)
    found = with_spans(docs, text_col, out)
    return found.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
