"""Quality rules: a decision list learned by sequential covering, in DataFrame functions only.

Each document becomes a few numbers. For the labelled ones these are cut at percentiles and counted by cell and label,
so learning works on counts, however many labels there are. A rule is a conjunction of thresholds: the test of
largest FOIL gain on the growing fold is added until the rule is pure or nothing gains; then the pruning fold picks
the prefix of largest (bad - good) / (bad + good). A rule that holds up there is kept, the cells that it covers leave,
and the next one is grown. The list is one ordered conditional expression: the number of the first rule that holds.

Each step is one aggregation that returns a row for each feature and bin at most.

Results for odd input: null and empty texts have no words and fail the base rule; labels other than 0 and 1 and of
unknown ids are not used; without labels there are no rules; equal rows have equal results; an empty table gives no
rows; other columns are not read. Windows of three words are compared by 64-bit hash within their text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import SPACES, discard, stored

# The symbols and limits of the base rule.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_bangs")


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the COUNTS) of every whole text."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    plain = F.col("t")
    for c in SPACES[1:]:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    df = df.withColumn("flat", plain).withColumn("w", F.array_remove(F.split("flat", " "), ""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.select(
        "id",
        "w",
        F.size("w").alias("n"),
        F.length(F.replace("flat", F.lit(" "), F.lit(""))).alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).alias("n_symbols"),
        (F.length("t") - F.length(_without(F.col("t"), "!"))).alias("n_bangs"),
        lines.alias("lines"),
    )
    window = F.transform(
        F.sequence(F.lit(1), F.col("n") - 2),
        lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)),
    )
    df = df.withColumn("h", F.when(F.col("n") >= 4, window)).withColumn("n_distinct", F.size(F.array_distinct("w")))
    some = F.size(F.array_distinct("h")) < F.size("h")
    df = df.withColumn("s", F.when(some, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))

    def twin(x, j):
        before = F.when(j > 0, F.get("s", j - 1)["x"] == x["x"]).otherwise(False)
        return before | F.coalesce(F.get("s", j + 1)["x"] == x["x"], F.lit(False))

    at = F.array_sort(F.transform(F.filter("s", twin), lambda x: x["i"]))
    df = df.withColumn("p", F.when(F.col("s").isNotNull(), at))
    # each repeated window covers three words, less what the next one covers too
    gaps = F.zip_with(
        F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.least(b - a, F.lit(3))
    )
    covered = F.when(F.col("p").isNotNull(), F.aggregate(gaps, F.lit(3), lambda a, v: a + v)).otherwise(0)
    numbers = {
        "n_words": F.col("n"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": covered,
        "n_lines": F.size("lines"),
    }
    return df.select("id", *(numbers.get(c, F.col(c)).cast("long").alias(c) for c in COUNTS))


def shares() -> dict[str, Column]:
    """The numbers that rules test, from the counts."""

    def of(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": of("word_chars", "n_words"),
        "symbol_share": of("n_symbols", "word_chars"),
        "bang_share": of("n_bangs", "word_chars"),
        "dup_line_share": of("n_dup_lines", "n_lines"),
        "repeat_share": of("n_repeat_words", "n_words"),
        "distinct_share": of("n_distinct", "n_words"),
        "words_per_line": of("n_words", "n_lines"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """feature >= limit, or feature < limit; bin is the limit's number among the feature's cuts."""

    feature: str
    bin: int
    above: bool
    limit: float

    def on_cells(self) -> Column:
        b = F.col(f"b_{self.feature}")
        return b >= self.bin if self.above else b < self.bin

    def on_rows(self, numbers: dict[str, Column]) -> Column:
        x = numbers[self.feature]
        return x >= self.limit if self.above else x < self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.limit:.6g}"


Rule = tuple[Test, ...]


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def learn(
    labelled: DataFrame,
    numbers: dict[str, Column],
    fold: Column,
    cuts: int = 24,
    max_rules: int = 12,
    max_tests: int = 4,
    least_precision: float = 0.8,
    least_support: int = 5,
) -> list[Rule]:
    """Rules for the rows with label 0, from rows with a label column and a fold (0 and 1 grow, 2 prunes)."""
    levels = F.array(*(F.lit(i / cuts) for i in range(1, cuts)))
    found = labelled.select(*(F.percentile_approx(x, levels, F.lit(10_000)).alias(f) for f, x in numbers.items())).first()
    if found is None or found[0] is None:
        return []
    # the ends of the scale get a limit of their own: shares are mostly 0
    limits = {f: sorted({*found[f], *(x + 1e-9 for x in found[f][:1])}) for f in numbers}
    bins = [
        sum(((numbers[f] >= v).cast("int") for v in limits[f]), F.lit(0)).alias(f"b_{f}") for f in numbers
    ]
    cells = labelled.select(*bins, (fold == 2).alias("prune"), "label").groupBy(*(f"b_{f}" for f in numbers), "prune")
    cells = stored(cells.agg(F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") == 1).alias("good")), "rules")
    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        rule: Rule = ()
        while len(rule) < max_tests:
            test = _best_test(cells.where(~F.col("prune") & left & _all(t.on_cells() for t in rule)), limits, least_support)
            if test is None:
                break
            rule += (test[0],)
            if test[1]:
                break
        if not rule:
            break
        rule = _pruned(cells.where(F.col("prune") & left), rule, least_precision, least_support)
        if not rule:
            break
        rules.append(rule)
        left = left & ~_all(t.on_cells() for t in rule)
    discard(cells)
    return rules


def _best_test(cells: DataFrame, limits: dict[str, list[float]], least_support: int) -> tuple[Test, bool] | None:
    """The test of largest FOIL gain, and whether it leaves no good rows; None if nothing gains."""
    stack = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in limits)))
    rows = cells.select(stack.alias("x"), "bad", "good").groupBy("x.f", "x.b").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts: dict[str, dict[int, tuple[int, int]]] = {}
    for r in rows.collect():  # a row for each feature and bin at most
        counts.setdefault(r.f, {})[r.b] = (r.bad, r.good)
    best, choice = 1e-9, None
    for f in sorted(counts):
        bad, good = (sum(v[i] for v in counts[f].values()) for i in (0, 1))
        if not bad or not good:
            return None
        start = math.log2(bad / (bad + good))
        low = [0, 0]
        for b in range(1, len(limits[f]) + 1):
            for i in (0, 1):
                low[i] += counts[f].get(b - 1, (0, 0))[i]
            for above, p, n in ((False, low[0], low[1]), (True, bad - low[0], good - low[1])):
                if p < least_support or p + n == bad + good:
                    continue
                gain = p * (math.log2(p / (p + n)) - start)
                if gain > best:
                    best, choice = gain, (Test(f, b, above, limits[f][b - 1]), n == 0)
    return choice


def _pruned(cells: DataFrame, rule: Rule, least_precision: float, least_support: int) -> Rule:
    """The rule's best prefix on the pruning fold; empty if it does not hold up there."""
    sums = []
    for k in range(1, len(rule) + 1):
        holds = _all(t.on_cells() for t in rule[:k])
        sums += [F.sum(F.when(holds, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in ("bad", "good")]
    r = cells.agg(*sums).first()
    worth = [((bad - good) / (bad + good) if (bad := r[f"bad{k}"] or 0) + (good := r[f"good{k}"] or 0) else -1.0) for k in range(1, len(rule) + 1)]
    k = max(range(len(rule)), key=lambda i: (worth[i], -i))
    if (worth[k] + 1) / 2 < least_precision or (r[f"bad{k + 1}"] or 0) < max(1, least_support // 3):
        return ()
    return rule[: k + 1]


def first_rule(rules: list[Rule], numbers: dict[str, Column]) -> Column:
    """The number, from 1, of the first rule that holds; 0 if none does."""
    out = F.lit(0)
    for i in range(len(rules), 0, -1):
        out = F.when(_all(t.on_rows(numbers) for t in rules[i - 1]), F.lit(i)).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[Rule]]:
    """(id, the COUNTS, base_failed, rule, kept) of every document, and the rules; labels has id and label (1 is good)."""
    counts = stored(counted(docs, id_col, text_col), "rules-counts")
    numbers = shares()
    known = labels.select(F.col("id").alias("of"), "label").where("label in (0, 1)")
    labelled = counts.join(known, counts.id == known.of)
    rules = learn(labelled, numbers, F.crc32(F.col("of").cast("string")) % 3)
    out = counts.select("id", *COUNTS, base_failed().alias("base_failed"), first_rule(rules, numbers).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
