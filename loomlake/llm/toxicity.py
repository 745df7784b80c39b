"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled texts becomes a block-max inverted index: examples that are led by the same word lie
together, postings per word in that order are cut into cells of BLOCK consecutive examples, each with its largest
weight. A query sums the cell maxima of its words to a bound for every block, reads the postings of the blocks by
falling bound and stops when the k-th best similarity reaches the next bound: postings of other blocks stay unread, and
the k nearest are exact. Their votes, weighted by squared cosine and shrunk to the base rate, are calibrated by a
logistic curve fitted to leave-one-out votes of examples.

Every word of a text counts, known or not. A word weighs (1 + ln tf) * idf * relevance, and relevance rises smoothly
from FLOOR to 1 with the word's association to the labels (G statistic): plain idf would let rare neutral words outvote
the words that the labels are about.

Results for odd input: null and empty texts, and texts that share no word with any example, get the smoothed rate of
the examples (of those without words, if there are any, for texts without words); ties go to the example with the
smaller id; repeated labelled texts count once per label; where all examples have one label, relevance is 1 and they
vote for it; without labels every score is 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import byte_texts, discard, in_arrow, stored, trim

#: Letters fold to lower case, other ASCII turns into a space, bytes of other letters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK = 256
#: Share of its idf that any word keeps, and the G statistic at which a word has about half of it.
FLOOR, HALF = 0.005, 22.0
EVIDENCE = 3


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs start .. start + size - 1, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def association(df: np.ndarray, df1: np.ndarray, n: int, n1: int) -> np.ndarray:
    """G statistic of each word's presence against the label: n texts, n1 of label 1; df texts with it, df1 of label 1."""
    total = np.zeros(len(df))
    for of, c in ((n1, df1), (n - n1, df - df1)):
        for seen, expected in ((c, df * of / n), (of - c, (n - df) * of / n)):
            some = seen > 0
            total[some] += seen[some] * np.log(seen[some] / expected[some])
    return 2 * np.maximum(total, 0.0)


@dataclass
class Nearest:
    """The block-max index of the sample with its votes and calibration. Vectors are (words' numbers, counts)."""

    terms: dict[bytes, int]
    ids: np.ndarray
    labels: np.ndarray
    k: int = 15
    shrink: float = 1.0
    most_votes: int = 2_000
    weight_of: np.ndarray = field(default_factory=lambda: np.empty(0))
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self) -> None:
        self.base = (self.labels.sum() + 0.5) / (len(self.labels) + 1) if len(self.labels) else 0.0
        self.empty_rate = self.base
        self.unknown = 0.0
        self.known: dict[bytes, tuple[float, list, list]] = {}

    def weigh(self, terms: np.ndarray, counts: np.ndarray, unknown: np.ndarray | None = None) -> np.ndarray:
        """Weights of a vector of length one; unknown: the counts of words that no example has."""
        w = (1 + np.log(counts)) * self.weight_of[terms]
        square = float(w @ w)
        if unknown is not None and len(unknown):
            square += float((((1 + np.log(unknown)) * self.unknown) ** 2).sum())
        return w / math.sqrt(square)

    def build(self, vectors: list[tuple[Sequence[int], Sequence[int]]]) -> Nearest:
        n, n1 = len(vectors), int(self.labels.sum())
        sizes = np.array([len(ts) for ts, _ in vectors], np.int64)
        own = [np.asarray(ts, np.int64) for ts, _ in vectors]
        none = np.empty(0, np.int64)
        term, of = np.concatenate([none, *own]), np.repeat(np.arange(n), sizes)
        df = np.bincount(term, minlength=len(self.terms)).astype(np.float64)
        df1 = np.bincount(term, self.labels[of], len(self.terms))
        squares = association(df, df1, n, n1) ** 2
        relevance = FLOOR + (1 - FLOOR) * squares / (squares + HALF**2) if 0 < n1 < n else np.ones(len(df))
        self.weight_of = (np.log((n + 1) / (df + 1)) + 1) * relevance
        self.unknown = (math.log(n + 1) + 1) * (FLOOR if 0 < n1 < n else 1.0)
        weights = [self.weigh(ts, np.asarray(ns)) if len(ts) else np.empty(0) for ts, (_, ns) in zip(own, vectors)]
        # examples of one leading word lie together, so that block maxima are near to what single examples have
        lead = np.array([ts[w.argmax()] if len(ts) else len(self.terms) for ts, w in zip(own, weights)], np.int64)
        self.example = np.lexsort((self.ids, lead))  # place -> example
        place = np.empty(n, np.int64)
        place[self.example] = np.arange(n)
        at, weight = place[of], np.concatenate([np.empty(0), *weights])
        order = np.lexsort((at, term))
        term, self.place, self.weight = term[order], at[order], weight[order]
        # a cell: the postings of one word in one block
        block = self.place // BLOCK
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(term)), bool), (np.diff(term) != 0) | (np.diff(block) != 0))))
        self.cell_block, self.cell_start = block[new], new
        self.cell_size = np.diff(np.append(new, len(term)))
        self.cell_top = np.maximum.reduceat(self.weight, new) if len(new) else np.empty(0)
        self.term_cells = np.searchsorted(term[new], np.arange(len(self.terms) + 1))
        self.n_blocks = n // BLOCK + 1
        self.read = 0
        empty = sizes == 0
        if empty.any():
            self.empty_rate = (self.labels[empty].sum() + self.base) / (empty.sum() + 1)
        self.calibrate(vectors)
        return self

    def nearest(self, terms: np.ndarray, q: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine (above zero) to a weighed query, and the cosines."""
        first = self.term_cells[terms]
        n = self.term_cells[terms + 1] - first
        cells, weight = ranges(first, n), np.repeat(q, n)
        block = self.cell_block[cells]
        bound = np.bincount(block, self.cell_top[cells] * weight, self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[: int((bound > 0).sum())]
        cos = np.zeros(len(self.example))
        kth, at, step = 0.0, 0, 4
        slack = 1e-9  # a bound may equal the cosine it stands for, up to rounding
        while at < len(order) and bound[order[at]] + slack >= kth:
            now = order[at : at + step]
            now = now[bound[now] + slack >= kth]
            chosen = np.zeros(self.n_blocks, bool)
            chosen[now] = True
            mine = np.flatnonzero(chosen[block])
            own, sizes = cells[mine], self.cell_size[cells[mine]]
            postings = ranges(self.cell_start[own], sizes)
            self.read += len(postings)
            cos += np.bincount(self.place[postings], self.weight[postings] * np.repeat(weight[mine], sizes), len(cos))
            at, step = at + step, step * 4
            if without >= 0:
                cos[without] = 0.0
            if len(cos) > self.k:
                kth = np.partition(cos, -self.k)[-self.k]
        found = np.flatnonzero((cos > 0) & (cos >= kth - slack))
        best = np.round(np.minimum(cos[found], 1.0), 12)
        examples = self.example[found]
        first = np.lexsort((self.ids[examples], -best))[: self.k]
        return examples[first], best[first]

    def vote(self, ids: np.ndarray, cos: np.ndarray) -> float:
        w = cos * cos
        return float((w @ self.labels[ids] + self.shrink * self.base) / (w.sum() + self.shrink))

    def calibrate(self, vectors: list[tuple[Sequence[int], Sequence[int]]]) -> None:
        """Logistic curve over the votes that most_votes examples get from the others; Newton steps on two numbers."""
        votes, labels = [], []
        place = np.argsort(self.example)
        for i in np.argsort([xxhash.xxh64_intdigest(str(x)) for x in self.ids], kind="stable")[: self.most_votes]:
            ts, ns = (np.asarray(x, np.int64) for x in vectors[i])
            if len(ts):
                votes.append(self.vote(*self.nearest(ts, self.weigh(ts, ns), place[i])))
                labels.append(self.labels[i])
        y = np.array(labels, float)
        if len(y) < 20 or not 0 < y.sum() < len(y):
            return
        x = _logit(np.array(votes))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            w = p * (1 - p)
            g = np.array([((p - y) * x).sum() + (a - 1), (p - y).sum() + b])  # held near the identity
            h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
            d = np.linalg.solve(h, g)
            a, b = a - d[0], b - d[1]
            if abs(d).max() < 1e-9:
                break
        if a > 0:
            self.slope, self.offset = float(a), float(b)

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and counts of the words that examples have, in order, and the counts of the others."""
        counts = Counter(words_of(text))
        number = self.terms.get
        terms = np.array([number(w, -1) for w in counts], np.int64)
        n = np.fromiter(counts.values(), np.int64, len(counts))
        order = terms.argsort(kind="stable")
        first = int((terms < 0).sum())
        return terms[order[first:]], n[order[first:]], n[order[:first]] if first else None

    def score(self, text: bytes) -> tuple[float, list[tuple[int, float, int]], list[int]]:
        """Calibrated score, the nearest examples (id, cosine, label) and the numbers of the heaviest words."""
        if not len(self.labels):
            return 0.0, [], []
        key = xxhash.xxh3_128_digest(text)
        if key not in self.known:
            terms, counts, unknown = self.vector(text)
            if not len(terms):
                return float(self.base if unknown is not None else self.empty_rate), [], []
            q = self.weigh(terms, counts, unknown)
            ids, cos = self.nearest(terms, q)
            p = 1 / (1 + math.exp(-(self.slope * _logit(self.vote(ids, cos)) + self.offset)))
            if len(self.known) >= 5_000:
                self.known.clear()
            near = [(int(self.ids[i]), float(c), int(self.labels[i])) for i, c in zip(ids[:EVIDENCE], cos[:EVIDENCE])]
            self.known[key] = (p, near, terms[np.argsort(-q, kind="stable")[:EVIDENCE]].tolist())
        return self.known[key]


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words, a space between, and their counts as 32-bit numbers."""
    for batch in batches:
        counts = [Counter(words_of(t)) for t in byte_texts(batch.column(1))]
        words = pa.array([b" ".join(c) for c in counts], pa.binary())
        numbers = pa.array([np.fromiter(c.values(), "<u4", len(c)).tobytes() for c in counts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), words, numbers], ["id", "label", "words", "counts"])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_examples: int = 4_096,
    k: int = 15,
) -> Nearest:
    """The index over a sample of at most about max_examples of labels (id, label 0 or 1), chosen by hash of the id.

    Only the number of labelled rows is bounded; all words of their whole texts are in the index."""
    given = labels.select(F.col("id").cast("long"), F.col("label").cast("int")).where("id is not null and label in (0, 1)")
    n = given.count()
    share = min(1.0, 0.97 * max_examples / n) if n > max_examples else 1.0
    sample = given.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # at most about max_examples rows of two numbers: the broadcast is bounded
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(sample), "id").withColumn("same", F.xxhash64("text"))
    # one row a text and label: that of the smallest id
    texts = texts.groupBy("same", "label").agg(F.min_by("text", "id").alias("text"), F.min("id").alias("id"))
    texts = stored(texts.select("id", "text", "label"), "toxicity-sample")
    rows = in_arrow(texts, _vectors, "id long, label int, words binary, counts binary").collect()  # the sample
    discard(texts)
    rows.sort(key=lambda r: (r.id, r.label))
    ids, own = np.array([r.id for r in rows], np.int64), np.array([r.label for r in rows], np.int64)
    terms: dict[bytes, int] = {}
    vectors = []
    while rows:  # the texts go as their vectors come
        r = rows.pop()
        found = np.array([terms.setdefault(w, len(terms)) for w in bytes(r.words).split()], np.int64)
        rank = found.argsort()
        vectors.append((found[rank], np.frombuffer(r.counts, "<u4").astype(np.int64)[rank]))
    trim()
    return Nearest(terms, ids, own, k).build(vectors[::-1])


SCORED = (
    "id long, score double, predicted int, evidence array<struct<example:long,similarity:double,label:int>>, terms array<string>"
)


def _scores(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        spelled = [w.decode(errors="replace") for w in own.terms]
        near = pa.list_(pa.struct([("example", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
        for batch in batches:
            found = [own.score(t) for t in byte_texts(batch.column(1))]
            scores = np.array([f[0] for f in found])
            evidence = [[{"example": e, "similarity": s, "label": y} for e, s, y in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(scores),
                    pa.array((scores >= 0.5).astype(np.int32)),
                    pa.array(evidence, near),
                    pa.array([[spelled[t] for t in f[2]] for f in found], pa.list_(pa.string())),
                ],
                ["id", "score", "predicted", "evidence", "terms"],
            )
            del batch, found
            trim()

    return run


def score(docs: DataFrame, index: Nearest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, evidence, terms) of every document: its nearest examples and its heaviest words."""
    sent = docs.sparkSession.sparkContext.broadcast(index)  # max_examples vectors
    pair = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return in_arrow(pair, _scores(sent), SCORED)


def keep_clean(docs: DataFrame, index: Nearest, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below least."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(t)[0] < least for t in byte_texts(batch.column(at))], pa.bool_()))
            del batch
            trim()

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots would not resolve
    return in_arrow(plain, run, plain.schema).toDF(*docs.columns)
