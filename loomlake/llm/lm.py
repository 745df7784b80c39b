"""Language-model scoring with a weighted backoff automaton over smoothed n-grams.

Training counts come from the whole corpus. States are the n-grams seen in training that are shorter than the order
(the start of a text counts as a word in front), and the root. A seen n-gram h w is an arc from state h over word w to
the longest state that the text then ends in; it weighs log10 p(w | h) = log10((c(hw) + K p(w | h')) / (c(h) + K)),
h' being h without its first word. A state without an arc for the word takes its failure arc to h', which weighs
log10(K / (c(h) + K)), and so on down to the root, which reads word w with p(w) = (c(w) + 1) / (N + V + 1). Arcs and
failures of a state add up to one. A text is read once from left to right: the state is carried, logs add up.

The automaton is as large as the corpus, so it is never broadcast. Texts are dealt into blocks of bounded size. A block
sends its distinct n-grams, as sorted 63-bit hashes with its training counts, in one pack for each hash range; the task
of a range adds up and answers every pack in its own order. The answers meet the block's texts again and give exactly
the part of the automaton that these can reach. A hot n-gram is one entry a block. With more than FAN ranges, blocks
don't meet ranges directly, for that would be blocks times ranges packs: groups of blocks and of ranges form cells of
about as many as there are ranges; a block sends one pack to each of its cells (at most FAN), a cell merges its packs
and asks the ranges as if it were a block, and hands the answers out.

Blocks are numbered by scan partition; a checksum over the hashes proves that both scans saw the same ones.

Results for odd input: null and empty texts are one end token; null ids count as id text '' for the split; equal texts
have equal scores; without training texts N = V = 0 and every score is finite; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import byte_texts, in_arrow, shuffle_partitions, stored, trim

BLOCK_BYTES = 8 << 20
ORDER = 2
#: Weight of the lower order in each state, in counts.
BACKOFF = 50.0
#: Most packs that a block sends.
FAN = 512
ASKED = "place int, block long, pack binary, check long, tokens long, texts long"
ANSWERED = "place int, block long, pack binary, check long, distinct long, tokens long, texts long"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(v, _TYPES[t]) for v, t in zip(columns, types)], list(names))


@dataclass
class Grams:
    """The distinct n-grams of one length: number of the context (all but the last word) and of the last word, of the
    suffix (all but the first word), hash, and count in training texts."""

    context: np.ndarray
    word: np.ndarray
    suffix: np.ndarray
    hash: np.ndarray
    train: np.ndarray


@dataclass
class Block:
    """Texts as word numbers; word 0 is the end. grams[0] are pairs; the number of words as context is the start."""

    tokens: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    word_hash: np.ndarray
    word_train: np.ndarray
    grams: list[Grams]

    def keys(self) -> np.ndarray:
        """Hashes of all n-grams; the last bit tells words."""
        longer = [g.hash & ~np.uint64(1) for g in self.grams]
        return np.concatenate([self.word_hash | np.uint64(1), *longer])

    def train(self) -> np.ndarray:
        return np.concatenate([self.word_train, *(g.train for g in self.grams)])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_of(texts: list[bytes], train: np.ndarray, order: int = ORDER) -> Block:
    """The n-grams of some texts with their counts in the training ones; the same for the same texts."""
    number: dict[bytes, int] = {b"": 0}
    add = number.setdefault
    seen: list[int] = []
    sizes = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        sizes[i] = len(words) + 1
        seen += [add(w, len(number)) for w in words]
        seen.append(0)
    tokens = np.array(seen, np.int32)
    del seen
    starts = np.cumsum(sizes) - sizes
    n = len(number)
    digest = xxhash.xxh64_intdigest
    word_hash = np.fromiter((digest(w) for w in number), np.uint64, n)
    del number
    in_train = np.repeat(train, sizes)
    block = Block(tokens, starts, sizes, word_hash, np.bincount(tokens[in_train], minlength=n), [])
    # own[i]: number of the n-gram that ends at token i, -1 where the text is too short for it
    own, hashes = tokens, np.append(word_hash, np.uint64(digest(b"\0start")))
    for length in range(2, order + 1):
        before = np.empty(len(tokens), np.int64)
        before[1:] = own[:-1]
        before[starts] = n if length == 2 else -1
        key = np.where(before < 0, -1, before * n + tokens)
        rank = np.argsort(key, kind="stable")
        key = key[rank]
        none = int(np.searchsorted(key, 0))
        rank, key = rank[none:], key[none:]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        pairs = key[new]
        context, word = pairs // n, pairs % n
        counts = np.add.reduceat(in_train[rank].astype(np.int64), new) if len(new) else np.empty(0, np.int64)
        suffix = own[rank[new]].astype(np.int64)
        hashes = _mixed(hashes[context], word_hash[word])
        block.grams.append(Grams(context, word, suffix, hashes, counts))
        if length < order:
            mine = np.full(len(tokens), -1, np.int64)
            mine[rank] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(rank))))
            own = mine
    return block


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences and counts, byte by byte of all of them, so that the zeros go."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    numbers = counts.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(steps.tobytes() + numbers.tobytes())


def unpacked(pack: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(pack), np.uint8)
    both = np.ascontiguousarray(data.reshape(2, 8, -1).transpose(0, 2, 1)).view("<u8")[..., 0]
    return np.cumsum(both[0], dtype=np.uint64), both[1].astype(np.int64)


def _numbers(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _from_numbers(pack: bytes) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(pack), np.uint8)
    return np.ascontiguousarray(data.reshape(8, -1).T).view("<u8")[:, 0].astype(np.int64)


def bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """Bounds of n equal hash ranges among sorted keys."""
    limits = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, limits), [len(keys)]))


def _check(keys: np.ndarray) -> int:
    return zlib.crc32(keys.tobytes())


@dataclass(frozen=True)
class Places:
    """Where packs go: ranges 0 .. ranges - 1; with more than FAN of them, cells (group of ranges, group of blocks)."""

    ranges: int
    fan: int = FAN

    @property
    def cells(self) -> bool:
        return self.ranges > self.fan

    @property
    def groups(self) -> int:
        """Groups of ranges, so packs of a block."""
        return min(self.fan, math.isqrt(self.ranges - 1) + 1) if self.cells else self.ranges

    @property
    def inner(self) -> int:
        """Ranges of a group, and groups of blocks."""
        return -(-self.ranges // self.groups)

    def of(self, block: int) -> list[int]:
        """The places of a block's packs, in order of hashes."""
        if not self.cells:
            return list(range(self.ranges))
        bundle = zlib.crc32(block.to_bytes(8, "little")) % self.inner
        return [g * self.inner + bundle for g in range(self.groups)]


def _in_blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list, list[bytes], np.ndarray]]:
    """(block number, ids, texts, training flags), dealt alike in every pass over the same scan."""
    part, number = TaskContext.get().partitionId(), 0
    ids, texts, train, held = [], [], [], 0
    for batch in batches:
        for i, text, own in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), batch.column(2).to_pylist()):
            if texts and held + len(text) > limit:
                yield (part << 32) + number, ids, texts, np.array(train, bool)
                ids, texts, train, held, number = [], [], [], 0, number + 1
            ids.append(i)
            texts.append(text)
            train.append(own)
            held += len(text)
    if texts:
        yield (part << 32) + number, ids, texts, np.array(train, bool)


def _ask(places: Places, limit: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts, train in _in_blocks(batches, limit):
            block = block_of(texts, train, order)
            keys, counts = block.keys(), block.train()
            check, rank = _check(keys), np.argsort(keys, kind="stable")
            keys, counts, to = keys[rank], counts[rank], places.of(number)
            cut, n = bounds(keys, len(to)), len(to)
            packs = [packed(keys[a:b], counts[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            rest = [0] * (n - 1)
            totals = ([int(block.sizes[train].sum()), *rest], [int(train.sum()), *rest])
            del block, keys, counts, rank
            yield _batch(ASKED, [to, [number] * n, packs, [check] * n, *totals])
            trim()

    return run


def _by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each place; rows come sorted."""
    rows: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and rows[0]["place"] != r["place"]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _summed(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys of some packs, their totals, the place of each entry among them, and the bounds of the packs."""
    parts = [unpacked(p) for p in packs]
    cut = np.cumsum([0, *(len(k) for k, _ in parts)]).tolist()
    found, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return found, np.bincount(at, np.concatenate([c for _, c in parts]), len(found)).astype(np.int64), at, cut


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_place(batches):
        keys, total, at, cut = _summed([r["pack"] for r in rows])
        distinct = int(((total > 0) & ((keys & np.uint64(1)) == 1)).sum())
        for i, r in enumerate(rows):
            own = _numbers(total[at[cut[i] : cut[i + 1]]])
            yield _batch(ANSWERED, [[r["place"]], [r["block"]], [own], [r["check"]], [0 if i else distinct], [r["tokens"]], [r["texts"]]])
        del keys, total, at, rows
        trim()


def _merge(places: Places):
    """Cells ask the ranges of their group: place is the range, block the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_place(batches):
            cell = rows[0]["place"]
            keys, total, _, _ = _summed([r["pack"] for r in rows])
            cut, group = bounds(keys, places.groups * places.inner), cell // places.inner
            to = range(group * places.inner, (group + 1) * places.inner)
            packs = [packed(keys[cut[r] : cut[r + 1]], total[cut[r] : cut[r + 1]]) for r in to]
            n = len(packs)
            sums = [[sum(r[c] for r in rows), *[0] * (n - 1)] for c in ("tokens", "texts")]
            yield _batch(ASKED, [list(to), [cell] * n, packs, [0] * n, *sums])
            del keys, total, rows
            trim()

    return run


def _hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to a cell, then the packs of its blocks: answers to the blocks. block is -1 - range for answers."""
    for rows in _by_place(batches):
        own = [r for r in rows if r["kind"]]
        keys, _, at, cut = _summed([r["pack"] for r in own])
        answers = sorted((r for r in rows if not r["kind"]), key=lambda r: r["block"])
        total = np.concatenate([_from_numbers(r["pack"]) for r in answers])
        if len(total) != len(keys):
            raise RuntimeError("a cell's answers don't fit its packs")
        for i, r in enumerate(own):
            yield _batch(ANSWERED, [[r["place"]], [r["block"]], [_numbers(total[at[cut[i] : cut[i + 1]]])], [r["check"]], [0], [0], [0]])
        del keys, total, at, rows, own
        trim()


class Automaton:
    """The reachable part of the model for one block. State 0 is the root, 1 the start, then words, pairs and so on."""

    def __init__(self, block: Block, totals: np.ndarray, tokens: int, distinct: int, texts: int, backoff: float = BACKOFF):
        n, order = len(block.word_hash), len(block.grams) + 1
        self.n, self.order = n, order
        counts, at = [totals[:n]], n
        for g in block.grams:
            counts.append(totals[at : at + len(g.hash)])
            at += len(g.hash)
        p = [(counts[0] + 1) / (tokens + distinct + 1)]
        self.root_weight = np.log10(p[0])
        # numbers of the states of each length's n-grams; an n-gram never seen in training is none: its suffix goes on
        first = np.cumsum([2, *(len(c) for c in counts)])
        state = [np.where(counts[0] > 0, first[0] + np.arange(n), 0)]
        state[0][0] = 0  # nothing follows the end
        self.next_of_root = state[0]
        size = int(first[order - 1])
        self.failure, self.fail_to = np.zeros(size), np.zeros(size, np.int64)
        self.failure[1] = math.log10(backoff / (texts + backoff))
        self.failure[2 : 2 + n] = np.log10(backoff / (counts[0] + backoff))
        arcs, weights, ends = [], [], []
        for i, g in enumerate(block.grams):
            follows = np.append(counts[0], texts) if i == 0 else counts[i]
            p.append((counts[i + 1] + backoff * p[i][g.suffix]) / (follows[g.context] + backoff))
            seen = counts[i + 1] > 0
            if i + 2 < order:
                own = np.where(seen, first[i + 1] + np.arange(len(seen)), state[i][g.suffix])
                own[g.word == 0] = 0
                a, b = int(first[i + 1]), int(first[i + 2])
                self.failure[a:b] = np.log10(backoff / (counts[i + 1] + backoff))
                self.fail_to[a:b] = state[i][g.suffix]
                state.append(own)
                to = own
            else:
                to = state[i][g.suffix]
            origin = (np.append(state[0], 1) if i == 0 else state[i])[g.context[seen]]
            arcs.append(origin * n + g.word[seen])
            weights.append(np.log10(p[i + 1][seen]))
            ends.append(to[seen])
        arcs, weights, ends = (np.concatenate(x) for x in (arcs, weights, ends))
        rank = np.argsort(arcs, kind="stable")
        self.arcs = np.append(arcs[rank], np.iinfo(np.int64).max)
        self.weights, self.ends = np.append(weights[rank], 0.0), np.append(ends[rank], 0)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and next states of reading a word in each state."""
        total, after = np.zeros(len(state)), np.empty(len(state), np.int64)
        left, now = np.arange(len(state)), state
        while len(left):
            read = word[left]
            key = now * self.n + read
            at = np.searchsorted(self.arcs, key)
            root, hit = now == 0, (self.arcs[at] == key) & (now > 0)
            total[left[hit]] += self.weights[at[hit]]
            after[left[hit]] = self.ends[at[hit]]
            total[left[root]] += self.root_weight[read[root]]
            after[left[root]] = self.next_of_root[read[root]]
            go = ~(hit | root)
            left, now = left[go], now[go]
            total[left] += self.failure[now]
            now = self.fail_to[now]
        return total, after

    def traverse(self, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each text; all texts are read in step, each carrying its state."""
        order = np.argsort(-sizes, kind="stable")
        first, left = starts[order], sizes[order]
        state = np.ones(len(order), np.int64)
        total = np.zeros(len(order))
        for t in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -t, side="left"))  # texts longer than t
            got, state[:live] = self.step(state[:live], tokens[first[:live] + t])
            total[:live] += got
        out = np.empty_like(total)
        out[order] = total
        return out


SCORED = "id long, n_tokens long, n_known long, base_score double, score double"
MET = "place int, block long, pack binary, check long, sizes binary, ids array<long>, train binary"


def _payload(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts, train in _in_blocks(batches, limit):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1], pa.int32()),
                    pa.array([number], pa.int64()),
                    pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(texts))], pa.binary()),
                    pa.array([0], pa.int64()),
                    pa.array([np.array([len(t) for t in texts], "<i8").tobytes()], pa.binary()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([train.tobytes()], pa.binary()),
                ],
                [c.split()[0] for c in MET.split(", ")],
            )
            trim()

    return run


def _score(totals: dict[str, int], n_packs: int, order: int, backoff: float):
    def scored(rows: list[dict]) -> pa.RecordBatch:
        head, answers = rows[0], rows[1:]
        sizes = np.frombuffer(head["sizes"] or b"", "<i8")
        data, ends = zstandard.ZstdDecompressor().decompress(head["pack"], int(sizes.sum()) + 1), np.cumsum(sizes)
        texts = [data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]
        del data
        block = block_of(texts, np.frombuffer(head["train"], bool), order)
        keys = block.keys()
        check = _check(keys)
        if head["place"] != -1 or len(answers) != n_packs or any(r["check"] != check for r in answers):
            raise RuntimeError("the two passes saw different blocks: the input is not a stable scan")
        found = np.empty(len(keys), np.int64)
        found[np.argsort(keys, kind="stable")] = np.concatenate([_from_numbers(r["pack"]) for r in answers])
        del keys
        model = Automaton(block, found, **totals, backoff=backoff)
        known = np.add.reduceat((found[: model.n] > 0)[block.tokens].astype(np.int64), block.starts)
        base = np.add.reduceat(model.root_weight[block.tokens], block.starts)
        score = model.traverse(block.tokens, block.starts, block.sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array(head["ids"], pa.int64()), pa.array(block.sizes), pa.array(known), pa.array(base), pa.array(score)],
            [c.split()[0] for c in SCORED.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and rows[0]["block"] != r["block"]:
                    yield scored(rows)
                    rows = []
                    trim()
                rows.append(r)
        if rows:
            yield scored(rows)

    return run


def _answers(asked: DataFrame, places: Places) -> tuple[DataFrame, dict[str, int]]:
    """Answers to the blocks' packs, and the totals of the corpus."""

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(places.ranges, "place").sortWithinPartitions("place", "block")

    cells = None
    if places.cells:
        cells = stored(dealt(asked), "lm-cells")
        asked = in_arrow(cells, _merge(places), ASKED)
    answers = stored(in_arrow(dealt(asked), _answer, ANSWERED), "lm-answers")
    sums = answers.agg(*(F.sum(c).alias(c) for c in ("tokens", "distinct", "texts"))).first()
    totals = {c: int(sums[c] or 0) for c in ("tokens", "distinct", "texts")}
    if cells is not None:
        back = answers.select(F.col("block").cast("int").alias("place"), F.col("place").cast("long").alias("block"), "pack", "check", F.lit(0).alias("kind"))
        both = back.union(cells.select("place", "block", "pack", "check", F.lit(1).alias("kind")))
        both = both.repartition(places.ranges, "place").sortWithinPartitions("place", "kind", "block")
        answers = in_arrow(both, _hand_out, ANSWERED)
    return answers, totals


def score(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    backoff: float = BACKOFF,
    block_bytes: int = BLOCK_BYTES,
    fan: int = FAN,
) -> tuple[DataFrame, dict[str, int]]:
    """(id, n_tokens, n_known, base_score, score) of every text under the model of the training ones, and its totals.

    order is the longest n-gram, 2 or more; each one more adds about a hash a token to the exchange."""
    if order < 2:
        raise ValueError("order must be 2 at least")
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    places = Places(n, fan)
    flat = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    answers, totals = _answers(in_arrow(flat, _ask(places, block_bytes, order), ASKED), places)
    payload = in_arrow(flat, _payload(block_bytes), MET)
    back = answers.select("place", "block", "pack", "check").withColumns(
        {"sizes": F.lit(None).cast("binary"), "ids": F.lit(None).cast("array<long>"), "train": F.lit(None).cast("binary")}
    )
    met = payload.union(back).repartition(n, "block").sortWithinPartitions("block", "place")
    return in_arrow(met, _score(totals, places.groups, order, backoff), SCORED), totals
