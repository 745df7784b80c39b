"""Byte-level BPE over padded matrices.

The distinct matches of the splitting pattern in a block of texts are bucketed by length and laid out as rows of
token ids. Each round every row merges its leftmost pair of least rank: pair ranks come from a hashed table, rows are
compacted by one shift, and rows without a pair of known rank leave. A round costs a row its length, so a match of
n bytes costs up to n squared: matches above LONG bytes (runs of letters or spaces, hardly ever words) take the same
merges in the same order from a heap of (rank, place) instead, in n log n. The only state is the rank file, whose size
is fixed; work and memory are bounded by the block.

Results for odd input: null and empty texts have no ids; equal texts equal ids; lone surrogates cannot occur in
Spark strings; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import blocks, byte_texts, in_arrow, trim

BLOCK_BYTES = 2 << 20
MATRIX_CELLS = 1 << 19
#: Longest row of a matrix.
LONG = 512
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open addressing table from a pair of ids to the merged id, looked up for whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        size = 1 << max(4, (4 * len(pairs)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int32)
        left = np.array(list(pairs), np.int64).reshape(-1, 2)
        key, value = (left[:, 0] << 32) | left[:, 1], np.array(list(pairs.values()), np.int32)
        slot, self.probes = self._slot(key), 0
        while len(key):  # each round puts at most one key into each free slot, the others move on
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]
            mine = self.keys[slot] == key
            self.values[slot[mine]] = value[mine]
            key, value = key[~mine], value[~mine]
            slot = (slot[~mine] + 1) & int(self.mask)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) & self.mask).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        going = np.flatnonzero((found != key) & (found >= 0))
        while len(going):
            slot[going] = (slot[going] + 1) & int(self.mask)
            found = self.keys[slot[going]]
            hit = found == key[going]
            out[going[hit]] = self.values[slot[going[hit]]]
            going = going[~hit & (found >= 0)]
        return out


class ByteBpe:
    """Encoder and decoder for the ranks of a rank file; rebuilt from its path in each worker."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def __reduce__(self):
        return _loaded, (self.path, self.pattern)

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        with open(self.path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    @cached_property
    def bytes_to_id(self) -> np.ndarray:
        return np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    @cached_property
    def table(self) -> PairTable:
        r = self.ranks
        return PairTable(
            {(r[t[:i]], r[t[i:]]): n for t, n in r.items() for i in range(1, len(t)) if t[:i] in r and t[i:] in r}
        )

    @cached_property
    def split(self):
        return regex.compile(self.pattern).findall

    def _merge(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fully merged rows; rows is padded beyond sizes."""
        out, out_sizes = rows, sizes.copy()
        live = np.arange(len(rows))
        ids = rows.copy()
        n, width = ids.shape
        rank = np.full((n, max(width, 2)), NONE, np.int32)
        if width > 1:
            at = np.arange(width - 1)[None, :] < sizes[:, None] - 1
            rank[:, : width - 1][at] = self.table.find(ids[:, :-1][at], ids[:, 1:][at])
        size = sizes.copy()
        while True:
            j = rank.argmin(axis=1)  # the leftmost of the least
            best = rank[np.arange(len(rank)), j]
            on = best != NONE
            if not on.all():
                done = ~on
                out[live[done], : ids.shape[1]] = ids[done]
                out_sizes[live[done]] = size[done]
                live, ids, rank, size, j, best = live[on], ids[on], rank[on], size[on], j[on], best[on]
            if not len(live):
                return out, out_sizes
            # compaction: the columns after the pair move left by one
            r, w = np.arange(len(live)), ids.shape[1]
            size -= 1
            w = int(size.max())
            cols = np.arange(w)[None, :]
            take = cols + (cols > j[:, None])
            ids = np.take_along_axis(ids, take, axis=1)
            ids[r, j] = best
            rank = np.take_along_axis(rank, np.minimum(take, rank.shape[1] - 1), axis=1)
            if w < 2:
                rank = np.full((len(live), 2), NONE, np.int32)
                continue
            # only the two pairs around the merged id are new
            rank[r, j] = NONE
            right = np.flatnonzero(j + 1 < size)
            rank[right, j[right]] = self.table.find(best[right], ids[right, j[right] + 1])
            left = np.flatnonzero(j > 0)
            rank[left, j[left] - 1] = self.table.find(ids[left, j[left] - 1], best[left])

    @cached_property
    def tokens(self) -> dict[int, bytes]:
        return {n: t for t, n in self.ranks.items()}

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """A long match merged: always the leftmost of the pairs of least rank, from a heap of rank and place."""
        n = len(ids)
        rank = self.table.find(ids[:-1], ids[1:]).astype(np.int64)
        some = np.flatnonzero(rank != NONE)
        heap = ((rank[some] << 32) | some).tolist()
        heapq.heapify(heap)
        token, best = ids.tolist(), rank.tolist()  # best: the rank of the pair that begins here
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks, spelled, none = self.ranks, self.tokens, int(NONE)
        while heap:
            at = heapq.heappop(heap)
            r, i = at >> 32, at & 0xFFFFFFFF
            if best[i] != r or token[i] < 0:
                continue  # merged or changed since
            j = after[i]
            token[i], token[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                best[i] = ranks.get(spelled[r] + spelled[token[k]], none)
                if best[i] != none:
                    heapq.heappush(heap, (best[i] << 32) | i)
            else:
                best[i] = none
            h = before[i]
            if h >= 0:
                best[h] = ranks.get(spelled[token[h]] + spelled[r], none)
                if best[h] != none:
                    heapq.heappush(heap, (best[h] << 32) | h)
        out = np.array(token, np.int32)
        return out[out >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and the number of each piece."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = self.bytes_to_id[np.frombuffer(b"".join(pieces), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        counts = np.zeros(len(pieces), np.int64)
        order = np.argsort(sizes, kind="stable")
        ordered = sizes[order]
        parts: list[np.ndarray] = []
        lo = 0
        while lo < len(order):
            first = max(1, int(sizes[order[lo]]))
            if first > LONG:
                i = order[lo]
                parts.append(self._merge_long(flat[starts[i] : starts[i] + sizes[i]]))
                counts[i] = len(parts[-1])
                lo += 1
                continue
            # a bucket holds pieces of like length, up to MATRIX_CELLS cells
            hi = int(np.searchsorted(ordered, min(LONG, first + max(1, first // 4)), side="right"))
            hi = min(hi, lo + max(1, MATRIX_CELLS // max(1, int(sizes[order[hi - 1]]))))
            own = order[lo:hi]
            width = max(1, int(sizes[own[-1]]))
            cols = np.arange(width)[None, :]
            inside = cols < sizes[own][:, None]
            rows = np.full((len(own), width), -1, np.int32)
            rows[inside] = flat[(starts[own][:, None] + cols)[inside]]
            rows, got = self._merge(rows, sizes[own])
            counts[own] = got
            parts.append(rows[cols < got[:, None]])
            lo = hi
        joined = np.concatenate(parts) if parts else np.empty(0, np.int32)
        # back from bucket order to the order of the pieces
        bucket_counts = counts[order]
        bucket_start = np.cumsum(bucket_counts) - bucket_counts
        start_of = np.empty(len(pieces), np.int64)
        start_of[order] = bucket_start
        return gather(joined, start_of, counts), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text; distinct pieces are merged once."""
        number: dict[str, int] = {}
        seen: list[int] = []
        per_text = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            pieces = self.split(text)
            per_text[i] = len(pieces)
            seen += [number.setdefault(p, len(number)) for p in pieces]
        ids, counts = self.encode_pieces([p.encode() for p in number])
        uses = np.array(seen, np.int64)
        starts = np.cumsum(counts) - counts
        used = counts[uses]
        ends = np.concatenate(([0], np.cumsum(used)))
        text_ends = ends[np.cumsum(per_text)] if len(texts) else np.empty(0, np.int64)
        return gather(ids, starts[uses], used), np.diff(text_ends, prepend=0)

    @cached_property
    def _bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _flat(self.tokens)

    @cached_property
    def _decimals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _flat({n: b"%d," % n for n in self.ranks.values()})

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids one after another, and the number of each id."""
        flat, starts, sizes = self._bytes
        return gather(flat, starts[ids], sizes[ids]), sizes[ids]

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal digits and a comma for each id, and the number of each id."""
        flat, starts, sizes = self._decimals
        return gather(flat, starts[ids], sizes[ids]), sizes[ids]


_made: dict[tuple[str, str], ByteBpe] = {}


def _loaded(path: str, pattern: str) -> ByteBpe:
    return _made.setdefault((path, pattern), ByteBpe(path, pattern))


def _flat(texts: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = [texts.get(i, b"") for i in range(max(texts) + 1)]
    sizes = np.array([len(t) for t in rows], np.int64)
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum(sizes) - sizes, sizes


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size] one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def _encoded(bpe: ByteBpe):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = byte_texts(batch.column(1))
            for lo, hi in blocks([len(t) for t in raw], BLOCK_BYTES):
                ids, sizes = bpe.encode([t.decode() for t in raw[lo:hi]])
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], lists], ["id", "ids"])
                del ids, sizes, lists
            del raw, batch
            trim()

    return run


def encode(docs: DataFrame, bpe: ByteBpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids that the pattern's matches, merged separately, have in order."""
    pair = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return in_arrow(pair, _encoded(bpe), "id long, ids array<int>")


def _checked(bpe: ByteBpe, id_at: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = byte_texts(batch.column(text_at))
            for lo, hi in blocks([len(t) for t in raw], BLOCK_BYTES):
                part = raw[lo:hi]
                ids, sizes = bpe.encode([t.decode() for t in part])
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                flat, widths = bpe.decode(ids)
                at = np.concatenate(([0], np.cumsum(widths)))[offsets]
                back = flat.tobytes()
                same = [back[a:b] == t for a, b, t in zip(at[:-1].tolist(), at[1:].tolist(), part)]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_at)[lo:hi], pa.array(sizes.astype(np.int64)), lists, pa.array(same, pa.bool_())],
                    ["id", "n_tokens", "ids", "decodes"],
                )
                del part, ids, sizes, flat, widths, back, lists
            del raw, batch
            trim()

    return run


def encode_checked(docs: DataFrame, bpe: ByteBpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decodes): the ids, and whether they decode to the very text."""
    pair = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return in_arrow(pair, _checked(bpe, 0, 1), "id long, n_tokens long, ids array<int>, decodes boolean")


def _digests(bpe: ByteBpe):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            for lo, hi in blocks(sizes.tolist(), BLOCK_BYTES // 2):
                part = column.slice(lo, hi - lo)
                ids = part.flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate(([0], np.cumsum(sizes[lo:hi])))
                rows = []
                for table, cut in ((bpe.spelled, 1), (bpe.decode, 0)):
                    flat, widths = table(ids)
                    at = np.concatenate(([0], np.cumsum(widths)))[ends]
                    view = memoryview(flat)
                    rows.append([hashlib.sha256(view[a : max(a, b - cut)]).hexdigest() for a, b in zip(at[:-1], at[1:])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(sizes[lo:hi].astype(np.int64)), pa.array(rows[0]), pa.array(rows[1])],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def digests(encoded: DataFrame, bpe: ByteBpe) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoded rows; the second hash is of the bytes decoded from the ids."""
    return in_arrow(
        encoded.select("id", "ids"), _digests(bpe), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _texts(bpe: ByteBpe):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids in batch.column(1).to_pylist():
                flat, _ = bpe.decode(np.array(ids or [], np.int64))
                out.append(flat.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "bytes"])

    return run


def decode(encoded: DataFrame, bpe: ByteBpe) -> DataFrame:
    """(id, bytes) of rows with ids."""
    return in_arrow(encoded.select("id", "ids"), _texts(bpe), "id long, bytes binary")
