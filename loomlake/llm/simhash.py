"""SimHash near-duplicate groups by multi-index hashing.

A 64-bit fingerprint is cut into segments. Two fingerprints within `radius` bits agree up to a share of them in at
least one segment, so both enumerate the ball of half that radius around their segment's value: the balls meet exactly
when the segments are close enough. Each ball point is a table key; the members of a key are verified by their whole
distance. A key emits the links of a spanning forest of its members, so the number of links is linear in the rows even
for large groups of copies, and no link between different texts is lost to the components. Segments get longer as the
corpus grows, so that unrelated fingerprints hardly ever share a key.

Results for odd input: null and empty texts have fingerprint zero and link like any other; equal texts have
equal fingerprints; null ids take part, and a group of null ids alone has component null; an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import blocks, byte_texts, discard, in_arrow, shuffle_partitions, stored, trim
from loomlake.llm.components import connected

SEED = 42
BLOCK_BYTES = 4 << 20
#: Byte value -> eight byte lanes, lane j holding bit j.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def shingle_hashes(text: bytes, width: int) -> list[int]:
    words = text.lower().split()  # bytes: folds A-Z only, splits at the six white-space bytes only
    n = len(words)
    if not n:
        return []
    joined = b" ".join(words)
    if n <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(sizes) + np.arange(n)
    starts = (ends - sizes)[: n - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]


def fingerprints(texts: list[bytes], width: int = 4) -> np.ndarray:
    """Majority bits over all shingle hashes of each text, as uint64."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for lo, hi in blocks([len(t) for t in texts], BLOCK_BYTES):
        hashes: list[int] = []
        counts = np.zeros(hi - lo, dtype=np.int64)
        for i in range(lo, hi):
            got = shingle_hashes(texts[i], width)
            counts[i - lo] = len(got)
            hashes += got
        if not hashes:
            continue
        some = np.flatnonzero(counts)
        n = counts[some]
        h = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        # byte counters hold up to 255 rows: sum in runs of 255, then add up the runs of each text
        runs = (n + 254) // 255
        first = np.concatenate(([0], np.cumsum(n)[:-1]))
        run_of = np.repeat(np.arange(len(n)), runs)
        run_first = np.concatenate(([0], np.cumsum(runs)[:-1]))
        run_start = first[run_of] + 255 * (np.arange(len(run_of)) - run_first[run_of])
        bits = np.empty((len(n), 64), dtype=np.int64)
        for byte in range(8):
            sums = np.add.reduceat(LANES[h[:, byte]], run_start).view(np.uint8).reshape(-1, 8)
            bits[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(sums.astype(np.int64), run_first, axis=0)
        on = (2 * bits > n[:, None]).astype(np.uint8)
        out[lo + some] = np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(byte_texts(batch.column(1)), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2)], ["id", "fp", "same"])
            del batch, fp
            trim()

    return run


def text_hash(text: str | Column = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp, same): the fingerprint as a signed long, and a hash of the text."""
    pair = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_hash(text_col).alias("same"))
    return in_arrow(pair, _fingerprint_batches(width), "id long, fp long, same long")


@dataclass(frozen=True)
class Layout:
    """Segments of a fingerprint: every choice of `take` of `parts` equal parts.

    A bit that differs counts in a share take / parts of the segments, so some segment has at most
    radius * take // parts of them, and both sides enumerate balls of half that radius."""

    parts: int
    take: int

    def masks(self) -> list[int]:
        edges = [64 * p // self.parts for p in range(self.parts + 1)]
        part = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
        return [sum(part[i] for i in own) for own in combinations(range(self.parts), self.take)]

    def ball(self, radius: int) -> int:
        return -(-(radius * self.take // self.parts) // 2)

    def crowd(self, radius: int, n: int) -> float:
        """Unrelated fingerprints that share a key, if there are n."""
        bits = 64 * self.take // self.parts
        return n * sum(comb(bits, r) for r in range(self.ball(radius) + 1)) / 2**bits


#: From few keys a fingerprint to many; the first one whose keys stay uncrowded is taken.
LAYOUTS = (Layout(2, 1), Layout(3, 2))
CROWD = 8


def layout_for(radius: int, n: int) -> Layout:
    """32-bit segments up to about a thousand million fingerprints, 42-bit ones beyond."""
    return next((x for x in LAYOUTS if x.crowd(radius, n) <= CROWD), LAYOUTS[-1])


def ball_keys(fps: np.ndarray, layout: Layout, radius: int) -> np.ndarray:
    """One row of keys for each fingerprint: the ball points of each segment's value, mixed with the segment's number.

    Two segments may share a key by chance; whole distances are verified anyway."""
    columns = []
    for s, mask in enumerate(layout.masks()):
        bits = [b for b in range(64) if mask >> b & 1]
        value = fps & np.uint64(mask)
        for r in range(layout.ball(radius) + 1):
            for flips in combinations(bits, r):
                point = value ^ np.uint64(sum(1 << b for b in flips))
                columns.append(point * np.uint64(0x9E3779B97F4A7C15) + np.uint64(s * 0x632BE59BD9B4E019 % 2**64))
    return np.stack(columns, axis=1)


def _key_batches(layout: Layout, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fps), 4096):
                part = fps[lo : lo + 4096]
                keys = ball_keys(part, layout, radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, keys.shape[1]).view(np.int64))],
                    ["key", "fp"],
                )

    return run


def forest(fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of a spanning forest of the distinct fingerprints of one key."""
    left, ends, starts = fps, [], []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                found = left[near]
                starts.append(np.full(len(found), at))
                ends.append(found)
                frontier.extend(found)
                left = left[~near]
    return starts, ends


SMALL = 6


def key_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within the keys; keys are sorted."""
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((cut, [len(keys)])))
    starts, ends = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    for lag in range(1, SMALL):
        same = (keys[lag:] == keys[:-lag]) & small[lag:]
        at = np.flatnonzero(same)
        at = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= radius]
        starts.append(fps[at])
        ends.append(fps[at + lag])
    for g in np.flatnonzero(sizes > SMALL):
        a, b = forest(np.unique(fps[cut[g] : cut[g] + sizes[g]]), radius)
        starts += a
        ends += b
    none = np.empty(0, dtype=np.uint64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends])


def _link_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = key_links(keys, fps, radius)
            a, b = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
            pairs = np.unique(np.stack((a, b), axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            keys = np.concatenate((held_k, batch.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(keys):
                continue
            last = np.searchsorted(keys, keys[-1])  # the last key may go on in the next batch
            if last:
                yield links(keys[:last], fps[:last])
            held_k, held_f = keys[last:], fps[last:]
        if len(held_k):
            yield links(held_k, held_f)
        trim()

    return run


def fingerprint_links(fps: DataFrame, n: int, radius: int = 4, layout: Layout | None = None) -> DataFrame:
    """(a, b): links between different ones of n distinct fingerprints (column fp) within radius; they keep all
    components whole. No fingerprint has more links than there are fingerprints within radius: 679,120 for four bits."""
    spark = fps.sparkSession
    own = layout or layout_for(radius, n)
    keyed = in_arrow(fps.select("fp"), _key_batches(own, radius), "key long, fp long")
    dealt = keyed.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "fp")
    return in_arrow(dealt, _link_batches(radius), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, layout: Layout | None = None
) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id): the smallest id reachable by links."""
    base, named = _grouped(docs, id_col, text_col, width, radius, layout)
    of_fp = named.select(F.col("fp").alias("of"), F.when(~F.col("label.no"), F.col("label.id")).alias("component_id"))
    return base.join(of_fp, base.fp == of_fp.of).select(
        "id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _grouped(
    docs: DataFrame, id_col: str, text_col: str, width: int, radius: int, layout: Layout | None
) -> tuple[DataFrame, DataFrame]:
    """The fingerprinted rows (id, fp, same), and (fp, node, label) of each distinct fingerprint.

    A node is a fingerprint's first row: (no id, id, text hash, fp); a label is the first node of the component, so
    contraction itself finds the smallest id and nothing is gathered by component."""
    base = stored(with_fingerprint(docs, id_col, text_col, width), "simhash")
    # an id counts before none; a null inside would not compare
    row = F.struct(F.col("id").isNull().alias("no"), F.coalesce("id", F.lit(0)).alias("id"), "same", "fp")
    nodes = stored(base.groupBy("fp").agg(F.min(row).alias("node")), "simhash-nodes")
    links = fingerprint_links(nodes, nodes.count(), radius, layout)
    for end in ("a", "b"):  # a fingerprint's links are bounded, so these joins have no hot key
        own = nodes.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node"))
        links = links.join(own, end)
    links = stored(links.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "simhash-links")
    label = connected(links)
    discard(links)
    named = nodes.join(label.withColumnRenamed("node", "of"), nodes.node == F.col("of"), "left")
    return base, named.select("fp", "node", F.coalesce("label", "node").alias("label"))


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, layout: Layout | None = None
) -> DataFrame:
    """One row of docs for each group: that of the smallest id (of those with it, of the smallest text hash; of rows
    that are alike in both, the first by all columns as JSON)."""
    base, named = _grouped(docs, id_col, text_col, width, radius, layout)
    first = named.where("node = label")
    kept = stored(first.select(F.when(~F.col("node.no"), F.col("node.id")).alias("id"), "node.same"), "simhash-kept")
    repeats = base.join(kept, base.id.eqNullSafe(kept.id) & (base.same == kept.same), "left_semi")
    repeats = repeats.groupBy("id", "same").count().where("count > 1").limit(1).count()
    discard(base)
    wanted = kept.select(F.col("id").alias("_id"), F.col("same").alias("_same")).hint("shuffle_hash")
    mine = docs[id_col].cast("long").eqNullSafe(wanted["_id"]) & (text_hash(docs[text_col]) == wanted["_same"])
    out = docs.join(wanted, mine, "left_semi")
    if not repeats:
        return out
    rows = out.select(F.struct("*").alias("row")).groupBy(F.col(f"row.`{id_col}`").alias("id"), text_hash(f"row.`{text_col}`").alias("same"))
    rows = rows.agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
