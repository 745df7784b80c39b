"""Token ids of a corpus as canonical length-limited Huffman code in block files.

Ids are counted over all documents; package-merge gives the best code lengths up to MAX_BITS, and lengths alone fix
the canonical code. A file is one range of ids of documents in ascending order; its rows are independent blocks of
whole documents: their ids and counts, the code bits, the bit offset of every STEP-th token and a checksum. Decoding
looks MAX_BITS ahead into one table and starts at all the checkpoints of a block at once.

Only the counts of a vocabulary (its size is fixed by the tokenizer) and one total a file reach the driver. Files are
Parquet in the shared folder, so lost tasks are simply written again.

Results for odd input: null and empty texts hold just the end id; null ids come first; rows of equal id follow in
order of their ids' bytes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import gc
import itertools
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.bpe import gather
from loomlake.llm.common import byte_texts, discard, in_arrow, shuffle_partitions, stored, trim

MAX_BITS = 16
STEP = 256
BLOCK_IDS = 1 << 18
CACHED_PIECES = 300_000
#: Texts that are encoded together: the more of them, the fewer words there are to look up.
TEXT_BYTES = 8 << 20
END = 1
#: Lower-case letters of ASCII and Latin-1, all composed: a run of them is one piece for the tokenizer.
LETTERS = "a-zß-öø-ÿ"
ALPHABET = "".join(c for c in map(chr, range(97, 256)) if c.isalpha() and c.islower() and c not in "ªµº")

CODED = "file int, block int, first long, ids array<long>, counts array<int>, bits binary, marks binary, crc long"


class Numbered(dict):
    """Pieces to numbers; an unknown one gets the next number and waits in new."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class WordTokenizer:
    """Encoder of a tokenizers file that drops white space: each distinct word of a block goes to the library once.

    Valid only for tokenizers that treat white space as a mere separator, so that words don't affect each other. Added
    tokens may break that rule, so texts with the string of one, in whatever case, go to the library whole."""

    def __init__(self, path: str):
        self.path = path
        self.pieces: Numbered | None = None

    def __reduce__(self):
        return _tokenizer, (self.path,)

    def _start(self) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(self.path)
        added = [regex.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.added = "|".join(added)
        self.model = self.library.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.symbols = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}
        self._clear()

    def _clear(self) -> None:
        self.pieces = Numbered()
        self.flat, self.used = np.empty(1 << 16, np.uint16), 0
        self.starts, self.sizes = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers of pieces whose ids the cache holds; new ones go to the library's model, their bytes spelled as the
        vocabulary spells them."""
        at = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        new, self.pieces.new = self.pieces.new, []
        spelled = (p if p.isascii() else p.encode().decode("latin-1").translate(self.symbols) for p in new)
        found = [[t.id for t in self.model.tokenize(p)] if p else [] for p in spelled]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        n, used, more = len(self.pieces) - len(new), self.used, int(sizes.sum())
        while used + more > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while n + len(new) > len(self.starts):
            self.starts, self.sizes = (np.concatenate((x, np.empty_like(x))) for x in (self.starts, self.sizes))
        self.flat[used : used + more] = np.fromiter(itertools.chain.from_iterable(found), np.uint16, more)
        self.sizes[n : n + len(new)] = sizes
        self.starts[n : n + len(new)] = used + np.cumsum(sizes) - sizes
        self.used = used + more
        return at

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and the start and number of each word's.

        Letters and a tail of punctuation are two pieces, each looked up; other words go to the whole library."""
        if len(self.pieces) > CACHED_PIECES:
            self._clear()
        core = pc.utf8_rtrim(words, characters=string.punctuation)
        plain = pc.match_substring_regex(core, f"^[{LETTERS}]+$")
        is_plain = plain.to_numpy(zero_copy_only=False)
        tails = pc.utf8_ltrim(words.filter(plain), characters=ALPHABET).dictionary_encode()
        runs = np.stack((self._numbers(core.filter(plain).to_pylist()), self._numbers(tails.dictionary.to_pylist())[tails.indices.to_numpy(zero_copy_only=False)]), axis=1)
        odd = words.filter(pc.invert(plain)).to_pylist()
        whole = [e.ids for e in self.library.encode_batch_fast(odd, add_special_tokens=False)]
        odd_sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        odd_flat = np.fromiter(itertools.chain.from_iterable(whole), np.uint16, int(odd_sizes.sum()))
        sizes, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        two = self.sizes[runs]
        sizes[is_plain] = two.sum(axis=1)
        sizes[~is_plain] = odd_sizes
        plain_sizes = sizes[is_plain]
        starts[is_plain] = np.cumsum(plain_sizes) - plain_sizes
        starts[~is_plain] = int(plain_sizes.sum()) + np.cumsum(odd_sizes) - odd_sizes
        return np.concatenate((gather(self.flat, self.starts[runs].ravel(), two.ravel()), odd_flat)), starts, sizes

    def encode(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each closed by the end id, and the number of each text."""
        if self.pieces is None:
            self._start()
        # a copy without an offset: lower-casing a slice can go wrong
        texts = texts.take(pa.array(np.arange(len(texts)))).fill_null("")
        if not self.added:
            return self._by_words(texts, end)
        special = pc.match_substring_regex(texts, self.added, ignore_case=True)
        if not pc.any(special).as_py():
            return self._by_words(texts, end)
        ids, counts = self._by_words(pc.if_else(special, "", texts), end)
        whole = [e.ids for e in self.library.encode_batch_fast(texts.filter(special).to_pylist(), add_special_tokens=False)]
        own = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        more = np.fromiter(map(len, whole), np.int64, len(whole))
        places = np.repeat((np.cumsum(counts) - counts)[own], more)
        counts[own] += more
        return np.insert(ids, places, np.fromiter(itertools.chain.from_iterable(whole), np.uint16, int(more.sum()))), counts

    def _by_words(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        # letters that combine with a mark of U+0300 to U+037F may compose in one case only: then all keep their case
        if not pc.any(pc.match_substring_regex(texts, "[\u0300-\u037f]")).as_py():
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        flat, first, own = self._word_ids(words.dictionary)
        at = words.indices.to_numpy(zero_copy_only=False)
        sizes = own[at]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(np.diff(split.offsets.to_numpy()))]
        counts = np.diff(ends, prepend=0)
        ids = np.insert(gather(flat, first[at], sizes), ends, end) if len(ends) else np.empty(0, np.uint16)
        return ids, counts + 1


_made: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    return _made.setdefault(path, WordTokenizer(path))


def _encoded(tokenizer: WordTokenizer):
    def rows_of(own: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        ids, counts = tokenizer.encode(texts)
        at = np.concatenate(([0], np.cumsum(counts))) * 2
        rows = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(at.astype("<i4")), pa.py_buffer(ids.astype("<u2"))])
        counts = np.bincount(ids, minlength=1 << 16)
        some = np.flatnonzero(counts)
        hist = [some.astype("<u2").tobytes() + counts[some].astype("<u4").tobytes(), *[None] * (len(own) - 1)]
        return pa.RecordBatch.from_arrays([own, rows, pa.array(hist, pa.binary())], ["id", "tokens", "hist"])

    def flushed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        out = rows_of(*(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1)))
        held.clear()
        trim()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was = gc.isenabled()
        gc.disable()  # the cache holds many live strings, and nothing here makes cycles
        try:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                if sum(b.nbytes for b in held) >= TEXT_BYTES:
                    yield flushed(held)
            if held:
                yield flushed(held)
        finally:
            if was:
                gc.enable()

    return run


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, hist): little-endian 16-bit ids of each text and the end id; one row a block also has the counts
    of the block's ids (ids, then counts as 32-bit numbers)."""
    pair = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return in_arrow(pair, _encoded(WordTokenizer(path)), "id long, tokens binary, hist binary")


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for hist in byte_texts(batch.column(0)):
            n = len(hist) // 6
            counts[np.frombuffer(hist, "<u2", n)] += np.frombuffer(hist, "<u4", n, 2 * n)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["token", "n"])


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol (0 for unused ones) by package-merge: the least total with no length above most."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} symbols need more than {most} bits")
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.float64)
    merged, package = leaves, np.zeros(len(leaves), bool)
    levels = [package]
    for _ in range(most - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, pairs))
        rank = np.argsort(both, kind="stable")
        merged, package = both[rank], rank >= len(leaves)
        levels.append(package)
    take = 2 * len(leaves) - 2
    for package in reversed(levels):
        packs = int(package[:take].sum())
        out[order[: take - packs]] += 1  # the cheapest leaves of the level are in
        take = 2 * packs
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then symbol."""
    codes = np.zeros(len(lengths), np.int64)
    code = last = 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[s]:
            code <<= int(lengths[s]) - last
            last = int(lengths[s])
            codes[s] = code
            code += 1
    return codes


class Codebook:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical(self.lengths)
        self.symbols: np.ndarray | None = None

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Code bits (most significant first), and the bit offset of every STEP-th id."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = int(ends[-1]) if len(ids) else 0
        # a code spans two 16-bit words at most: as 32 bits from its first word on
        wide = self.codes[ids] << (32 - (starts & 15) - sizes)
        word = starts >> 4
        n = (total + 15 >> 4) + 2
        out = np.zeros(n, np.int64)
        if len(ids):
            new = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[new]] += np.add.reduceat(wide >> 16, new)
            out[word[new] + 1] += np.add.reduceat(wide & 0xFFFF, new)
        return out.astype(">u2").tobytes()[: (total + 7) // 8], starts[::STEP].astype("<u4").tobytes()

    def _table(self) -> None:
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        spans = 1 << (MAX_BITS - self.lengths[order])
        self.symbols = np.zeros(1 << MAX_BITS, np.uint16)
        self.widths = np.zeros(1 << MAX_BITS, np.uint8)
        filled = int(spans.sum())
        self.symbols[:filled] = np.repeat(order, spans)
        self.widths[:filled] = np.repeat(self.lengths[order], spans)

    def unpack(self, bits: bytes, marks: bytes, n: int) -> np.ndarray:
        """The n ids of a block; all its checkpoints advance together."""
        if self.symbols is None:
            self._table()
        data = np.frombuffer(bits + b"\0\0\0\0", np.uint8).astype(np.uint32)
        windows = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        at = np.frombuffer(marks, "<u4").astype(np.int64)
        out = np.zeros((STEP, len(at)), np.uint16)
        last = len(windows) - 1
        for i in range(min(STEP, n)):
            w = (windows[np.minimum(at >> 3, last)] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
            out[i] = self.symbols[w]
            at += self.widths[w]
        return out.T.ravel()[:n]  # the last checkpoint's lane runs on past its end


def _blocks_of(book: Codebook, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, first = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        rows: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, first, ids, rows
            tokens = np.frombuffer(b"".join(rows), "<u2")
            bits, marks = book.pack(tokens)
            counts = [len(r) // 2 for r in rows]
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array([file], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([counts], pa.list_(pa.int32())),
                    pa.array([bits], pa.binary()),
                    pa.array([marks], pa.binary()),
                    pa.array([zlib.crc32(bits)], pa.int64()),
                ],
                ["file", "block", "first", "ids", "counts", "bits", "marks", "crc"],
            )
            block, first, ids, rows = block + 1, first + len(tokens), [], []
            return made

        held = 0
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                if rows and held + len(row) // 2 > limit:
                    yield flush()
                    held = 0
                ids.append(i)
                rows.append(row)
                held += len(row) // 2
            trim()
        if rows:
            yield flush()

    return run


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> tuple[DataFrame, Codebook]:
    """The block files of all documents in ascending order of id, as a table of blocks, and their code."""
    spark = docs.sparkSession
    flat = stored(tokenized(docs, path, id_col, text_col), "huffman-ids")
    counts = in_arrow(flat.where("hist is not null").select("hist"), _id_counts, "token int, n long")
    counts = counts.groupBy("token").agg(F.sum("n").alias("n"))
    table = np.zeros(1 << 16, np.int64)
    for r in counts.collect():  # at most the tokenizer's vocabulary
        table[r.token] = r.n
    book = Codebook(code_lengths(table))
    dealt = flat.select("id", "tokens").repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", "tokens")
    coded = stored(in_arrow(dealt, _blocks_of(book, block_ids), CODED), "huffman-blocks")
    discard(flat)
    return coded, book


def _decoded(book: Codebook, with_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if zlib.crc32(r["bits"]) != r["crc"]:
                    raise ValueError(f"file {r['file']}, block {r['block']}: wrong checksum")
                counts = np.array(r["counts"], np.int64)
                ends = np.cumsum(counts)
                tokens = book.unpack(r["bits"], r["marks"], int(ends[-1])).astype("<u4")
                data = memoryview(tokens.tobytes())
                rows = [data[4 * a : 4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist())]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, r["file"], np.int32)),
                        pa.array(r["ids"], pa.int64()),
                        pa.array(r["first"] + ends - counts),
                        pa.array(counts),
                        pa.array([zlib.crc32(x) for x in rows], pa.int64()),
                        pa.array([bytes(x) if with_tokens else None for x in rows], pa.binary()),
                    ],
                    ["file", "id", "place", "n_tokens", "ids_crc32", "tokens"],
                )

    return run


def read(coded: DataFrame, book: Codebook, with_tokens: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, tokens as little-endian 32-bit ids) of every document, from the blocks alone."""
    spark = coded.sparkSession
    sizes = coded.groupBy("file").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, v: a + v)).alias("n"))
    before, total = [], 0
    for r in sorted(sizes.collect(), key=lambda r: r.file):  # one row a file
        before.append((r.file, total))
        total += r.n
    base = spark.createDataFrame(before, "file int, base long")
    rows = in_arrow(coded, _decoded(book, with_tokens), "file int, id long, place long, n_tokens long, ids_crc32 long, tokens binary")
    out = rows.join(F.broadcast(base), "file")  # as many rows as files
    kept = ["id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"]
    return out.select(*kept, *(["tokens"] if with_tokens else []))
