from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from loomlake.llm import flac
from loomlake.llm.queries import op3_flac


def back(payloads):
    streams = flac.encode_streams(payloads)
    pcm, sizes, offsets = flac.decode_streams(streams)
    at = np.cumsum(sizes)
    return streams, [pcm[a - n : a].tobytes() for a, n in zip(at, sizes)], offsets


def test_round_trip_of_many_shapes():
    rng = random.Random(1)
    payloads = [bytes(64), b"\xff" * 128, bytes(range(256)) * 9, rng.randbytes(5000)]
    payloads += [bytes(int(128 + 100 * np.sin(i / 9)) for i in range(n)) for n in (64, 1023, 1024, 1025, 4096)]
    payloads += [("hello world, plain prose. " * n).encode() for n in (3, 50, 400)]
    payloads += [bytes(rng.choice((0, 0, 0, 255)) for _ in range(1500)), b"\x80" * 1000 + b"\x00" + b"\x80" * 500]
    streams, got, offsets = back(payloads)
    assert got == payloads
    assert [o.tolist() for o in offsets] == [list(range(0, len(p), 1024)) for p in payloads]
    assert len(streams[10]) < len(payloads[10])


def test_frames_are_found_without_seek_table():
    payload = "some prose to store ".encode() * 300
    stream = flac.encode_streams([payload])[0]
    seek = int.from_bytes(stream[43:46], "big")
    bare = stream[:4] + b"\x80" + stream[5:42] + stream[46 + seek :]
    pcm, _, _ = flac.decode_streams([bare])
    assert pcm.tobytes() == payload


def test_damage_is_noticed():
    stream = bytearray(flac.encode_streams([b"abc" * 1000])[0])
    stream[-700] ^= 4
    with pytest.raises(ValueError):
        flac.decode_streams([bytes(stream)])


def hand_made(subframe_bits: str, samples: list[int]) -> bytes:
    """A one-frame stream around given subframe bits."""
    head, n = flac._headers(np.array([0]), np.array([len(samples)]))
    body = bytes(head[0, : n[0]]) + int(subframe_bits.ljust(-(-len(subframe_bits) // 8) * 8, "0"), 2).to_bytes(-(-len(subframe_bits) // 8), "big")
    crc = int(flac._crc16(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0])
    info = (len(samples)).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big")
    info += hashlib.md5(np.array(samples, np.int8).tobytes()).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + body + crc.to_bytes(2, "big")


def test_partitions_escapes_and_long_runs():
    # fixed order 2, two partitions of 8: the first with Rice parameter 0 and a long run, the second raw 6-bit values
    residuals = [0, -1, 60, 1, 0, 2] + [5, -6, 0, 31, -32, 1, 2, 3]
    x = [3, 4]
    for r in residuals:
        x.append(r + 2 * x[-1] - x[-2])
    x = [v for v in x]
    wrapped = [((v + 128) % 256) - 128 for v in x]
    if wrapped != x:  # keep the samples in range by a gentler second half
        residuals = [0, -1, 60, -60, 0, 1] + [0, 0, 1, -1, 0, 0, 0, 0]
        x = [3, 4]
        for r in residuals:
            x.append(r + 2 * x[-1] - x[-2])
    assert all(-128 <= v < 128 for v in x)
    bits = "0" + format(8 + 2, "06b") + "0" + "".join(format(v & 255, "08b") for v in x[:2]) + "00" + "0001" + "0000"
    fold = lambda r: 2 * r if r >= 0 else -2 * r - 1
    bits += "".join("0" * fold(r) + "1" for r in residuals[:6]) + "1111" + format(7, "05b")
    bits += "".join(format(r & 127, "07b") for r in residuals[6:])
    pcm, _, _ = flac.decode_streams([hand_made(bits, x)])
    assert (pcm.astype(int) - 128).tolist() == x


def test_query(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_flac(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = docs[r.doc_id]
        p = t + bytes(-len(t) % 64 if t else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64


def test_odd_rows_and_blocks(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "x" * 64), (2, "x" * 64), (3, "é" * 3000)], "doc_id long, text string").selectExpr("*", "1 as media", "2 as id")
    media = flac.encode(docs)
    got = {(r.id, r.n_bytes, r.payload_bytes) for r in flac.digests(media).collect()}
    assert got == {(1, 0, 64), (None, 0, 64), (2, 64, 64), (3, 6000, 6016)}
    found = sorted((r.sample, bytes(r.pcm)) for r in flac.pcm_blocks(media).where("id = 3").collect())
    assert [s for s, _ in found] == list(range(0, 6016, 1024))
    assert b"".join(p for _, p in found).rstrip(b"\0").decode() == "é" * 3000
    assert flac.digests(flac.encode(docs.limit(0))).collect() == []
