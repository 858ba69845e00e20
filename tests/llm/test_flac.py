"""FLAC: exact round trips, the plain decoder against the batched one, and damage."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from waymark.llm import flac


def payloads():
    rng = np.random.default_rng(3)
    yield b" " * 192
    yield bytes([7]) * 384
    yield rng.integers(0, 256, 192 * 5, dtype=np.uint8).tobytes()
    yield bytes([0, 255] * 96 * 3)
    yield (np.sin(np.arange(192 * 40) / 9) * 100 + 128).astype(np.uint8).tobytes()
    yield flac.padded("Ünïcode text, and more of it. ".encode() * 900)
    yield flac.padded(b"")
    spikes = np.full(192 * 4, 128, np.uint8)
    spikes[::97] = 255
    yield spikes.tobytes()


def test_round_trip_and_plain_decoder():
    raw = list(payloads())
    streams = flac.encode(raw)
    back = flac.decode(streams)
    assert [(np.frombuffer(p, np.uint8) ^ 0x80).tobytes() for p in back] == raw
    kinds = set()
    for s, want in zip(streams, back, strict=True):
        at, total, md5, offsets = flac._layout(s)
        pcm = []
        for o in offsets:
            assert at == flac._layout(s)[0] + o
            kinds.add(s[at + 6] >> 1 if s[at + 4] < 128 else s[at + 7] >> 1)
            got, at = flac.decode_frame(s, at)
            pcm += got
        assert at == len(s) and np.array(pcm, np.int8).tobytes() == want and len(want) == total
        assert hashlib.md5(want).digest() == md5
    assert {0, 1} < kinds and any(k >= 32 for k in kinds) and any(8 <= k <= 12 for k in kinds)


def test_without_seek_table():
    raw = flac.padded(b"seek no more " * 50)
    s = flac.encode([raw])[0]
    at = flac._layout(s)[0]
    bare = b"fLaC" + bytes([0x80]) + s[5:42] + s[at:]
    assert flac.decode([bare, s]) == flac.decode([s, s])


@pytest.mark.parametrize("points", [1, 2, 7, 300])
def test_seek_tables_of_some_frames(monkeypatch, points):
    """A stream too long for a table of all frames: the others are found by their headers."""
    rng = np.random.default_rng(5)
    raw = [flac.padded(b"a long text to seek in " * 3000), rng.integers(0, 256, 192 * 301, dtype=np.uint8).tobytes()]
    all_frames = flac.encode(raw)
    monkeypatch.setattr(flac, "POINTS", points)
    streams = flac.encode(raw)
    assert flac.decode(streams) == flac.decode(all_frames)
    for s, whole in zip(streams, all_frames, strict=True):
        assert (flac._layout(s)[3] == flac._layout(whole)[3]).all() and len(s) < len(whole)


def test_damage_is_found():
    s = flac.encode([flac.padded(b"some words to keep " * 30)])[0]
    for at in random.Random(1).sample(range(flac._layout(s)[0], len(s)), 40):
        bad = bytearray(s)
        bad[at] ^= 1 << at % 8
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(bad)])
    bad = bytearray(s)
    bad[4 + 4 + 20] ^= 1  # the stored MD5
    with pytest.raises(flac.FlacError):
        flac.decode([bytes(bad)])


def test_operator(spark, sf):
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "Grüße " * 40000), (5, "y" * 192)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as media", "2 as id")
    got = flac.digest(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = next((t or "") for i, t in rows if i == r.doc_id).encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id == 3}) == 1
    assert flac.digest(docs.limit(0)).count() == 0


def test_pcm_blocks(spark):
    media = flac.store(spark.createDataFrame([(1, "abc " * 3000)], "doc_id long, text string"))
    stream = media.first().media
    blocks = sorted(flac.pcm_blocks(media, frames_each=4).collect(), key=lambda r: r.block)
    assert b"".join(r.pcm for r in blocks) == flac.decode([stream])[0]
    for r in blocks:
        first, _ = flac.decode_frame(stream, r.byte_offset)
        assert np.array(first, np.int8).tobytes() == r.pcm[:192] and r.sample_offset == r.block * 4 * 192
