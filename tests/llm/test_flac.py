"""FLAC streams: exact round trips, the plain reader, damage."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from terralith.llm import flac


def streams_of(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    payload, past = flac.payloads(data, off)
    return payload, past, flac.encode_batch(payload, past)


def samples():
    rng = random.Random(3)
    texts = [b"", b"a", b"x" * 1024, b"y" * 1025, bytes(range(256)) * 9, b"the quick brown fox " * 400, bytes(rng.randrange(256) for _ in range(5000)), bytes((i * i // 50) % 256 for i in range(3000)), "é漢🙂 ".encode() * 100]
    return texts + [bytes(rng.choices(b"abcdef \n", k=rng.randrange(0, 3000))) for _ in range(60)] + [b"lorem ipsum " * 20000]


def test_round_trip_and_plain_reader():
    payload, past, streams = streams_of(samples())
    got, at = flac.decode_batch(streams)
    assert (at == past).all() and (got == payload).all()
    for i, s in enumerate(streams[:20]):
        assert (flac.decode_stream(s)[:, 0] + 128 == payload[past[i] : past[i + 1]]).all()
    assert len(b"".join(streams)) < 0.97 * len(payload)


def test_damage():
    _, _, (stream,) = streams_of([b"some text that is long enough " * 50])
    for at in (0, 90, len(stream) - 5):
        bad = bytearray(stream)
        bad[at] ^= 4
        for read in (lambda s: flac.decode_batch([s]), flac.decode_stream):
            with pytest.raises(ValueError):
                read(bytes(bad))


def test_linear_predictor_and_partitions():
    """A hand-made stream: order-2 LPC with two Rice partitions, one escaped, and wasted bits."""
    want = [8, 16, 20, 28, 44, 60, 64, 80]
    half = [v >> 2 for v in want]
    out, weights, shift = half[:2], [2, -1], 0
    res = [half[i] - ((weights[0] * half[i - 1] + weights[1] * half[i - 2]) >> shift) for i in range(2, 8)]
    bits = ""
    put = lambda v, n: format(v & (1 << n) - 1, f"0{n}b")
    bits += "0" + put(33, 6) + "1" + "01" + "".join(put(v, 6) for v in out)  # wasted 2
    bits += put(4 - 1, 4) + put(shift, 5) + "".join(put(w, 4) for w in weights)
    bits += "00" + put(1, 4) + put(1, 4)
    for r in res[:2]:
        z = r * 2 if r >= 0 else -2 * r - 1
        bits += "0" * (z >> 1) + "1" + str(z & 1)
    bits += put(15, 4) + put(6, 5) + "".join(put(r, 6) for r in res[2:])
    bits += "0" * (-len(bits) % 8)
    head = flac._header(0, 8)
    frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = int(flac._crc16_of(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    frame += crc.to_bytes(2, "big")
    stream = flac._stream_head(8, hashlib.md5(np.array(want, np.int8).tobytes()).digest(), [len(frame)]) + frame
    assert flac.decode_stream(stream)[:, 0].tolist() == want
    got, _ = flac.decode_batch([stream])
    assert (got.astype(int) - 128).tolist() == want


def lpc_stream(want, weights, shift, order, parts):
    """One frame of a general predictor with Rice partitions, and its stream."""
    put = lambda v, n: format(v & (1 << n) - 1, f"0{n}b")
    bits = "0" + put(31 + order, 6) + "0" + "".join(put(v, 8) for v in want[:order]) + put(12 - 1, 4) + put(shift, 5) + "".join(put(w, 12) for w in weights)
    bits += "00" + put(parts, 4)
    for p in range(1 << parts):
        size = len(want) >> parts
        k = 3 + p % 3
        bits += put(k, 4)
        for i in range(max(p * size, order), (p + 1) * size):
            r = want[i] - (sum(w * want[i - 1 - t] for t, w in enumerate(weights)) >> shift)
            z = r * 2 if r >= 0 else -2 * r - 1
            bits += "0" * (z >> k) + "1" + put(z, k)
    bits += "0" * (-len(bits) % 8)
    frame = flac._header(0, len(want)) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    frame += int(flac._crc16_of(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    return flac._stream_head(len(want), hashlib.md5(np.array(want, np.int8).tobytes()).digest(), [len(frame)]) + frame


def test_general_predictors_in_a_batch(monkeypatch):
    """Predictors of several orders with Rice partitions, read in one batch without the plain reader."""
    rng = random.Random(2)
    streams, want = [], []
    for order, weights, shift, parts, n in ((1, [900], 10, 0, 1024), (2, [1900, -950], 10, 2, 1024), (4, [1200, -300, 200, -100], 10, 3, 512), (8, [500, 200, 100, 50, 20, 10, 5, 2], 10, 1, 64), (3, [3, -3, 1], 0, 0, 17)):
        x = [int(60 * np.sin(i / 9)) + rng.randint(-9, 9) for i in range(n)]
        streams.append(lpc_stream(x, weights, shift, order, parts))
        want += x
    for s in streams:
        flac.decode_stream(s)
    monkeypatch.setattr(flac, "decode_stream", lambda _: pytest.fail("the plain reader was asked"))
    got, _ = flac.decode_batch(streams + streams_of([b"some text " * 300])[2])
    assert (got.astype(int) - 128).tolist()[: len(want)] == want


def test_frames(spark):
    rows = [(1, "hello"), (2, None), (2, ""), (None, "é" * 700), (1, "hello"), (9, "long " * 9000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as media", "1 as n_bytes")
    table = flac.write_blocks(flac.store(df))
    got = sorted(flac.digests(table).collect(), key=lambda r: (str(r.doc_id), r.n_bytes))
    assert len(got) == len(rows)
    for r, (doc_id, text) in zip(got, sorted(rows, key=lambda r: (str(r[0]), len((r[1] or "").encode()))), strict=True):
        raw = (text or "").encode()
        pad = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (doc_id, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        s = [b - 128 for b in pad]
        turns = sum((x < 0) != (y < 0) for x, y in zip(s, s[1:]))
        assert r.feature == f"samples={len(s)} sum={sum(s)} energy={sum(v * v for v in s)} peak={max(map(abs, s))} crossings={turns}"
        (stream,) = streams_of([raw])[2]
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
    (block,) = flac.seek(table, 40_000).collect()
    assert (block.doc_id, block.sample_offset, bytes(block.pcm)) == (9, 32_768, ("long " * 9000).encode()[32_768:] + bytes(-45_000 % 64))
    blocks = flac.decode(flac.encode(df.filter("doc_id = 9"))).orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks).rstrip(b"\0").decode() == "long " * 9000 and blocks[1].sample_offset == flac.PCM_BLOCK
    assert flac.encode(df.limit(0)).count() == 0
