"""Media columns: FLAC streams in a binary column, decoded to PCM blocks with seekable sample offsets.

encode() writes streams of 8-bit mono samples: STREAMINFO with the MD5 of the samples, a SEEKTABLE with a point for each
frame, and frames of `FRAME` samples whose subframe is constant, verbatim, or a fixed linear predictor of order 0 to 2
with Rice residuals. decode() takes the frames of all streams of a batch at once: the seek table gives their places, both
checksums of each frame are verified, and sample i of every frame is read in step i, with all fixed and general linear
predictors and Rice partitions. decode_stream() is the plain reader for any stream of up to two channels (escapes, wasted
bits, stereo modes and streams without seek points too); it takes whatever the batch reader doesn't. A damaged stream
raises ValueError.

store() writes the streams, write_blocks() reads them, decodes and writes each document's PCM blocks with their sample
offsets, and digests() reads the blocks. All are tables in the shared folder.

A payload is a text's UTF-8 bytes and zero bytes up to a positive multiple of 64; a byte b is the sample b - 128. null is
an empty text, so 64 zero bytes. Repeated rows stay rows. A text longer than a step is one step, at some 100 bytes of a
worker a byte.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.common import binary_column, drop_scratch, materialize, text_steps

FRAME = 1024
UNIT = 64
RATE = 8000
#: Samples of a PCM block, at most.
PCM_BLOCK = 16_384
STEP = 1_000_000
#: Parts of the corpus whose media are on disk one after the other.
WAVES = 2


def _table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)
        out[b] = c & ((1 << bits) - 1)
    return out


_CRC8, _CRC16 = _table(0x107, 8), _table(0x18005, 16)


def _crc8(raw: bytes) -> int:
    c = 0
    for b in raw:
        c = int(_CRC8[c ^ b])
    return c


def _crc16_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-16 of data[start:start+size] for many spans, byte i of all spans in step i."""
    order = np.argsort(-size, kind="stable")
    s, left = start[order], size[order]
    active = np.searchsorted(-left, -np.arange(int(size.max(initial=0))), side="left")
    crc = np.zeros(len(s), dtype=np.int64)
    for i, n in enumerate(active):
        c = crc[:n]
        crc[:n] = _CRC16[(c >> 8) ^ data[s[:n] + i]] ^ ((c & 0xFF) << 8)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame's number, coded as UTF-8 codes characters."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x20
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        if n < limit:
            return bytes([(0xFF00 >> (len(tail) + 1)) & 0xFF | n, *reversed(tail)])
        limit >>= 1


@functools.lru_cache(maxsize=1 << 16)
def _header(number: int, samples: int) -> bytes:
    full = samples == FRAME
    raw = bytes([0xFF, 0xF8, (0xA0 if full else 0x70) | 4, 0x02]) + _number(number) + (b"" if full else (samples - 1).to_bytes(2, "big"))
    return raw + bytes([_crc8(raw)])


def _stream_head(samples: int, md5: bytes, sizes: list[int]) -> bytes:
    """The magic, STREAMINFO and SEEKTABLE of a stream with frames of the given sizes in bytes."""
    info = FRAME.to_bytes(2, "big") * 2 + bytes(6) + (RATE << 44 | 0 << 41 | 7 << 36 | samples).to_bytes(8, "big") + md5
    points, at = [], 0
    for k, size in enumerate(sizes):
        points.append((k * FRAME).to_bytes(8, "big") + at.to_bytes(8, "big") + min(FRAME, samples - k * FRAME).to_bytes(2, "big"))
        at += size
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + (18 * len(points)).to_bytes(3, "big") + b"".join(points)


def payloads(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The padded payloads of texts, and their offsets."""
    size = np.diff(off)
    padded = np.maximum(-(-size // UNIT), 1) * UNIT
    past = np.concatenate([[0], np.cumsum(padded)])
    out = np.zeros(int(past[-1]), dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(past[:-1] - off[:-1], size)] = data
    return out, past


def encode_batch(data: np.ndarray, off: np.ndarray) -> list[bytes]:
    """The stream of each payload data[off[i]:off[i+1]]; no payload is empty."""
    size = np.diff(off)
    n_frames = -(-size // FRAME)
    row = np.repeat(np.arange(len(size)), n_frames)
    number = np.arange(len(row)) - np.repeat(np.cumsum(n_frames) - n_frames, n_frames)
    start = off[row] + number * FRAME
    length = np.minimum(FRAME, off[row + 1] - start)
    n = len(row)
    inside = np.arange(FRAME)[None, :] < length[:, None]
    x = np.zeros((n, FRAME), dtype=np.int32)
    x[inside] = data.astype(np.int32) - 128
    best = np.full(n, np.iinfo(np.int64).max)
    order, kept = np.zeros(n, dtype=np.int64), np.zeros((n, FRAME), dtype=np.int32)
    residual = x
    for o in range(3):
        if o:
            residual = np.diff(residual, axis=1, prepend=np.int32(0))
        z = np.where(residual < 0, -2 * residual - 1, 2 * residual)
        z[:, :o] = 0
        z[~inside] = 0
        total = z.sum(axis=1, dtype=np.int64)
        better = (total < best) & (length > o)
        best[better], order[better] = total[better], o
        kept[better] = z[better]
    count = length - order
    guess = np.clip(np.round(np.log2(np.maximum(best / np.maximum(count, 1), 1)) - 0.5).astype(np.int64), 0, 13)
    bits, k = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
    for d in (-1, 0, 1):
        t = np.clip(guess + d, 0, 14)
        b = (kept >> t[:, None].astype(np.int32)).sum(axis=1, dtype=np.int64) + (1 + t) * count
        better = b < bits
        bits[better], k[better] = b[better], t[better]
    rice_bits = 8 + 8 * order + 10 + bits
    constant = (x.max(axis=1, where=inside, initial=-128) == x.min(axis=1, where=inside, initial=127)) & (length > 0)
    plain = ~constant & (rice_bits >= 8 + 8 * length)
    rice = ~constant & ~plain
    body = np.where(constant, 2, np.where(plain, 1 + length, -(-rice_bits // 8)))
    heads = [_header(int(a), int(b)) for a, b in zip(number, length, strict=True)]
    head_size = np.array([len(h) for h in heads], dtype=np.int64)
    frame_size = head_size + body + 2
    at = np.cumsum(frame_size) - frame_size  # frames one after the other; stream heads are put between them at the end
    out_bits = np.zeros(int(frame_size.sum()) * 8, dtype=np.uint8)
    f = np.flatnonzero(rice)
    if len(f):
        base = (at[f] + head_size[f]) * 8
        kind = 0b00010000 | order[f] << 1
        for b in range(8):
            out_bits[base + b] = kind >> (7 - b) & 1
        for o in range(2):
            w = f[order[f] > o]
            warm = x[w, o] & 0xFF
            for b in range(8):
                out_bits[(at[w] + head_size[w]) * 8 + 8 + 8 * o + b] = warm >> (7 - b) & 1
        after = base + 8 + 8 * order[f]
        for b in range(4):
            out_bits[after + 6 + b] = k[f] >> (3 - b) & 1
        valid = inside[f] & (np.arange(FRAME)[None, :] >= order[f][:, None])
        z = kept[f]
        kk = k[f].astype(np.int32)[:, None]
        q = z >> kk
        width = np.where(valid, q + 1 + kk, 0).astype(np.int64)
        pos = (after + 10)[:, None] + np.cumsum(width, axis=1) - width
        stop = (pos + q)[valid]
        value = z[valid]
        of_k = np.broadcast_to(kk, z.shape)[valid]
        out_bits[stop] = 1
        for t in np.unique(of_k):
            pick = of_k == t
            s, v = stop[pick], value[pick]
            for b in range(int(t)):
                out_bits[s + (1 + b)] = v >> (int(t) - 1 - b) & 1
    out = np.packbits(out_bits)
    hb = np.frombuffer(b"".join(heads), np.uint8)
    out[np.arange(len(hb)) + np.repeat(at - (np.cumsum(head_size) - head_size), head_size)] = hb
    sub = at + head_size
    out[sub[plain]] = 0b00000010
    if plain.any():
        lens = length[plain]
        src = np.repeat(start[plain] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        dst = np.repeat(sub[plain] + 1 - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        out[dst] = data[src] ^ 0x80
    out[sub[constant]] = 0
    out[sub[constant] + 1] = data[start[constant]] ^ 0x80
    crc = _crc16_of(out, at, frame_size - 2)
    out[at + frame_size - 2], out[at + frame_size - 1] = crc >> 8, crc & 0xFF
    first = np.concatenate([[0], np.cumsum(n_frames)])
    past = np.append(at, len(out))
    streams = []
    for i in range(len(size)):
        a, b = first[i], first[i + 1]
        md5 = hashlib.md5(data[off[i] : off[i + 1]] ^ 0x80).digest()
        streams.append(_stream_head(int(size[i]), md5, frame_size[a:b].tolist()) + out[past[a] : past[b]].tobytes())
    return streams


class _Bits:
    def __init__(self, raw: bytes, at: int):
        self.raw, self.at = raw, at * 8

    def read(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.raw):
            raise ValueError("the stream ends early")
        self.at += n
        return int.from_bytes(self.raw[a:b], "big") >> (b * 8 - self.at) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while True:
            a, left = self.at >> 3, 64 - (self.at & 7)
            got = int.from_bytes(self.raw[a : a + 8].ljust(8, b"\0"), "big") & ((1 << left) - 1)
            if got:
                n += left - got.bit_length()
                self.at += left - got.bit_length() + 1
                return n
            if a + 8 >= len(self.raw):
                raise ValueError("the stream ends early")
            n += left
            self.at += left


_FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])


def _subframe(bits: _Bits, n: int, depth: int) -> list[int]:
    if bits.read(1):
        raise ValueError("a reserved bit is set")
    kind, wasted = bits.read(6), 0
    if bits.read(1):
        wasted = bits.unary() + 1
        depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * n
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        if kind < 32:
            weights, shift = _FIXED[order], 0
        else:
            precision, shift = bits.read(4) + 1, bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        method, parts = bits.read(2), bits.read(4)
        if method > 1:
            raise ValueError("an unknown residual code")
        wide = 5 if method else 4
        for p in range(1 << parts):
            count = (n >> parts) - (0 if p else order)
            k = bits.read(wide)
            if k == (1 << wide) - 1:
                raw = bits.read(5)
                rest = [bits.signed(raw) for _ in range(count)]
            else:
                rest = []
                for _ in range(count):
                    z = bits.unary() << k | bits.read(k)
                    rest.append(z >> 1 ^ -(z & 1))
            for r in rest:
                out.append(r + (sum(w * out[-1 - j] for j, w in enumerate(weights)) >> shift))
    else:
        raise ValueError("a reserved subframe")
    return [v << wasted for v in out]


def _info(raw: bytes) -> tuple[dict, int]:
    """What the metadata say, and where frames begin."""
    if raw[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, last = 4, {}, False
    while not last:
        last, kind, size = raw[at] >> 7, raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4], "big")
        body = raw[at + 4 : at + 4 + size]
        if kind == 0:
            v = int.from_bytes(body[10:18], "big")
            info |= {"frame": int.from_bytes(body[:2], "big"), "channels": (v >> 41 & 7) + 1, "depth": (v >> 36 & 31) + 1, "samples": v & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            info["seek"] = np.frombuffer(body, ">u8,>u8,>u2")
        at += 4 + size
    return info, at


def decode_stream(raw: bytes) -> np.ndarray:
    """The samples of a stream, one column a channel; checks both checksums of every frame, the count and the MD5."""
    info, at = _info(raw)
    out: list[np.ndarray] = []
    while at < len(raw):
        bits = _Bits(raw, at)
        if bits.read(15) != 0x7FFC:
            raise ValueError("no frame where one should be")
        bits.read(1)
        block, rate, mode, width = bits.read(4), bits.read(4), bits.read(4), bits.read(3)
        bits.read(1)
        lead = bits.read(8)
        while lead & 0xC0 >= 0xC0 and lead & 0x40:
            bits.read(8)
            lead = (lead << 1) & 0xFF
        n = 192 if block == 1 else 576 << (block - 2) if block <= 5 else bits.read(8) + 1 if block == 6 else bits.read(16) + 1 if block == 7 else 256 << (block - 8)
        bits.read({12: 8, 13: 16, 14: 16}.get(rate, 0))
        if _crc8(raw[at : bits.at >> 3]) != bits.read(8):
            raise ValueError("a frame header is damaged")
        depth = {0: info["depth"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[width]
        channels = mode + 1 if mode < 8 else 2
        got = [np.array(_subframe(bits, n, depth + (mode in (8, 10) and c == 1 or mode == 9 and c == 0)), dtype=np.int64) for c in range(channels)]
        if mode == 8:
            got[1] = got[0] - got[1]
        elif mode == 9:
            got[0] = got[0] + got[1]
        elif mode == 10:
            mid = got[0] << 1 | got[1] & 1
            got = [(mid + got[1]) >> 1, (mid - got[1]) >> 1]
        end = (bits.at + 7) >> 3
        if int(_crc16_of(np.frombuffer(raw, np.uint8), np.array([at]), np.array([end - at]))[0]) != int.from_bytes(raw[end : end + 2], "big"):
            raise ValueError("a frame is damaged")
        at = end + 2
        out.append(np.column_stack(got))
    samples = np.concatenate(out) if out else np.zeros((0, info["channels"]), np.int64)
    if len(samples) != info["samples"] or info["depth"] == 8 and info["md5"] != bytes(16) and hashlib.md5(samples.astype(np.int8).tobytes()).digest() != info["md5"]:
        raise ValueError("the samples are not those of the stream's head")
    return samples


def _residuals(raw: np.ndarray, pos: np.ndarray, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(folded Rice residuals of every frame, frames with escapes or codes of other kinds, which aren't read).

    pos: the bit where each frame's residual begins; frames stand in descending order of n - order. Residual j of all
    frames is read in step j; a frame takes a new parameter where a partition begins.
    """
    pos = pos.copy()
    word = np.zeros(len(raw), dtype=np.uint32)
    word[:-3] = raw[:-3].astype(np.uint32) << 24 | raw[1:-2].astype(np.uint32) << 16 | raw[2:-1].astype(np.uint32) << 8 | raw[3:]
    bits = np.unpackbits(raw)
    ones = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
    ahead = np.minimum.accumulate(ones[::-1])[::-1]
    del bits, ones
    head = word[pos >> 3].astype(np.int64) >> (26 - (pos & 7)) & 63
    wide = np.where(head >> 4 == 1, 5, 4)
    part = n >> (head & 15)
    odd = (head >> 4 > 1) | (n & ((1 << (head & 15)) - 1) > 0) | (part < order) | ((part == order) & (part < n))
    pos += 6
    k = np.zeros(len(n), dtype=np.int64)
    left = np.where(odd, 0, n - order)
    rows = np.argsort(-left, kind="stable")
    order, wide, part, left, pos, k = order[rows], wide[rows], part[rows], left[rows], pos[rows], k[rows]
    several = part < n[rows]
    bad = np.zeros(len(n), dtype=bool)
    active = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), side="left")
    z = np.zeros((len(n), FRAME), dtype=np.int64)
    any_parts = bool(several.any())
    for j, m in enumerate(active):
        if j == 0 or any_parts:
            new = np.flatnonzero((order[:m] + j) % part[:m] == 0) if j else np.arange(m)
            p, w = pos[new], wide[new]
            k[new] = word[p >> 3].astype(np.int64) >> (32 - (p & 7) - w) & ((1 << w) - 1)
            pos[new] = p + w
            escape = new[(k[new] == (1 << w) - 1) | (k[new] > 24)]
            bad[escape], k[escape] = True, 0
        p, kk = pos[:m], k[:m]
        stop = ahead[np.minimum(p, len(ahead) - 1)].astype(np.int64)
        s = np.minimum(stop + 1, len(ahead) - 40)
        z[:m, j] = (stop - p) << kk | word[s >> 3].astype(np.int64) >> (32 - (s & 7) - kk) & ((1 << kk) - 1)
        pos[:m] = s + kk
    out = np.empty_like(z)
    out[rows] = z
    odd[rows] |= bad
    return out, odd


def decode_batch(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(samples as bytes b = sample + 128, offsets by stream) of 8-bit mono streams."""
    infos = [_info(s) for s in streams]
    samples = np.array([i["samples"] for i, _ in infos], dtype=np.int64)
    past = np.concatenate([[0], np.cumsum(samples)])
    result = np.zeros(int(past[-1]), dtype=np.uint8)
    known = [k for k, (i, _) in enumerate(infos) if "seek" in i and i["channels"] == 1 and i["depth"] == 8 and i["frame"] == FRAME and len(i["seek"]) == -(-i["samples"] // FRAME)]
    odd = set(range(len(streams))) - set(known)
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    raw = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    if known:
        begin, end, to, n = [], [], [], []
        for k in known:
            seek, first = infos[k][0]["seek"], base[k] + infos[k][1]
            begin.append(first + seek["f1"].astype(np.int64))
            end.append(np.append(begin[-1][1:], base[k + 1]))
            to.append(past[k] + seek["f0"].astype(np.int64))
            n.append(seek["f2"].astype(np.int64))
        begin, end, to, n = (np.concatenate(v) for v in (begin, end, to, n))
        crc = _crc16_of(raw, begin, end - begin - 2)
        if (crc != (raw[end - 2].astype(np.int64) << 8 | raw[end - 1])).any() or (raw[begin] != 0xFF).any() or (raw[begin + 1] != 0xF8).any():
            raise ValueError("a frame is damaged")
        lead = raw[begin + 4]
        number = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8], [1, 2, 3, 4], 5)
        sub = begin + 5 + number + np.where(raw[begin + 2] >> 4 == 7, 2, 0)
        for size in np.unique(sub - begin):
            rows = begin[sub - begin == size]
            c = np.zeros(len(rows), dtype=np.int64)
            for j in range(int(size)):
                c = _CRC8[c ^ raw[rows + j]]
            if c.any():  # the checksum of a header with its checksum is 0
                raise ValueError("a frame header is damaged")
        kind = (raw[sub] >> 1).astype(np.int64)
        fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
        coded = fixed | lpc
        order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
        strange = ~(coded | (kind <= 1)) | (raw[sub] & 1 > 0) | (order > n)  # reserved kinds and wasted bits
        x = np.zeros((len(begin), FRAME), dtype=np.int32)
        f = np.flatnonzero((kind == 0) & ~strange)
        x[f] = raw[sub[f] + 1].view(np.int8)[:, None]
        f = np.flatnonzero((kind == 1) & ~strange)
        for j in range(int(n[f].max(initial=0))):
            g = f[n[f] > j]
            x[g, j] = raw[sub[g] + 1 + j].view(np.int8)
        weights, shift = np.zeros((len(begin), 32), dtype=np.int64), np.zeros(len(begin), dtype=np.int64)
        for o, w in enumerate(_FIXED):
            weights[np.ix_(fixed & (order == o), range(o))] = w
        after = (sub + 1 + order) * 8
        for k in np.flatnonzero(lpc & ~strange):
            bits = _Bits(raw.data, 0)
            bits.at = int(after[k])
            precision, shift[k] = bits.read(4) + 1, bits.signed(5)
            weights[k, : order[k]] = [bits.signed(precision) for _ in range(order[k])]
            after[k] = bits.at
            strange[k] |= shift[k] < 0
        f = np.flatnonzero(coded & ~strange)
        if len(f):
            f = f[np.argsort(-(n[f] - order[f]), kind="stable")]
            z, odd_ones = _residuals(raw, after[f], n[f], order[f])
            strange[f[odd_ones]] = True
            e = (z >> 1 ^ -(z & 1)).astype(np.int32)
            for o in np.unique(order[f]):
                rows = np.flatnonzero(order[f] == o)
                g = f[rows]
                v = np.zeros((len(rows), FRAME), dtype=np.int32)
                v[:, o:] = e[rows][:, : FRAME - o]
                for t in range(o):
                    v[:, t] = raw[sub[g] + 1 + t].view(np.int8)
                simple = fixed[g[0]] and o <= 2 and fixed[g].all()
                if o == 2 and simple:
                    v[:, 1] -= v[:, 0]
                    first = v[:, 0].copy()
                    v[:, 1:] = np.cumsum(v[:, 1:], axis=1)
                    v[:, 0] = first
                if simple:
                    x[g] = np.cumsum(v, axis=1) if o else v
                else:
                    w, s = weights[g, :o][:, ::-1], shift[g]
                    v = v.astype(np.int64)
                    for j in range(o, int(n[g].max())):
                        v[:, j] += (v[:, j - o : j] * w).sum(axis=1) >> s
                    x[g] = v
        inside = np.arange(FRAME)[None, :] < n[:, None]
        at = (to[:, None] + np.arange(FRAME)[None, :])[inside]
        result[at] = (x[inside] + 128).astype(np.uint8)
        if strange.any():
            owner = np.searchsorted(past, to[strange], side="right") - 1
            odd |= set(owner.tolist())
    for k in odd:
        got = decode_stream(streams[k])
        if got.shape[1] != 1 or infos[k][0]["depth"] != 8:
            raise ValueError("8-bit mono streams are asked for")
        result[past[k] : past[k + 1]] = (got[:, 0] + 128).astype(np.uint8)
    for k in set(range(len(streams))) - odd:
        if hashlib.md5(result[past[k] : past[k + 1]] ^ 0x80).digest() != infos[k][0]["md5"]:
            raise ValueError("the samples are not those of the stream's head")
    return result, past


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in text_steps(batch, step=STEP):
            payload, past = payloads(data, off)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off), pa.int64()), binary_column(encode_batch(payload, past))], names=["doc_id", "n_bytes", "media"])


def encode(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes (unpadded) and media, the FLAC stream of each document's payload."""
    return documents.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text")).mapInArrow(_encode, "doc_id bigint, n_bytes bigint, media binary")


def _media_steps(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, list[bytes]]]:
    col, lo, size, held = batch.column(k), 0, 0, []
    for i in range(batch.num_rows):
        held.append(col[i].as_py())
        size += len(held[-1])
        if size >= STEP:
            yield lo, held
            lo, size, held = i + 1, 0, []
    if held:
        yield lo, held


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for lo, streams in _media_steps(batch, 1):
            data, past = decode_batch(streams)
            rows = [(ids[lo + i], at, min(PCM_BLOCK, b - a - at), data[a + at : min(a + at + PCM_BLOCK, b)].tobytes()) for i, (a, b) in enumerate(zip(past[:-1].tolist(), past[1:].tolist(), strict=True)) for at in range(0, b - a, PCM_BLOCK)]
            a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), binary_column(list(d))], names=["doc_id", "sample_offset", "n_samples", "pcm"])


def decode(media: DataFrame) -> DataFrame:
    """PCM blocks of streams (doc_id, media): sample_offset, n_samples and pcm, unsigned 8-bit; a seek is a filter on sample_offset."""
    return media.filter("media is not null").select("doc_id", "media").mapInArrow(_blocks, "doc_id bigint, sample_offset bigint, n_samples bigint, pcm binary")


#: What a table of PCM blocks holds: the blocks of a document in order, and what is known of its stored stream.
BLOCKS = "doc_id bigint, n_bytes bigint, media_bytes bigint, media_sha256 string, blocks array<struct<sample_offset:bigint,n_samples:bigint,pcm:binary>>"


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, streams in _media_steps(batch, 2):
            data, past = decode_batch(streams)
            size = np.diff(past)
            n_blocks = -(-size // PCM_BLOCK)
            ends = np.cumsum(n_blocks)
            at = (np.arange(int(ends[-1])) - np.repeat(ends - n_blocks, n_blocks)) * PCM_BLOCK
            start = np.repeat(past[:-1], n_blocks) + at
            pcm = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(start, past[-1]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
            length = np.minimum(PCM_BLOCK, np.repeat(size, n_blocks) - at)
            blocks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(length, pa.int64()), pcm], ["sample_offset", "n_samples", "pcm"]))
            n = len(streams)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array([len(s) for s in streams], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in streams], pa.string()), blocks], names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"])


def store(documents: DataFrame) -> DataFrame:
    """encode(documents) as a table in the shared folder."""
    return materialize(encode(documents), "media")


def write_blocks(media: DataFrame) -> DataFrame:
    """A table in the shared folder of each document's PCM blocks, decoded from its stored stream; the last block's end is the stream's."""
    return materialize(media.select("doc_id", "n_bytes", "media").mapInArrow(_block_rows, BLOCKS), "pcm")


def seek(blocks: DataFrame, sample: int) -> DataFrame:
    """doc_id, sample_offset, n_samples and pcm of the block with that sample of every document that has it."""
    found = blocks.select("doc_id", F.element_at("blocks", F.when(F.size("blocks") > sample // PCM_BLOCK, sample // PCM_BLOCK + 1).otherwise(1)).alias("b"))
    return found.select("doc_id", "b.*").filter(F.lit(sample).between(F.col("sample_offset"), F.col("sample_offset") + F.col("n_samples") - 1))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests and features of stored blocks; a document's blocks must follow one another without gaps."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(4)
        row = col.offsets.to_numpy()
        parts = [col.values.field(k) for k in range(3)]
        offset, length = parts[0].to_numpy(), parts[1].to_numpy()
        for i in range(batch.num_rows):
            a, b = row[i], row[i + 1]
            if (offset[a:b] != np.concatenate([[0], np.cumsum(length[a:b])[:-1]])).any():
                raise ValueError("blocks are missing")
        raw = parts[2].buffers()[2]
        at = np.frombuffer(parts[2].buffers()[1], np.int32)[parts[2].offset : parts[2].offset + len(parts[2]) + 1].astype(np.int64)
        past = at[row]
        data = np.frombuffer(raw, np.uint8)
        lo = 0
        while lo < batch.num_rows:  # steps of bounded size
            hi = max(lo + 1, int(np.searchsorted(past, past[lo] + STEP, side="right")) - 1)
            first, size = past[lo:hi] - past[lo], np.diff(past[lo : hi + 1])
            s = data[past[lo] : past[hi]].astype(np.int64) - 128
            energy, total = np.add.reduceat(s * s, first), np.add.reduceat(s, first)
            peak = np.maximum.reduceat(np.abs(s), first)
            turns = np.zeros(len(s), dtype=np.int64)
            turns[1:] = (s[1:] < 0) != (s[:-1] < 0)
            turns[first] = 0
            crossings = np.add.reduceat(turns, first)
            sha, crc, feature = [], [], []
            for i in range(hi - lo):
                a, b = past[lo + i], past[lo + i + 1]
                sha.append(hashlib.sha256(data[a:b]).hexdigest())
                crc.append(zlib.crc32(data[b - UNIT : b]))
                feature.append(f"samples={size[i]} sum={total[i]} energy={energy[i]} peak={peak[i]} crossings={crossings[i]}")
            kept = [batch.column(k).slice(lo, hi - lo) for k in range(4)]
            yield pa.RecordBatch.from_arrays([kept[0], kept[1], pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), kept[2], kept[3], pa.array(feature, pa.string())], names=names)
            lo = hi


def digests(blocks: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of every document of a table of blocks.

    feature: the samples' number, sum, energy (sum of squares), largest magnitude and changes of sign.
    """
    return blocks.mapInArrow(_digests, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all documents' stored media. Documents go in `WAVES` waves by hash, so that the folder holds the
    streams and blocks of one wave at a time; every document is in one wave."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for wave in range(WAVES):
        media = store(docs.filter(F.expr(f"pmod(xxhash64(doc_id, text), {WAVES}) = {wave}")))
        blocks = write_blocks(media)
        part = materialize(digests(blocks), "digests")
        drop_scratch(media, blocks)
        out = part if out is None else out.union(part)
    return out
