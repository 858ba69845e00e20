"""Media columns: bytes kept losslessly as 8-bit mono FLAC, decoded back from Rice
residuals and linear predictors with every checksum verified, and cut into PCM
blocks with sample and byte offsets to seek by.

Frames are independent, so thousands of them are encoded or decoded at once, one
sample of each per numpy step. Streams written here hold one frame for each
``BLOCK`` samples and a seek table with every frame (every n-th in very long streams, where
frames between are found by their headers); streams from elsewhere (8-bit mono, any
predictor, partition order or escape) are read frame by frame.

Defined results: null text counts as empty; an empty payload becomes one block of
spaces; repeated rows give repeated results, and equal texts equal streams; an empty table
gives no rows; extra columns are ignored; a damaged stream raises ``FlacError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 192
LPC_ORDER = 4
LPC_BITS = 8
#: Entries of a seek table, at most (its length is a number of 24 bits); of a longer stream
#: it has every n-th frame.
POINTS = ((1 << 24) - 1) // 18
_POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
_SLICE = 4096
_BATCH_BYTES = 8 << 20


class FlacError(ValueError):
    """A stream is not what its checksums say, or not 8-bit mono FLAC."""


def _table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.zeros(256, np.uint16)
    for n in range(256):
        c = n << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out[n] = c
    return out


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _crc8(m: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(m), np.uint16)
    for k in range(int(sizes.max(initial=0))):
        crc = np.where(k < sizes, _CRC8[crc ^ m[:, k]], crc)
    return crc


def _crc16(m: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    crc, cols = np.zeros(len(m), np.uint16), np.ascontiguousarray(m.T)
    least = int(sizes.min(initial=0))
    for k in range(int(sizes.max(initial=0))):
        nxt = (crc << 8) ^ _CRC16[(crc >> 8) ^ cols[k]]
        crc = nxt if k < least else np.where(k < sizes, nxt, crc)
    return crc


# ---- encoding -------------------------------------------------------------------


def _number_bytes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the header's UTF-8 like code: bytes [F, 6] and how many count."""
    size = np.ones(len(n), np.int64)
    for k, bound in enumerate((0x80, 0x800, 0x10000, 0x200000, 0x4000000), 2):
        size[n >= bound] = k
    out = np.zeros((len(n), 6), np.int64)
    for k in range(1, 7):
        own = size == k
        if k == 1:
            out[own, 0] = n[own]
            continue
        out[own, 0] = (0xFF << (8 - k) & 0xFF) | n[own] >> (6 * (k - 1))
        for j in range(1, k):
            out[own, j] = 0x80 | (n[own] >> (6 * (k - 1 - j)) & 0x3F)
    return out, size


def _predictors(x: np.ndarray, order: int) -> np.ndarray:
    """Quantised coefficients [F, order] (scaled by 2**LPC_BITS-2) from the frames'
    autocorrelation by Levinson's recursion."""
    f = x.astype(np.float32)
    n = f.shape[1]
    r = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : n - k]) for k in range(order + 1)], 1).astype(np.float64)
    r[:, 0] = r[:, 0] * 1.0001 + 1e-3
    a = np.zeros((len(f), order))
    err = r[:, 0].copy()
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1][:, :i]).sum(1)) / err
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        err = np.maximum(err * (1 - k * k), 1e-6)
    top = 1 << (LPC_BITS - 1)
    return np.clip(np.rint(a * (1 << (LPC_BITS - 2))), -top, top - 1).astype(np.int32)


def _zigzag(r: np.ndarray) -> np.ndarray:
    return np.where(r >= 0, r << 1, (-r << 1) - 1)


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, parameter) of the cheapest Rice code of each row, among three near the mean."""
    mean = u.mean(1)
    guess = np.clip(np.log2(np.maximum(mean, 1)).astype(np.int32), 1, 13)
    bits = np.stack([u.shape[1] * (guess + d + 1) + (u >> (guess + d)[:, None]).sum(1) for d in (-1, 0, 1)])
    return bits.min(0), guess + bits.argmin(0) - 1


def _heads(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frame headers [F, 10] without their CRC, how many bytes the number takes, and the CRC."""
    number, size = _number_bytes(numbers)
    head = np.zeros((len(numbers), 10), np.int64)
    head[:, :4] = (0xFF, 0xF8, 0x14, 0x02)  # sync, fixed block size; 192 samples at 8 kHz; mono of 8 bits
    head[:, 4:] = number
    return head, size, _crc8(head, 4 + size)


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed 8-bit samples [F, BLOCK] and frame numbers to (bytes of all frames one
    after the other, size of each)."""
    x = samples.astype(np.int32)
    count, n = x.shape
    kinds: list[tuple[int, np.ndarray]] = []  # order (fixed: order, linear: 8 + order), residual
    r = x
    for order in range(3):
        kinds.append((order, r[:, order:] if order == 0 else r))
        r = np.diff(r, axis=1)
    coef = _predictors(x, LPC_ORDER)
    pred = np.zeros((count, n - LPC_ORDER), np.int32)
    for j in range(LPC_ORDER):
        pred += coef[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : n - 1 - j]
    kinds.append((8 + LPC_ORDER, x[:, LPC_ORDER:] - (pred >> (LPC_BITS - 2))))
    codes = [_zigzag(res) for _, res in kinds]
    costs, params = zip(*map(_rice, codes), strict=True)
    extra = [k * 8 if k < 8 else (k - 8) * (8 + LPC_BITS) + 9 for k, _ in kinds]
    cost = np.stack([c + e + 10 for c, e in zip(costs, extra, strict=True)])
    best, least = cost.argmin(0), cost.min(0)
    best[least >= 8 * n] = len(kinds)
    best[(x == x[:, :1]).all(1)] = len(kinds) + 1
    head, number_size, crc8 = _heads(numbers)
    head_bits = np.where(np.arange(10) < (4 + number_size)[:, None], 8, 0)
    frames = [None] * count
    out_rows, out_sizes, width = [], np.zeros(count, np.int64), 0
    for kind in range(len(kinds) + 2):
        own = np.flatnonzero(best == kind)
        if not len(own):
            continue
        values, sizes = [head[own], crc8[own, None].astype(np.int64)], [head_bits[own], np.full((len(own), 1), 8)]

        def put(v, b, values=values, sizes=sizes):
            values.append(np.asarray(v, np.int64))
            sizes.append(np.broadcast_to(np.asarray(b, np.int64), values[-1].shape))

        col = lambda v, own=own: np.full((len(own), 1), v)
        if kind == len(kinds):
            put(col(0b000001 << 1), 8)
            put(x[own] & 0xFF, 8)
        elif kind > len(kinds):
            put(col(0), 8)
            put(x[own, :1] & 0xFF, 8)
        else:
            code = kinds[kind][0]
            order = code if code < 8 else code - 8
            put(col((0b001000 | order if code < 8 else 0b100000 | (order - 1)) << 1), 8)
            if order:
                put(x[own, :order] & 0xFF, 8)
            if code >= 8:
                put(col(LPC_BITS - 1), 4)
                put(col(LPC_BITS - 2), 5)
                put(coef[own] & ((1 << LPC_BITS) - 1), LPC_BITS)
            k = params[kind][own][:, None]
            put(col(0), 6)  # four-bit parameters, one partition
            put(k, 4)
            u = codes[kind][own]
            put((1 << k) | (u & ((1 << k) - 1)), (u >> k) + 1 + k)
        v, b = np.concatenate(values, 1), np.concatenate(sizes, 1)
        end = np.cumsum(b, 1)
        size = (end[:, -1] + 7) // 8
        bits = np.zeros((len(own), int(size.max()) * 8), np.uint8)
        flat, at = bits.reshape(-1), (end + np.arange(len(own))[:, None] * bits.shape[1] - 1).ravel()
        v, b = v.ravel(), np.minimum(b.ravel(), 63)
        if not b.all():
            v, at, b = v[b > 0], at[b > 0], b[b > 0]
        for j in range(int(v.max()).bit_length()):
            on = np.flatnonzero(v >> j & 1)
            flat[at[on] - j] = 1
        packed = np.packbits(bits, axis=1)
        crc = _crc16(packed, size)
        whole = np.zeros((len(own), packed.shape[1] + 2), np.uint8)
        whole[:, :-2] = packed
        rows = np.arange(len(own))
        whole[rows, size], whole[rows, size + 1] = crc >> 8, crc & 0xFF
        out_rows.append((own, whole))
        out_sizes[own] = size + 2
        width = max(width, whole.shape[1])
    frames = np.zeros((count, width), np.uint8)
    for own, whole in out_rows:
        frames[own, : whole.shape[1]] = whole
    return frames[np.arange(width) < out_sizes[:, None]], out_sizes


def padded(raw: bytes) -> bytes:
    """Bytes 32 appended up to a positive multiple of BLOCK."""
    return raw + b" " * (-len(raw) % BLOCK if raw else BLOCK)


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of BLOCK bytes) as a FLAC stream."""
    if not payloads:
        return []
    counts = [len(p) // BLOCK for p in payloads]
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts])
    data, sizes = zip(*(encode_frames(samples[a : a + _SLICE], numbers[a : a + _SLICE]) for a in range(0, len(samples), _SLICE)), strict=True)
    data, sizes = np.concatenate(data).tobytes(), np.concatenate(sizes)
    ends = np.cumsum(sizes)
    out, first = [], 0
    for p, c in zip(payloads, counts, strict=True):
        own = sizes[first : first + c]
        start, stop = int(ends[first] - sizes[first]), int(ends[first + c - 1])
        pcm = samples[first : first + c].tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (8000 << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(pcm, usedforsecurity=False).digest()
        points = np.arange(0, c, -(-c // POINTS))
        seek = np.zeros(len(points), _POINT)
        seek["sample"], seek["offset"], seek["n"] = points * BLOCK, (np.cumsum(own) - own)[points], BLOCK
        out.append(b"fLaC" + b"\0\0\0\x22" + info + b"\x83" + seek.nbytes.to_bytes(3, "big") + seek.tobytes() + data[start:stop])
        first += c
    return out


# ---- decoding -------------------------------------------------------------------

#: Block sizes by their four-bit code (6 and 7: given after the number).
_BLOCK_SIZES = {1: 192} | {k: 576 << (k - 2) for k in range(2, 6)} | {k: 256 << (k - 8) for k in range(8, 16)}


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def read(self, n: int) -> int:
        if self.at + n > len(self.data) * 8:
            raise FlacError("frame ends early")
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        v = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.at - n) & ((1 << n) - 1)
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.read(n) if n else 0
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
        return n


def _predict(out: list[int], residual: list[int], coef: list[int], shift: int) -> list[int]:
    for r in residual:
        out.append(r + (sum(c * out[-1 - j] for j, c in enumerate(coef)) >> shift))
    return out


#: Coefficients of the five fixed predictors.
_FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])


def decode_frame(data: bytes, at: int) -> tuple[list[int], int]:
    """(samples, where the next frame starts) of any 8-bit mono frame: the plain way,
    one sample after the other."""
    b = _Bits(data, at)
    if b.read(15) != 0x7FFC:
        raise FlacError("no frame here")
    b.read(1)
    size, rate = b.read(4), b.read(4)
    if b.read(4) or b.read(3) not in (0, 1):
        raise FlacError("not 8-bit mono")
    b.read(1)
    lead = b.read(8)
    for _ in range(7 - (lead ^ 0xFF).bit_length() if lead >= 0xC0 else 0):
        b.read(8)
    n = b.read(8) + 1 if size == 6 else b.read(16) + 1 if size == 7 else _BLOCK_SIZES.get(size)
    if n is None:
        raise FlacError("block size")
    b.read({12: 8, 13: 16, 14: 16}.get(rate, 0))
    head = np.frombuffer(data, np.uint8)[at : b.at // 8]
    if b.read(8) != int(_crc8(head[None, :], np.array([len(head)]))[0]):
        raise FlacError("header checksum")
    b.read(1)
    kind, wasted = b.read(6), 0
    if b.read(1):
        wasted = b.unary() + 1
    bps = 8 - wasted
    if kind == 0:
        out = [b.signed(bps)] * n
    elif kind == 1:
        out = [b.signed(bps) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [b.signed(bps) for _ in range(order)]
        coef, shift = _FIXED[order] if kind < 32 else [], 0
        if kind >= 32:
            precision = b.read(4) + 1
            shift = b.read(5)
            coef = [b.signed(precision) for _ in range(order)]
        wide, parts = 4 + b.read(2), b.read(4)
        residual = []
        for p in range(1 << parts):
            k = b.read(wide)
            for _ in range((n >> parts) - (order if p == 0 else 0)):
                if k == (1 << wide) - 1:
                    raw = b.read(5) if not _ else raw
                    residual.append(b.signed(raw))
                else:
                    u = b.unary() << k
                    u |= b.read(k) if k else 0
                    residual.append(u >> 1 ^ -(u & 1))
        out = _predict(out, residual, coef, shift)
    else:
        raise FlacError("subframe type")
    end = (b.at + 7) // 8
    body = np.frombuffer(data, np.uint8)[at:end]
    if end + 2 > len(data) or int.from_bytes(data[end : end + 2], "big") != int(_crc16(body[None, :], np.array([len(body)]))[0]):
        raise FlacError("frame checksum")
    return [v << wasted for v in out], end + 2


def decode_frames(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Frames of BLOCK samples at known places, all at once: int8 samples [F, BLOCK]."""
    count, width = len(starts), int(sizes.max()) + 16
    at = starts[:, None] + np.arange(width)
    m = np.where(np.arange(width) < sizes[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
    if (_crc16(m, sizes) != 0).any():  # over the frame and its checksum
        raise FlacError("frame checksum")
    lead = m[:, 4]
    number = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
    plain = (m[:, 0] == 0xFF) & (m[:, 1] == 0xF8) & (m[:, 2] == 0x14) & (m[:, 3] == 0x02)
    rows = np.arange(count)
    if (_crc8(m, 5 + number) != 0).any():
        raise FlacError("header checksum")
    kind = m[rows, 5 + number].astype(np.int64)
    plain &= kind & 0x81 == 0
    kind >>= 1
    w = np.zeros((count, width - 8), np.uint64)
    for k in range(8):
        w = w << np.uint64(8) | m[:, k : k + width - 8]
    base, flat = rows * w.shape[1], w.reshape(-1)
    out = np.zeros((count, BLOCK), np.int32)

    def take(pos, own, n):
        """The next n (1 to 32) bits of the frames own."""
        v = flat[base[own] + (pos >> 3)] << (pos & 7).astype(np.uint64)
        return (v >> np.uint64(64 - n)).astype(np.int64)

    def signed(v, n):
        return v - ((v >> (n - 1)) << n)

    slow = list(np.flatnonzero(~plain))
    for code in np.unique(kind[plain]):
        own = np.flatnonzero(plain & (kind == code))
        pos = (6 + number[own]) * 8
        if code == 0:
            out[own] = signed(take(pos, own, 8), 8)[:, None]
            continue
        if code == 1:
            cols = (6 + number[own])[:, None] + np.arange(BLOCK)
            out[own] = m[own[:, None], cols].view(np.int8)
            continue
        if not (8 <= code <= 12 or code >= 32):
            raise FlacError("subframe type")
        order = int(code - 8 if code < 32 else code - 31)
        x = np.zeros((BLOCK, len(own)), np.int64)
        for t in range(order):
            x[t] = signed(take(pos, own, 8), 8)
            pos = pos + 8
        coef, shift = [np.int64(c) for c in _FIXED[order]] if code < 32 else [], 0
        if code >= 32:
            precision, shift = take(pos, own, 4) + 1, take(pos + 4, own, 5)
            pos = pos + 9
            for _ in range(order):
                v = take(pos, own, 16) >> (16 - precision)
                coef.append(v - ((v >> (precision - 1)) << precision))
                pos = pos + precision
        odd = take(pos, own, 6) != 0
        k = take(pos + 6, own, 4)
        pos, odd = pos + 10, odd | (k == 15)
        shift_k, one = k.astype(np.uint64), np.uint64(1)
        top = np.uint64(64) - shift_k
        last, row0 = (width - 9) * 8, base[own]
        for t in range(order, BLOCK):
            v = flat[row0 + (pos >> 3)] << (pos & 7).astype(np.uint64)
            # leading zeros from the exponent of the upper half
            high = (v >> np.uint64(32)).astype(np.float64)
            q = 1054 - (high.view(np.int64) >> 52)
            far = q > 24
            if far.any():
                odd |= far
                q = np.where(far, 0, q)
            low = (v << (q.astype(np.uint64) + one)) >> one >> (top - one)
            u = q << k | low.astype(np.int64)
            pos = np.minimum(pos + (q + 1 + k), last)
            r = (u >> 1) ^ -(u & 1)
            if coef:
                p = coef[0] * x[t - 1]
                for j in range(1, order):
                    p = p + coef[j] * x[t - 1 - j]
                r = r + (p >> shift)
            x[t] = r
        out[own] = x.T
        slow += list(own[odd])
    for f in slow:
        got, end = decode_frame(m[f].tobytes(), 0)
        if len(got) != BLOCK or end != sizes[f]:
            raise FlacError("frame size")
        out[f] = got
    if (out != out.astype(np.int8)).any():
        raise FlacError("sample out of range")
    return out.astype(np.int8)


def _layout(stream: bytes) -> tuple[int, int, bytes, np.ndarray | None]:
    """(where frames start, samples, MD5, offsets of all frames if the stream is of our form)."""
    if stream[:4] != b"fLaC":
        raise FlacError("not FLAC")
    at, last, info, seek = 4, False, b"", None
    while not last:
        last, kind, n = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        if kind == 0:
            info = body
        elif kind == 3:
            seek = np.frombuffer(body, _POINT)
        at += 4 + n
    total = int.from_bytes(info[10:18], "big") & ((1 << 36) - 1)
    offsets = None
    if seek is not None and len(seek) and total % BLOCK == 0 and info[:2] == info[2:4] == struct.pack(">H", BLOCK):
        frames = total // BLOCK
        each = int(seek["sample"][1]) // BLOCK if len(seek) > 1 else frames
        if each and len(seek) == -(-frames // each) and (seek["sample"] == np.arange(len(seek)) * (each * BLOCK)).all():
            offsets = _all_offsets(stream, at, seek["offset"].astype(np.int64), each, frames)
    return at, total, info[18:34], offsets


def _all_offsets(stream: bytes, at: int, points: np.ndarray, each: int, frames: int) -> np.ndarray:
    """The offsets of all frames from those of every ``each``-th: the others are sought by
    their headers, number and CRC included."""
    if each == 1:
        return points
    out = np.zeros(frames, np.int64)
    out[::each] = points
    for low in range(0, frames, _SLICE):
        numbers = np.arange(low, min(frames, low + _SLICE))
        head, size, crc = _heads(numbers)
        for k in np.flatnonzero(numbers % each):
            own = head[k, : 4 + size[k]].astype(np.uint8).tobytes() + bytes([int(crc[k])])
            found = stream.find(own, at + int(out[low + k - 1]) + 10)
            if found < 0:
                raise FlacError("frame not found")
            out[low + k] = found - at
    return out


def decode(streams: list[bytes]) -> list[bytes]:
    """The signed PCM bytes of each stream; frame checksums, header checksums and the
    whole's MD5 must hold."""
    if not streams:
        return []
    whole = np.frombuffer(b"".join(streams), np.uint8)
    out: list[bytes | None] = [None] * len(streams)
    starts, sizes, told, base = [], [], [], 0
    for i, s in enumerate(streams):
        at, total, md5, offsets = _layout(s)
        if offsets is None or not len(offsets):
            pcm = []
            while len(pcm) < total:
                got, at = decode_frame(s, at)
                pcm += got
            out[i] = np.array(pcm[:total], np.int8).tobytes()
            told.append((i, md5, 0))
        else:
            starts.append(base + at + offsets)
            sizes.append(np.diff(offsets, append=len(s) - at))
            told.append((i, md5, len(offsets)))
        base += len(s)
    if starts:
        starts, sizes = np.concatenate(starts), np.concatenate(sizes)
        if (sizes < 10).any() or (starts + sizes > len(whole)).any():
            raise FlacError("seek table")
        pcm = np.concatenate([decode_frames(whole, starts[a : a + _SLICE], sizes[a : a + _SLICE]) for a in range(0, len(starts), _SLICE)])
    first = 0
    for i, md5, n in told:
        if n:
            out[i] = pcm[first : first + n].tobytes()
            first += n
        if hashlib.md5(out[i], usedforsecurity=False).digest() != md5:
            raise FlacError("MD5")
    return out


# ---- operators ------------------------------------------------------------------


def _pieces(sizes: list[int]):
    """Row ranges of a batch of about _BATCH_BYTES each."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= _BATCH_BYTES:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def store(docs: DataFrame, id_col="doc_id", text="text") -> DataFrame:
    """(id, n_bytes, media): each text's bytes, padded, as a FLAC stream."""

    def run(batches):
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            for lo, hi in _pieces([len(r) for r in raw]):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([len(r) for r in raw[lo:hi]], pa.int64()), pa.array(encode([padded(r) for r in raw[lo:hi]]), pa.binary())],
                    ["id", "n_bytes", "media"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def features(pcm: bytes) -> str:
    """Signal features of signed 8-bit samples: range, mean, energy, zero crossings
    and the loudest block."""
    x = np.frombuffer(pcm, np.int8).astype(np.int64)
    energy = (x.reshape(-1, BLOCK) ** 2).sum(1) if len(x) % BLOCK == 0 and len(x) else np.array([(x**2).sum()])
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"min={x.min(initial=127)} max={x.max(initial=-128)} mean={x.sum() / max(1, len(x)):.4f} rms={(energy.sum() / max(1, len(x))) ** 0.5:.4f} zc={crossings} peak={int(energy.argmax())}"


def read_back(media: DataFrame) -> DataFrame:
    """store()'s rows with what their stored bytes decode to: digests and features."""

    def run(batches):
        for b in batches:
            streams = b.column(2).to_pylist()
            for lo, hi in _pieces([len(s) for s in streams]):
                rows = []
                for s, pcm in zip(streams[lo:hi], decode(streams[lo:hi]), strict=True):
                    payload = (np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(s), hashlib.sha256(s).hexdigest(), features(pcm)))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *map(pa.array, cols, kinds)],
                    ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "n_bytes", "media").mapInArrow(
        run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def pcm_blocks(media: DataFrame, frames_each=16) -> DataFrame:
    """store()'s rows as PCM blocks: (id, block, sample_offset, byte_offset, n_samples,
    pcm); byte_offset is where the block's first frame starts in the stream."""

    def run(batches):
        for b in batches:
            for i, s in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                at, total, _, offsets = _layout(s)
                pcm, rows = decode([s])[0], []
                for k, start in enumerate(range(0, total, frames_each * BLOCK)):
                    part = pcm[start : start + frames_each * BLOCK]
                    rows.append((k, start, None if offsets is None else at + int(offsets[start // BLOCK]), len(part), part))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.as_py()] * len(rows), i.type), *map(pa.array, cols, kinds)], ["id", "block", "sample_offset", "byte_offset", "n_samples", "pcm"]
                )

    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "media").mapInArrow(run, f"id {kind}, block long, sample_offset long, byte_offset long, n_samples long, pcm binary")


def digest(docs: DataFrame, id_col="doc_id", text="text") -> DataFrame:
    """Stores every text and reads it back: a row of digests for each."""
    return read_back(store(docs, id_col, text)).withColumnRenamed("id", id_col)
