"""FLAC media columns: encode, verify and decode many streams at once, and cut them into seekable PCM blocks.

All frames of a batch are lanes of one NumPy computation: bit reading, Rice residuals, linear prediction and both
checksums advance one step for every lane at a time. Streams carry a seek table with a point per frame; the decoder starts
a lane at each point and follows frames from there, so a stream without a table is one lane and decodes as well.

The decoder reads constant, verbatim, fixed and LPC subframes, wasted bits, Rice partitions of both methods with escapes,
and all stereo modes. It checks each header's CRC-8, each frame's CRC-16, sample counts and the stream's MD5, and raises
ValueError on damage. The encoder writes mono streams (8 or 16 bits) with constant, fixed or order-4 LPC subframes.

Decoded streams are written as a table of PCM blocks, each with the sample offset at which it begins, and samples are read
back from the blocks that hold them. The FLAC streams of texts are about 1.6 times as large as the texts' own Parquet and are
not written; a row has the stream's length and digest.

Null or empty texts: a payload of 64 zero bytes (see pad64). Every row has a stream of its own, whether its id is null,
repeated or not. Empty tables give empty results. Columns other than id and text are not read, so none can clash. A text is
coded whole: its worker holds some 75 times its bytes, so texts of tens of MB need larger workers.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import column, flat, lean, pieces, save, ship, two_columns

BLOCK, RATE, LPC_ORDER, PRECISION = 1024, 8000, 4, 12
#: Payload bytes that are coded at a time in one worker.
BATCH_BYTES = 2 << 20


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, full, out = 1 << (bits - 1), (1 << bits) - 1, []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ (poly if c & top else 0)) & full
        out.append(c)
    return np.array(out, dtype=np.int64)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
LEADING = np.array([16] + [15 - (i.bit_length() - 1) for i in range(1, 1 << 16)], dtype=np.int64)
# Fixed values of the format: predictors, and block sizes, channels and sample sizes by their codes (0: given elsewhere).
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
BLOCK_SIZE = np.array([0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768])
SAMPLE_BITS = np.array([0, 8, 12, 0, 16, 20, 24, 32])


def crc_lanes(buf: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The checksum of each span."""
    order = np.argsort(-length, kind="stable")
    at, n, crc = start[order], length[order], np.zeros(len(start), np.int64)
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left")  # lanes with more than i bytes
    full = (1 << bits) - 1
    for i, m in enumerate(live.tolist()):
        crc[:m] = table[(crc[:m] >> (bits - 8)) ^ buf[at[:m] + i]] ^ ((crc[:m] << 8) & full)
    out = np.empty_like(crc)
    out[order] = crc
    return out


# ---------------------------------------------------------------- encoder


def _utf8_number(n: int) -> bytes:
    """The format's variable-length code of a frame or sample number."""
    if n < 0x80:
        return bytes([n])
    tail = []
    k = 1
    while n >= 1 << (6 - k):
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        k += 1
        if n < 1 << (7 - k):
            break
    return bytes([(0xFF00 >> k) & 0xFF | n, *tail[::-1]])


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised order-4 coefficients of each lane (time runs down, zeros past a frame's end) and their shifts; zeros where prediction fails."""
    f = x.astype(np.float64)
    r = [np.einsum("ij,ij->j", f[j:], f[: len(f) - j]) for j in range(LPC_ORDER + 1)]
    err, a = r[0] + 1e-9, np.zeros((LPC_ORDER, x.shape[1]))
    for i in range(LPC_ORDER):
        k = (r[i + 1] - sum((a[j] * r[i - j] for j in range(i)), np.zeros_like(err))) / err
        new = a.copy()
        new[i] = k
        for j in range(i):
            new[j] = a[j] - k * a[i - 1 - j]
        a, err = new, np.maximum(err * (1 - k * k), 1e-9)
    most = np.abs(a).max(axis=0)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(np.maximum(most, 1e-9))).astype(np.int64), 0, 14)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)), -limit, limit).astype(np.int64), shift


def encode(samples: list[np.ndarray], bits: int = 8) -> list[bytes]:
    """Each array of signed integers as a mono FLAC stream with a seek point per frame."""
    n = np.array([len(s) for s in samples], np.int64)
    per = (n + BLOCK - 1) // BLOCK
    owner = np.repeat(np.arange(len(n)), per)
    number = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(per)])[:-1], per)
    size = np.minimum(BLOCK, n[owner] - number * BLOCK)
    flat_x = np.concatenate([*samples, np.zeros(BLOCK, np.int64)]).astype(np.int64)
    begin = (np.concatenate([[0], np.cumsum(n)])[:-1])[owner] + number * BLOCK
    lanes = len(owner)
    t = np.arange(BLOCK)[:, None]
    valid = t < size
    x = flat_x[np.minimum(begin + t, len(flat_x) - 1)].astype(np.int32)
    x *= valid
    # candidates: fixed orders 0-1, then LPC
    best_cost, best_u = np.full(lanes, np.iinfo(np.int64).max), np.zeros((BLOCK, lanes), np.int32)
    kind, best_k = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    coef, shift = _lpc(x) if lanes else (np.zeros((LPC_ORDER, 0), np.int64), np.zeros(0, np.int64))
    small = np.int32 if bits <= 8 else np.int64  # holds a prediction's sum
    for c, order in ((0, 0), (1, 1), (3, LPC_ORDER)):
        if c == 0:
            res = x
        elif c == 1:
            res = np.diff(x, axis=0, prepend=np.zeros((1, lanes), np.int32))
        else:
            acc = np.zeros(x.shape, small)
            for j in range(LPC_ORDER):
                acc[j + 1 :] += coef[j].astype(small) * x[: BLOCK - j - 1]
            acc >>= shift.astype(small)
            res = (x - acc).astype(np.int32)
        u = (res << 1) ^ (res >> 31)
        u *= valid
        u[:order] = 0
        count = np.maximum(size - order, 1)
        k = np.clip(np.floor(np.log2(np.maximum(u.sum(axis=0) / count * 0.7, 1))).astype(np.int64), 0, 14)
        cost = (u >> k.astype(np.int32)).sum(axis=0) + count * (k + 1) + order * bits + (c == 3) * (9 + LPC_ORDER * PRECISION)
        cost[size <= order] = np.iinfo(np.int64).max - 1
        better = cost < best_cost
        best_cost[better], kind[better], best_k[better] = cost[better], c, k[better]
        np.copyto(best_u, u, where=better)
    order = np.array([0, 1, 0, LPC_ORDER])[kind]
    same = ((x == x[:1]) | ~valid).all(axis=0)
    coded = valid & (t >= order) & ~same
    # headers
    heads = []
    for f, m in zip(number.tolist(), size.tolist(), strict=True):
        h = bytes([0xFF, 0xF8, ((10 if m == BLOCK else 7) << 4) | 4, {8: 1, 16: 4}[bits] << 1]) + _utf8_number(f) + (b"" if m == BLOCK else (m - 1).to_bytes(2, "big"))
        heads.append(h)
    hlen = np.array([len(h) for h in heads], np.int64)
    hbuf = np.frombuffer(b"".join(heads), np.uint8)
    hat = np.concatenate([[0], np.cumsum(hlen)])[:-1]
    crc8 = crc_lanes(hbuf, hat, hlen, CRC8, 8)
    k32 = best_k.astype(np.int32)
    ends = best_u >> k32  # bits of each code, then their running sums: where codes end
    ends += 1 + k32
    ends *= coded
    for i in range(1, BLOCK):
        ends[i] += ends[i - 1]
    total_bits = ends[-1].astype(np.int64) if lanes else np.zeros(0, np.int64)
    side = np.where(same, bits, order * bits + 6 + 4 + (kind == 3) * (9 + LPC_ORDER * PRECISION))
    body = 8 + side + total_bits
    frame = hlen + 1 + (body + 7) // 8 + 2
    fat = np.concatenate([[0], np.cumsum(frame)])
    out = np.zeros(fat[-1], np.uint8)

    def put(pos: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):  # positions in one call are in distinct frames, so in distinct bytes
            out[(pos + b) >> 3] |= (((value >> (width - 1 - b)) & 1) << (7 - ((pos + b) & 7))).astype(np.uint8)

    pos = (fat[:-1] + hlen + 1) * 8
    put(pos, np.where(same, 0, np.where(kind == 3, 0x20 | (LPC_ORDER - 1), 8 | order)) << 1, 8)
    pos = pos + 8
    s = np.flatnonzero(same)
    put(pos[s], x[0, s], bits)
    for i in range(LPC_ORDER):
        w = np.flatnonzero(~same & (order > i))
        put(pos[w] + i * bits, x[i, w], bits)
    pos = pos + order * bits
    w = np.flatnonzero(~same & (kind == 3))
    put(pos[w], np.full(len(w), PRECISION - 1), 4)
    put(pos[w] + 4, shift[w], 5)
    for j in range(LPC_ORDER):
        put(pos[w] + 9 + j * PRECISION, coef[j, w], PRECISION)
    pos = pos + (kind == 3) * (9 + LPC_ORDER * PRECISION)
    w = np.flatnonzero(~same)
    put(pos[w], np.zeros(len(w), np.int64), 6)
    put(pos[w] + 6, best_k[w], 4)
    # each code's one and remainder, at most 15 bits, touch at most three bytes; codes share no bit, so sums are unions
    last = (ends + (pos + 9))[coded]
    code = ((best_u & ((1 << k32) - 1)) | (1 << k32))[coded] << (7 - (last & 7)).astype(np.int32)
    last >>= 3
    data = out.astype(np.float64)
    for b in range(3):
        data += np.bincount(np.maximum(last - b, 0), (code >> (8 * b)) & 255, minlength=len(out))
    data = data.astype(np.uint8)
    data[np.repeat(fat[:-1] - hat, hlen) + np.arange(len(hbuf))] = hbuf
    data[fat[:-1] + hlen] = crc8
    crc16 = crc_lanes(data, fat[:-1], frame - 2, CRC16, 16)
    data[fat[1:] - 2], data[fat[1:] - 1] = crc16 >> 8, crc16 & 0xFF
    raw, streams, lane = data.tobytes(), [], 0
    for s, total, frames in zip(samples, n.tolist(), per.tolist(), strict=True):
        md5 = hashlib.md5(s.astype("<i1" if bits == 8 else "<i2").tobytes()).digest()
        info = BLOCK.to_bytes(2, "big") * 2 + bytes(6) + ((RATE << 44) | ((bits - 1) << 36) | total).to_bytes(8, "big") + md5
        offs = fat[lane : lane + frames + 1].tolist()
        seek = b"".join((i * BLOCK).to_bytes(8, "big") + (o - offs[0]).to_bytes(8, "big") + min(BLOCK, total - i * BLOCK).to_bytes(2, "big") for i, o in enumerate(offs[:-1]))
        streams.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + raw[offs[0] : offs[-1]])
        lane += frames
    return streams


# ---------------------------------------------------------------- decoder


class Bits:
    """Reads big-endian bit fields at many positions."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.at = np.ndarray((len(data) + 8,), ">u8", padded.data, strides=(1,))
        self.last = len(data) + 7

    def window(self, pos: np.ndarray) -> np.ndarray:
        """64 bits from pos on, of which 57 at least are real."""
        return self.at[np.minimum(pos >> 3, self.last)].astype(np.uint64) << (pos & 7).astype(np.uint64)

    def read(self, pos: np.ndarray, n) -> np.ndarray:
        n = np.asarray(n)
        v = self.window(pos) >> (64 - np.maximum(n, 1)).astype(np.uint64)
        return np.where(n > 0, v, 0).astype(np.int64)

    def signed(self, pos: np.ndarray, n) -> np.ndarray:
        v, n = self.read(pos, n), np.asarray(n)
        return np.where((n > 0) & (v >> np.maximum(n - 1, 0) > 0), v - (np.int64(1) << n), v)

    def unary(self, pos: np.ndarray) -> np.ndarray:
        """Zeros before the next one."""
        q = LEADING[(self.window(pos) >> np.uint64(48)).astype(np.int64)]
        more = np.flatnonzero(q == 16)
        while len(more):
            if (pos[more] + q[more] > self.last * 8).any():
                raise ValueError("a residual runs past the stream's end")
            z = LEADING[(self.window(pos[more] + q[more]) >> np.uint64(48)).astype(np.int64)]
            q[more] += z
            more = more[z == 16]
        return q


def _residuals(b: Bits, pos: np.ndarray, size: np.ndarray, order: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Rice residuals of each lane into out[t, lane] for t from its order on; returns the positions after them."""
    method, parts = b.read(pos, 2), b.read(pos + 2, 4)
    if (method > 1).any() or (size & ((1 << parts) - 1)).any():
        raise ValueError("reserved residual coding")
    pos = pos + 6
    n = size - order
    rank = np.argsort(-n, kind="stable")
    pos, n, order_r, bits_k = pos[rank], n[rank], order[rank], 4 + method[rank]
    share = (size >> parts)[rank]
    if (share < order_r).any():
        raise ValueError("a partition is shorter than its predictor")
    left, k, raw = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.full(len(n), -1, np.int64)
    fresh = np.ones(len(n), bool)
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left")
    for t, m in enumerate(live.tolist()):
        for _ in range(2 if t == 0 else 1):
            need = np.flatnonzero(left[:m] == 0)
            if not len(need):
                break
            kk = b.read(pos[need], bits_k[need])
            pos[need] += bits_k[need]
            esc = kk == (1 << bits_k[need]) - 1
            width = b.read(pos[need], 5)
            pos[need] += np.where(esc, 5, 0)
            k[need], raw[need] = kk, np.where(esc, width, -1)
            left[need] = share[need] - np.where(fresh[need], order_r[need], 0)
            fresh[need] = False
        p, km = pos[:m], k[:m]
        v = b.window(p)
        q = LEADING[(v >> np.uint64(48)).astype(np.int64)]
        if (q == 16).any():
            q = b.unary(p)
        used = q + 1 + km
        r = ((v << (q + 1).astype(np.uint64)) >> np.uint64(1)) >> (63 - km).astype(np.uint64)
        r = r.astype(np.int64)
        if (far := np.flatnonzero(used > 56)).size:
            r[far] = b.read(p[far] + q[far] + 1, km[far])
        u = (q << km) | r
        res = (u >> 1) ^ -(u & 1)
        if (e := np.flatnonzero(raw[:m] >= 0)).size:
            res[e], used[e] = b.signed(p[e], raw[e]), raw[e]
        pos[:m] += used
        left[:m] -= 1
        out[order_r[:m] + t, rank[:m]] = res
    back = np.empty_like(pos)
    back[rank] = pos
    return back


def _subframes(b: Bits, pos: np.ndarray, size: np.ndarray, bps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One subframe per lane: (samples with time down, positions after)."""
    if b.read(pos, 1).any():
        raise ValueError("subframe padding bit")
    kind = b.read(pos + 1, 6)
    wasted = b.read(pos + 7, 1)
    pos = pos + 8
    w = np.flatnonzero(wasted)
    if len(w):
        wasted[w] = b.unary(pos[w]) + 1
        pos[w] += wasted[w]
    bps = bps - wasted
    order = np.where(kind >= 32, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    if (((kind > 1) & (kind < 8)) | ((kind > 12) & (kind < 32))).any():
        raise ValueError("reserved subframe type")
    most = int(size.max()) if len(size) else 0
    x = np.zeros((most, len(size)), np.int64)
    c = np.flatnonzero(kind == 0)
    x[:, c] = b.signed(pos[c], bps[c])
    pos[c] += bps[c]
    v = np.flatnonzero(kind == 1)
    if len(v):
        for t in range(int(size[v].max())):
            m = v[size[v] > t]
            x[t, m] = b.signed(pos[m] + t * bps[m], bps[m])
        pos[v] += size[v] * bps[v]
    p = np.flatnonzero(kind >= 8)
    if len(p):
        o, at, deg = order[p], pos[p], int(order[p].max())
        y = np.zeros((most, len(p)), np.int64)
        for t in range(deg):
            m = np.flatnonzero(o > t)
            y[t, m] = b.signed(at[m] + t * bps[p][m], bps[p][m])
        at = at + o * bps[p]
        coef, shift = np.zeros((deg, len(p)), np.int64), np.zeros(len(p), np.int64)
        for d, fixed in enumerate(FIXED[: deg + 1]):
            m = np.flatnonzero(kind[p] == 8 + d)
            for j, value in enumerate(fixed):
                coef[j, m] = value
        lpc = np.flatnonzero(kind[p] >= 32)
        if len(lpc):
            precision = b.read(at[lpc], 4) + 1
            shift[lpc] = b.signed(at[lpc] + 4, np.full(len(lpc), 5))
            if (precision == 16).any() or (shift < 0).any():
                raise ValueError("reserved predictor precision or shift")
            at[lpc] += 9
            for j in range(deg):
                m = o[lpc] > j
                coef[j, lpc[m]] = b.signed(at[lpc[m]] + j * precision[m], precision[m])
            at[lpc] += o[lpc] * precision
        pos[p] = _residuals(b, at, size[p], o, y)
        for t in range(1, most):
            acc = np.zeros(len(p), np.int64)
            for j in range(min(deg, t)):
                acc += coef[j] * y[t - 1 - j]
            acc >>= shift
            y[t] += acc if t >= deg else np.where(t >= o, acc, 0)
        x[:, p] = y
    return x << wasted, pos


def _frames(b: Bits, data: np.ndarray, start: np.ndarray, bits: np.ndarray, channels: np.ndarray) -> tuple[np.ndarray, ...]:
    """One frame at each start: (samples [channel, time, lane], sizes, coded numbers, variable?, ends)."""
    pos = start * 8
    if (b.read(pos, 15) != 0x7FFC).any():
        raise ValueError("no frame sync")
    variable, bs, sr, ch, ss = b.read(pos + 15, 1), b.read(pos + 16, 4), b.read(pos + 20, 4), b.read(pos + 24, 4), b.read(pos + 28, 3)
    first = b.read(pos + 32, 8)
    ones = LEADING[(~(first << 8) & 0xFF00) | 0xFF]  # leading ones of the first byte
    extra = np.maximum(ones - 1, 0)
    number = np.where(ones == 0, first, first & ((1 << np.maximum(6 - extra, 0)) - 1))
    at = start + 5
    for i in range(6):
        m = extra > i
        number[m] = (number[m] << 6) | (data[np.minimum(at[m] + i, len(data) - 1)] & 0x3F)
    at = at + extra
    size = BLOCK_SIZE[bs].copy()
    m = bs == 6
    size[m] = b.read(at[m] * 8, 8) + 1
    at = at + m
    m = bs == 7
    size[m] = b.read(at[m] * 8, 16) + 1
    at = at + 2 * m + (sr == 12) + 2 * ((sr == 13) | (sr == 14))
    if (size == 0).any() or (sr == 15).any() or (ch > 10).any():
        raise ValueError("reserved frame header field")
    if (crc_lanes(data, start, at - start, CRC8, 8) != data[np.minimum(at, len(data) - 1)]).any():
        raise ValueError("frame header CRC-8 differs")
    bps = np.where(ss == 0, bits, SAMPLE_BITS[ss])
    count = np.where(ch < 8, ch + 1, 2)
    if (count != channels).any():
        raise ValueError("channel count differs from the stream's")
    pos = (at + 1) * 8
    x = np.zeros((int(count.max()), int(size.max()), len(start)), np.int64)
    for c in range(int(count.max())):
        m = np.flatnonzero(count > c)
        side = ((ch[m] == 8) & (c == 1)) | ((ch[m] == 9) & (c == 0)) | ((ch[m] == 10) & (c == 1))
        y, pos[m] = _subframes(b, pos[m].copy(), size[m], bps[m] + side)
        x[c, : len(y), m] = y.T
    if len(x) > 1:
        l, r = x[0], x[1]
        m = ch == 8
        r[:, m] = l[:, m] - r[:, m]
        m = ch == 9
        l[:, m] += r[:, m]
        m = ch == 10
        mid, s = (l[:, m] << 1) | (r[:, m] & 1), r[:, m].copy()
        l[:, m], r[:, m] = (mid + s) >> 1, (mid - s) >> 1
    end = (pos + 7) // 8
    crc = crc_lanes(data, start, end - start, CRC16, 16)
    if (end + 2 > len(data)).any() or (b.read(end * 8, 16) != crc).any():
        raise ValueError("frame CRC-16 differs")
    return x, size, number, variable, end + 2


def read_metadata(stream: bytes) -> dict:
    """STREAMINFO, the seek table's points (sample, offset, samples) and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, out = 4, {"seek": []}
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            word = int.from_bytes(body[10:18], "big")
            out |= {"block": int.from_bytes(body[:2], "big"), "rate": word >> 44, "channels": ((word >> 41) & 7) + 1, "bits": ((word >> 36) & 31) + 1, "total": word & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind & 127 == 3:
            out["seek"] = [p for i in range(0, size, 18) if (p := (int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")))[0] != (1 << 64) - 1]
        at += 4 + size
        if kind & 128:
            return out | {"frames": at}


def decode(streams: list[bytes], verify_md5: bool = True) -> tuple[list[np.ndarray], list[list[tuple[int, int]]]]:
    """Each stream's samples ([n] for mono, else [n, channels]) and its frames as (first sample, samples)."""
    meta = [read_metadata(s) for s in streams]
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)
    data = np.frombuffer(b"".join(streams), np.uint8)
    b = Bits(data)
    owner, at, until, sample = [], [], [], []
    for i, m in enumerate(meta):
        points = m["seek"] if m["seek"] and m["seek"][0][:2] == (0, 0) else [(0, 0, 0), *m["seek"]]
        starts = [base[i] + m["frames"] + p[1] for p in points]
        owner += [i] * len(points)
        at += starts
        until += [*starts[1:], base[i + 1]]
        sample += [p[0] for p in points]
    owner, at, until, sample = (np.array(v, np.int64) for v in (owner, at, until, sample))
    bits, channels, block = (np.array([m[k] for m in meta], np.int64) for k in ("bits", "channels", "block"))
    out = [np.zeros((m["total"], m["channels"]), np.int64) for m in meta]
    blocks: list[list[tuple[int, int]]] = [[] for _ in meta]
    live = np.flatnonzero(at < until)
    while len(live):
        x, size, number, variable, end = _frames(b, data, at[live], bits[owner[live]], channels[owner[live]])
        if (np.where(variable == 1, number, number * block[owner[live]]) != sample[live]).any() or (end > until[live]).any():
            raise ValueError("a frame is not where the seek table or the previous frame puts it")
        for lane, (i, s, n) in enumerate(zip(owner[live].tolist(), sample[live].tolist(), size.tolist(), strict=True)):
            if s + n > len(out[i]):
                raise ValueError("more samples than the stream declares")
            out[i][s : s + n] = x[: out[i].shape[1], :n, lane].T
            blocks[i].append((s, n))
        sample[live] += size
        at[live] = end
        live = live[at[live] < until[live]]
    for i, m in enumerate(meta):
        blocks[i].sort()
        if sum(n for _, n in blocks[i]) != m["total"]:
            raise ValueError("samples are missing")
        if verify_md5 and m["md5"] != bytes(16):
            width = (m["bits"] + 7) // 8
            raw = out[i].astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
            if hashlib.md5(raw).digest() != m["md5"]:
                raise ValueError("MD5 of the samples differs")
    return [o[:, 0] if o.shape[1] == 1 else o for o in out], blocks


def read_samples(stream: bytes, start: int, count: int) -> np.ndarray:
    """Samples [start, start + count) of a mono stream; only the frames from the seek point before start are decoded."""
    m = read_metadata(stream)
    points = [p for p in m["seek"] if p[0] <= start] or [(0, 0, 0)]
    at, sample, got = m["frames"] + points[-1][1], points[-1][0], []
    stop = min(m["total"], start + count)
    data = np.frombuffer(stream, np.uint8)
    b, first = Bits(data), sample
    while sample < stop:
        x, size, _, _, end = _frames(b, data, np.array([at]), np.array([m["bits"]]), np.array([m["channels"]]))
        got.append(x[0, : size[0], 0])
        sample, at = sample + int(size[0]), int(end[0])
    return np.concatenate([*got, np.zeros(0, np.int64)])[start - first : stop - first]


# ---------------------------------------------------------------- Spark


def pad64(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Each text's bytes followed by zeros up to a positive multiple of 64."""
    out = []
    for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        p = np.zeros(max(64, -(-(y - x) // 64) * 64), np.uint8)
        p[: y - x] = buf[x:y]
        out.append(p)
    return out


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, limit=BATCH_BYTES):
        buf, off = flat(column(b, "text"))
        media = encode([p.astype(np.int64) - 128 for p in pad64(buf, off)])
        yield pa.record_batch({"id": column(b, "id"), "n_bytes": pa.array(np.diff(off), pa.int64()), "media": pa.array(media, pa.binary())})


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's padded UTF-8 bytes as 8-bit samples (byte - 128) of a FLAC stream."""
    ship(df.sparkSession)
    return two_columns(df, id_col, text_col).mapInArrow(lean(_encode), "id long, n_bytes long, media binary")


STORED = "id long, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<sample_offset: long, n_samples: int, pcm: binary>>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "media", BATCH_BYTES):
        media = column(b, "media").to_pylist()
        samples, blocks = decode(media)
        raw = [s.astype("<i1" if read_metadata(m)["bits"] <= 8 else "<i2") for m, s in zip(media, samples, strict=True)]
        rows = [(at, n, r[at : at + n].tobytes()) for r, where in zip(raw, blocks, strict=True) for at, n in where]
        cols = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary()))]
        ends = np.concatenate([[0], np.cumsum([len(where) for where in blocks])]).astype(np.int32)
        own = [pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media])]
        nested = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(cols, ["sample_offset", "n_samples", "pcm"]))
        yield pa.record_batch([column(b, "id"), column(b, "n_bytes"), *own, nested], names=["id", "n_bytes", "media_bytes", "media_sha256", "blocks"])


def write_pcm(media: DataFrame) -> DataFrame:
    """Decodes and verifies each stream of (id, n_bytes, media) and writes its PCM blocks (8 or 16 bits, little-endian) to the shared folder; returns the written table."""
    ship(media.sparkSession)
    return save(media.select("id", "n_bytes", "media").mapInArrow(lean(_blocks), STORED), "pcm", compression="zstd")


def pcm_blocks(stored: DataFrame) -> DataFrame:
    """(id, block, sample_offset, n_samples, pcm): one row per written block."""
    return stored.select("id", F.posexplode("blocks").alias("block", "b")).select("id", "block", "b.*")


def pcm_range(stored: DataFrame, start: int, count: int) -> DataFrame:
    """(id, pcm): samples [start, start + count) of each row, fewer where it ends, put together from the blocks that hold them alone."""
    held = F.filter("blocks", lambda b: (b["sample_offset"] < start + count) & (b["sample_offset"] + b["n_samples"] > start))
    first = F.get("held", F.lit(0))
    width = F.coalesce((F.length(first["pcm"]) / first["n_samples"]).cast("int"), F.lit(1))
    joined = F.aggregate("held", F.lit(b""), lambda acc, b: F.concat(acc, b["pcm"]))
    skip = F.coalesce((F.lit(start) - first["sample_offset"]).cast("int"), F.lit(0))
    return stored.select("id", held.alias("held")).select("id", F.substring(joined, skip * width + 1, width * count).alias("pcm"))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blocks, rows = column(b, "blocks"), []
        inner = blocks.flatten()
        at, n = (inner.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
        buf, off = flat(inner.field(2))
        ends = np.concatenate([[0], np.cumsum(blocks.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if (at[x:y] != np.cumsum(n[x:y]) - n[x:y]).any() or (np.diff(off[x : y + 1]) != n[x:y]).any():
                raise ValueError("a PCM block is not where its sample offset puts it")
            s = buf[off[x] : off[y]].view(np.int8).astype(np.int64)
            payload = (s + 128).astype(np.uint8).tobytes()
            text = f"blocks={y - x};peak={int(np.abs(s).max())};crossings={int(np.count_nonzero((s[1:] < 0) != (s[:-1] < 0)))};energy={int(np.dot(s, s))}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), text))
        size, sha, crc, feature = (pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string())))
        cols = [column(b, "id"), column(b, "n_bytes"), size, sha, crc, column(b, "media_bytes"), column(b, "media_sha256"), feature]
        yield pa.record_batch(cols, names=[f.split()[0] for f in FEATURES.split(", ")])


def media_features(stored: DataFrame) -> DataFrame:
    """Digests and features of texts, from the written 8-bit PCM blocks of their streams."""
    ship(stored.sparkSession)
    return stored.mapInArrow(lean(_features), FEATURES)
