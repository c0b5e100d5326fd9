"""Media columns: FLAC streams of text payloads.

A payload becomes one mono stream of signed 8-bit samples in frames of 192. Encoding picks per frame a constant, a
verbatim or a fixed linear predictor's subframe with Rice-coded residuals, and adds a seek table. Decoding finds frames
by sync code and header checksum, verifies both checksums of every frame, decodes Rice residuals and fixed or LPC
predictors of all frames in step (one vector operation per sample position), checks the stream's MD5, and writes PCM
blocks with their sample offsets. Frames of another make (stereo, other block sizes, Rice partitions, escapes, wasted
bits) are decoded one by one, by the format's rules.

Frames are handled in slices of ``SLICE``, so memory does not grow with a text. Defined cases: null text counts as
empty; the empty text's payload is one frame of spaces; equal texts give equal streams; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

BLOCK = 192
RATE = 8000
SLICE = 8192
SEEK_FRAMES = 64
CHUNK_BYTES = 2 << 20


def _crc_table(poly: int, bits: int) -> np.ndarray:
    t = np.zeros(256, dtype=np.uint32)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (bits - 1) & 1 else c << 1) & ((1 << bits) - 1)
        t[i] = c
    return t


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8_LIST, _CRC16_LIST = _CRC8.tolist(), _CRC16.tolist()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8_LIST[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC16_LIST[c >> 8 ^ b]
    return c


def _crcs(data: np.ndarray, start: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """Checksums of many byte ranges, in step. Ranges are ordered by length, so that finished ones fall off the end."""
    out, order = np.zeros(len(start), dtype=np.uint32), np.argsort(-n, kind="stable")
    at, left, c = start[order], n[order], np.zeros(len(start), dtype=np.uint32)
    live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for k, m in enumerate(live.tolist()):
        b = data[at[:m] + k]
        c[:m] = _CRC8[c[:m] ^ b] if bits == 8 else ((c[:m] << 8) & 0xFFFF) ^ _CRC16[(c[:m] >> 8) ^ b]
    out[order] = c
    return out


def coded_number(n: int) -> bytes:
    """A frame number in UTF-8's extended form."""
    if n < 128:
        return bytes([n])
    m = 2
    while n >> (5 * m + 1) and m < 7:
        m += 1
    return bytes([(0xFF00 >> m & 0xFF) | n >> 6 * (m - 1)] + [0x80 | n >> 6 * k & 63 for k in range(m - 2, -1, -1)])


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames of ``samples`` (rows of 192, signed 8-bit values), end to end, and their sizes in bytes."""
    f = len(samples)
    s = samples.astype(np.int32)
    best = np.full(f, 8 * BLOCK)  # verbatim
    order, rice, constant = np.full(f, -1), np.zeros(f, dtype=np.int64), (s == s[:, :1]).all(axis=1)
    zig, r = [], s
    for o in range(3):
        u = (r << 1) ^ (r >> 31)
        zig.append(u)
        guess = np.log2(np.maximum(u.mean(axis=1) * 0.7, 1)).astype(np.int64)
        for k in (guess, guess + 1):
            bits = 8 * o + 10 + (u >> k[:, None]).sum(axis=1) + (k + 1) * u.shape[1]
            better = bits < best
            best[better], order[better], rice[better] = bits[better], o, k[better]
        r = np.diff(r, axis=1)
    order[constant], best[constant] = -2, 8
    codes = [coded_number(int(n)) for n in numbers]
    head = np.array([len(c) + 5 for c in codes])
    size = head + 1 + -(-best // 8) + 2
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    body = first + head
    u8 = (s & 255).astype(np.uint8)
    rows = np.flatnonzero(order == -2)
    out[body[rows] + 1] = u8[rows, 0]
    rows = np.flatnonzero(order == -1)
    out[body[rows]] = 1 << 1
    out[body[rows, None] + 1 + np.arange(BLOCK)] = u8[rows]
    for o in range(3):
        rows = np.flatnonzero(order == o)
        if not len(rows):
            continue
        u, k = zig[o][rows].astype(np.int64), rice[rows]
        bit_size = -(-best[rows] // 8) * 8
        at = np.cumsum(bit_size) - bit_size
        bits = np.zeros(int(bit_size.sum()), dtype=np.uint8)
        for j in range(o):
            bits[(at + 8 * j)[:, None] + np.arange(8)] = np.unpackbits(u8[rows, j : j + 1], axis=1)
        for j in range(4):
            bits[at + 8 * o + 6 + j] = k >> (3 - j) & 1
        end = (at + 8 * o + 10)[:, None] + np.cumsum((u >> k[:, None]) + 1 + k[:, None], axis=1)
        for width in np.unique(k).tolist():
            of = k == width
            e, v = end[of], u[of] | (1 << width)
            v = (u[of] & ((1 << width) - 1)) | (1 << width)
            for j in range(width + 1):
                bits[e - 1 - j] = v >> j & 1
        packed = np.packbits(bits)
        n = bit_size // 8
        to = np.repeat(body[rows] + 1 - (np.cumsum(n) - n), n) + np.arange(len(packed))
        out[to] = packed
        out[body[rows]] = (8 + o) << 1
    out[first], out[first + 1], out[first + 2], out[first + 3] = 0xFF, 0xF8, 0x14, 0x02
    lens = head - 5
    flat = np.frombuffer(b"".join(codes), dtype=np.uint8)
    out[np.repeat(first + 4 - (np.cumsum(lens) - lens), lens) + np.arange(len(flat))] = flat
    out[body - 1] = _crcs(out, first, head - 1, 8)
    c = _crcs(out, first, size - 2, 16)
    out[first + size - 2], out[first + size - 1] = c >> 8, c & 255
    return out.tobytes(), size


def _header(payload: bytes, sizes: np.ndarray) -> bytes:
    starts = np.cumsum(sizes) - sizes
    info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big")
    info += hashlib.md5((np.frombuffer(payload, dtype=np.uint8) ^ 128).tobytes()).digest()
    seek = b"".join(struct.pack(">QQH", k * BLOCK, int(starts[k]), BLOCK) for k in range(0, len(sizes), SEEK_FRAMES)[: 0xFFFFFF // 18])
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek


def padded(data: bytes) -> bytes:
    """``data`` with spaces up to a positive multiple of 192 bytes."""
    return data + b" " * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of 192."""
    frames = [len(p) // BLOCK for p in payloads]
    numbers = np.concatenate([np.arange(n) for n in frames])
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, BLOCK)
    parts, sizes = [], []
    for at in range(0, len(data), SLICE):
        part, size = encode_frames(data[at : at + SLICE].astype(np.int16) - 128, numbers[at : at + SLICE])
        parts.append(part)
        sizes.append(size)
    body, size = b"".join(parts), np.concatenate(sizes)
    cut = np.concatenate([[0], np.cumsum(size)])
    out, k = [], 0
    for p, n in zip(payloads, frames, strict=True):
        out.append(_header(p, size[k : k + n]) + body[cut[k] : cut[k + n]])
        k += n
    return out


class Stream:
    """A stream's metadata: format, sample count, MD5, seek points (sample, byte offset) and where frames begin."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.seek, self.info = 4, False, [], None
        while not last:
            last, kind, n = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            block = data[at + 4 : at + 4 + n]
            if kind == 0:
                self.info = block
                wide = int.from_bytes(block[10:18], "big")
                self.rate, self.channels, self.bits, self.samples = wide >> 44, (wide >> 41 & 7) + 1, (wide >> 36 & 31) + 1, wide & (1 << 36) - 1
                self.md5 = block[18:34]
            elif kind == 3:
                points = (struct.unpack_from(">QQH", block, i) for i in range(0, n - 17, 18))
                self.seek = [(s, o) for s, o, _ in points if s != 2**64 - 1]
            at += 4 + n
        if self.info is None:
            raise ValueError("no STREAMINFO")
        self.frames = at


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.pos = data, 8 * at

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.pos >> 3, self.pos + n + 7 >> 3
        v = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.pos - n) & (1 << n) - 1
        self.pos += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        q = 0
        while not self.take(1):
            q += 1
            if self.pos >= 8 * len(self.data):
                raise ValueError("residual beyond the end")
        return q


def decode_frame(data: bytes, at: int, stream: Stream) -> tuple[list[list[int]], int, int]:
    """One frame by the format's rules: samples by channel, its number as coded, where the next begins."""
    b = _Bits(data, at)
    if b.take(15) != 0b111111111111100:
        raise ValueError("no sync code")
    b.take(1)
    size_code, rate_code, channels, bits_code = b.take(4), b.take(4), b.take(4), b.take(3)
    b.take(1)
    lead = b.take(8)
    more = 0 if lead < 128 else 8 - (lead ^ 255).bit_length() - 1
    number = lead if not more else lead & (1 << 6 - more) - 1
    for _ in range(more):
        number = number << 6 | b.take(8) & 63
    n = BLOCK if size_code == 1 else 576 << size_code - 2 if size_code < 6 else b.take(8) + 1 if size_code == 6 else b.take(16) + 1 if size_code == 7 else 256 << size_code - 8
    b.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    if crc8(data[at : b.pos >> 3]) != b.take(8):
        raise ValueError("header checksum")
    depth = {0: stream.bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[bits_code]
    out = []
    for c in range(2 if channels > 7 else channels + 1):
        out.append(_subframe(b, n, depth + (channels in (8, 10) and c == 1 or channels == 9 and c == 0)))
    if channels == 8:
        out[1] = [x - y for x, y in zip(*out, strict=True)]
    elif channels == 9:
        out[0] = [x + y for x, y in zip(*out, strict=True)]
    elif channels == 10:
        mid = [2 * x + (y & 1) for x, y in zip(*out, strict=True)]
        out = [[m + y >> 1 for m, y in zip(mid, out[1], strict=True)], [m - y >> 1 for m, y in zip(mid, out[1], strict=True)]]
    end = b.pos + 7 >> 3
    if crc16(data[at:end]) != int.from_bytes(data[end : end + 2], "big"):
        raise ValueError("frame checksum")
    return out, number, end + 2


def _subframe(b: _Bits, n: int, depth: int) -> list[int]:
    if b.take(1):
        raise ValueError("bad subframe")
    kind, wasted = b.take(6), b.take(1)
    if wasted:
        wasted += b.unary()
    depth -= wasted
    if kind == 0:
        s = [b.signed(depth)] * n
    elif kind == 1:
        s = [b.signed(depth) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        s = [b.signed(depth) for _ in range(order)]
        if kind < 32:
            coefs, shift = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])[order], 0
        else:
            precision, shift = b.take(4) + 1, b.signed(5)
            coefs = [b.signed(precision) for _ in range(order)]
        wide, parts = 4 + b.take(2), b.take(4)
        for p in range(1 << parts):
            k = b.take(wide)
            count = (n >> parts) - (order if p == 0 else 0)
            raw = b.take(5) if k == (1 << wide) - 1 else None
            for _ in range(count):
                if raw is None:
                    q = b.unary()
                    u = q << k | b.take(k)
                    r = u >> 1 ^ -(u & 1)
                else:
                    r = b.signed(raw)
                s.append(r + (sum(c * x for c, x in zip(coefs, reversed(s[-order:] if order else []), strict=False)) >> shift))
    else:
        raise ValueError("reserved subframe")
    return [x << wasted for x in s] if wasted else s


def _frames_at(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frame headers of this module's make with a good header checksum: start, length of the header, number."""
    at = np.flatnonzero(data[:-4] == 0xFF)
    at = at[(data[at + 1] == 0xF8) & (data[at + 2] == 0x14) & (data[at + 3] == 0x02)]
    pad = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    lead = pad[at + 4].astype(np.int64)
    more = np.select([lead < 128, lead >= 0xFC, lead >= 0xF8, lead >= 0xF0, lead >= 0xE0, lead >= 0xC0], [0, 5, 4, 3, 2, 1], -1)
    at, lead, more = at[more >= 0], lead[more >= 0], more[more >= 0]
    number = np.where(more > 0, lead & ((1 << (6 - more)) - 1), lead)
    for k in range(1, 6):
        number = np.where(more >= k, number << 6 | pad[at + 4 + k] & 63, number)
    head = 6 + more
    good = _crcs(pad, at, head - 1, 8) == pad[at + head - 1]
    return at[good], head[good], number[good]


def _in_step(data: np.ndarray, start: np.ndarray, head: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of many mono 8-bit frames of 192, and which of them another decoder has to read."""
    f = len(start)
    out, odd = np.zeros((f, BLOCK), dtype=np.int64), np.zeros(f, dtype=bool)
    signed = data.view(np.int8)
    if (_crcs(data, start, end - start, 16) != 0).any():
        raise ValueError("frame checksum")
    kind, body = data[start + head], start + head + 1
    rows = np.flatnonzero(kind == 0)
    out[rows] = signed[body[rows], None]
    rows = np.flatnonzero(kind == 2)
    out[rows] = signed[body[rows, None] + np.arange(BLOCK)]
    lpc = (kind >= 64) & (kind % 2 == 0)
    fixed = (kind >= 16) & (kind <= 24) & (kind % 2 == 0)
    odd[~(lpc | fixed | (kind == 0) | (kind == 2))] = True
    lo = int(start.min())
    part = np.concatenate([data[lo : int(end.max())], np.zeros(16, dtype=np.uint8)]).astype(np.uint64)
    words = np.zeros(len(part) - 7, dtype=np.uint64)
    for j in range(8):
        words |= part[j : j + len(words)] << np.uint64(56 - 8 * j)

    def window(pos: np.ndarray) -> np.ndarray:
        return words[pos >> 3] << (pos & 7).astype(np.uint64)

    def take(pos: np.ndarray, n: int) -> np.ndarray:
        return (window(pos) >> np.uint64(64 - n)).astype(np.int64)

    for k in np.unique(kind[lpc | fixed]).tolist():
        rows = np.flatnonzero(kind == k)
        order = k // 2 - 8 if k < 64 else k // 2 - 31
        s = out[rows]
        for j in range(order):
            s[:, j] = signed[body[rows] + j]
        pos = 8 * (body[rows] + order - lo)
        if k >= 64:
            precision, shift = take(pos, 4) + 1, take(pos + 4, 5)
            pos, coefs = pos + 9, np.zeros((len(rows), order), dtype=np.int64)
            for j in range(order):
                c = (window(pos) >> (64 - precision).astype(np.uint64)).astype(np.int64)
                coefs[:, j] = np.where(c >> (precision - 1) & 1, c - (1 << precision), c)
                pos = pos + precision
            odd[rows[(shift > 15) | (precision == 16)]] = True
        rice = take(pos + 6, 4)
        bad = (take(pos, 6) != 0) | (rice == 15)
        odd[rows[bad]] = True
        go = ~odd[rows]
        rows, s, pos, rice = rows[go], s[go], pos[go] + 10, rice[go]
        if not len(rows):
            continue
        stop, wide = 8 * (end[rows] - 2 - lo), rice.astype(np.uint64)
        for j in range(order, BLOCK):
            w = window(pos)
            q = np.zeros(len(rows), dtype=np.int64)
            far = np.flatnonzero(w >> np.uint64(16) == 0)
            while len(far):  # 48 zeros or more: go on behind them
                q[far] += 48
                pos[far] += 48
                if (pos[far] >= stop[far]).any():
                    raise ValueError("residual beyond the end")
                w[far] = window(pos[far])
                far = far[w[far] >> np.uint64(16) == 0]
            zeros = 64 - np.frexp((w >> np.uint64(11)).astype(np.float64))[1] - 11
            q += zeros
            pos += zeros + 1
            low = np.where(rice > 0, window(pos) >> (np.uint64(64) - np.maximum(wide, 1)), 0).astype(np.int64)
            pos += rice
            u = q << rice | low
            s[:, j] = u >> 1 ^ -(u & 1)
        if (pos > stop).any():
            raise ValueError("residual beyond the end")
        if k < 64:
            for o in range(order, 0, -1):  # undo one difference after the other; what precedes is the warm-up's
                lead = np.diff(s[:, :order], n=o - 1, axis=1)[:, -1:] if o > 1 else s[:, order - 1 : order]
                s[:, order:] = np.cumsum(s[:, order:], axis=1) + lead
        else:
            coefs, shift = coefs[go], shift[go]
            for j in range(order, BLOCK):
                s[:, j] += (coefs * s[:, j - order : j][:, ::-1]).sum(axis=1) >> shift
        out[rows] = s
    return out, odd


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads (unsigned 8-bit samples) of mono 8-bit streams; checksums and MD5 verified."""
    heads = [Stream(d) for d in streams]
    data = np.frombuffer(b"".join(streams) + bytes(8), dtype=np.uint8)
    size = np.array([len(d) for d in streams])
    base = np.cumsum(size) - size
    at, head, number = _frames_at(data)
    of = np.searchsorted(base, at, side="right") - 1
    inside = at >= (base + np.array([h.frames for h in heads]))[of]
    at, head, number, of = at[inside], head[inside], number[inside], of[inside]
    want = np.array([-(-h.samples // BLOCK) if h.samples % BLOCK == 0 and h.channels == 1 and h.bits == 8 else -1 for h in heads])
    count = np.bincount(of, minlength=len(heads))
    first = np.cumsum(count) - count
    regular = count == want
    wrong = number != np.arange(len(at)) - first[of]
    regular[of[wrong]] = False
    use = regular[of]
    end = np.minimum(np.append(at[1:], size.sum()), (base + size)[of]) if len(at) else at
    at, head, end, of = at[use], head[use], end[use], of[use]
    samples = np.zeros((len(at), BLOCK), dtype=np.uint8)
    for lo in range(0, len(at), SLICE):
        part = slice(lo, lo + SLICE)
        s, odd = _in_step(data, at[part], head[part], end[part])
        for k in np.flatnonzero(odd).tolist():
            d = int(of[lo + k])
            s[k] = decode_frame(streams[d], int(at[lo + k] - base[d]), heads[d])[0][0]
        samples[part] = s + 128
    flat, out, k = samples.tobytes(), [], 0
    for d, h in enumerate(heads):
        if regular[d]:
            pcm = flat[k * BLOCK : (k + want[d]) * BLOCK]
            k += want[d]
        else:
            pcm, p = bytearray(), h.frames
            while len(pcm) < h.samples:
                channels, _, p = decode_frame(streams[d], p, h)
                pcm += bytes((x + 128) & 255 for x in channels[0])
            pcm = bytes(pcm)
        if hashlib.md5((np.frombuffer(pcm, dtype=np.uint8) ^ 128).tobytes()).digest() != h.md5:
            raise ValueError("stream MD5")
        out.append(pcm)
    return out


def read_samples(data: bytes, offset: int, n: int) -> bytes:
    """``n`` samples of a mono 8-bit stream from ``offset``: seeks by the table and decodes only the frames needed."""
    h = Stream(data)
    sample, byte = max((p for p in h.seek if p[0] <= offset), default=(0, 0))
    out, p = bytearray(), h.frames + byte
    while sample + len(out) < offset + n:
        channels, _, p = decode_frame(data, p, h)
        out += bytes((x + 128) & 255 for x in channels[0])
    return bytes(out[offset - sample : offset - sample + n])


def tails(streams: list[bytes], n: int) -> list[bytes]:
    """The last ``n`` samples, up to a frame's, of each mono 8-bit stream by a seek: behind its last usable seek point the
    last frame is found by the headers, and only that is decoded. Streams of another make go to ``read_samples``."""
    heads = [Stream(d) for d in streams]
    seek = [max((p for p in h.seek if p[0] <= h.samples - n), default=(0, 0)) for h in heads]
    parts = [d[h.frames + byte :] for d, h, (_, byte) in zip(streams, heads, seek, strict=True)]
    data = np.frombuffer(b"".join(parts) + bytes(8), dtype=np.uint8)
    size = np.array([len(x) for x in parts])
    base = np.cumsum(size) - size
    at, head, number = _frames_at(data)
    of = np.searchsorted(base, at, side="right") - 1
    count = np.bincount(of, minlength=len(parts))
    first = np.cumsum(count) - count
    want = np.array([(h.samples - p) // BLOCK if h.samples % BLOCK == p % BLOCK == 0 and h.channels == 1 and h.bits == 8 else -1 for h, (p, _) in zip(heads, seek, strict=True)])
    regular = (count == want) & (want > 0) & (n <= BLOCK)
    begin = np.array([p // BLOCK for p, _ in seek])
    regular[of[number != begin[of] + np.arange(len(at)) - first[of]]] = False
    k = np.flatnonzero(regular)
    last, done = (first + count - 1)[k], {}
    for lo in range(0, len(k), SLICE):
        part = slice(lo, lo + SLICE)
        s, odd = _in_step(data, at[last[part]], head[last[part]], (base + size)[k[part]])
        done |= {int(d): (x + 128).astype(np.uint8).tobytes()[BLOCK - n :] for d, x, o in zip(k[part], s, odd, strict=True) if not o}
    return [done[i] if i in done else read_samples(d, max(0, h.samples - n), min(n, h.samples)) for i, (d, h) in enumerate(zip(streams, heads, strict=True))]


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        values = batch.column(column).cast(pa.binary()).to_pylist()
        at = 0
        while at < len(values):
            end, size = at, 0
            while end < len(values) and (end == at or size + len(values[end]) <= CHUNK_BYTES):
                size += len(values[end])
                end += 1
            yield batch.slice(at, end - at), values[at:end]
            at = end


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes (of the text) and media (its FLAC stream)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in _chunks(batches, "_text"):
            n = pa.array([len(v) for v in values], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(encode([padded(v) for v in values]), pa.binary())], names=[id_col, "n_bytes", "media"])

    return df.select(F.col(id_col).cast("long").alias(id_col), text_of(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", block_samples: int = 64 * BLOCK) -> DataFrame:
    """PCM blocks of a media table: ``id_col``, sample_offset, n_samples, pcm (unsigned 8-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in _chunks(batches, "media"):
            rows = []
            for i, pcm in zip(batch.column(0).to_pylist(), decode(values), strict=True):
                rows += [(i, at, len(pcm[at : at + block_samples]), pcm[at : at + block_samples]) for at in range(0, len(pcm), block_samples)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=[id_col, "sample_offset", "n_samples", "pcm"])

    return media.select(F.col(id_col), "media").mapInArrow(run, f"`{id_col}` long, sample_offset long, n_samples long, pcm binary")


def feature(pcm: bytes) -> str:
    """Peak, energy and zero crossings of the signed samples."""
    s = np.frombuffer(pcm, dtype=np.uint8).astype(np.int64) - 128
    return f"peak={int(np.abs(s).max())};energy={int((s * s).sum())};crossings={int(((s[1:] < 0) != (s[:-1] < 0)).sum())}"


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per media row, from the stored bytes read back: lengths, hashes, the last 16 samples' CRC (by a seek of its own) and features."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in _chunks(batches, "media"):
            rows = []
            for i, n, m, p, tail in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values, decode(values), tails(values, 16), strict=True):
                rows.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(tail), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(F.col(id_col), "n_bytes", "media").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    media = written(encode_column(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return digests(media)
