"""Media columns in FLAC: Rice residuals and linear predictors, frame checksums, PCM blocks with seekable offsets.

Streams are mono. The encoder writes 8-bit samples in blocks of BLOCK, each with the best of three fixed predictors
and a fourth-order linear one, and a seek point for every frame. The decoder takes any mono stream of 4 to 16 bits of
constant, verbatim, fixed and linear subframes without wasted bits, with or without seek points.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

BLOCK = 1024
PARTS = 4
RATE = 8000
#: No frame of 65,536 mono samples of 16 bits is longer, but for codes that no encoder writes.
FRAME_BYTES = 1 << 18
SHIFT = 5
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _crc_table(poly: int, width: int) -> np.ndarray:
    """Remainder of each value of `width` bits, by the rule, most significant bit first."""
    x = np.arange(1 << width, dtype=np.uint32)
    for _ in range(width):
        x = np.where(x >> (width - 1) & 1, (x << 1) ^ poly, x << 1) & ((1 << width) - 1)
    return x


CRC8 = _crc_table(0x07, 8).tolist()
CRC16 = _crc_table(0x8005, 16).astype(np.uint16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def crc16(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each buf[start:end], two bytes a step in lockstep; zeros before a span don't count, so spans align at their ends."""
    out = np.zeros(len(starts), np.uint16)
    if not len(starts):
        return out
    size = int((ends - starts).max())
    size += size % 2
    order = np.argsort(starts - ends, kind="stable")
    s, e = starts[order], ends[order]
    length = e - s
    c = np.zeros(len(s), np.uint16)
    flat = np.concatenate([np.zeros(size + 2, np.uint8), buf]).astype(np.uint16)
    pair = (flat[:-1] << 8) | flat[1:]
    base = e + (size + 2)
    odd = length % 2 == 1
    head = np.where(odd, flat[s + size + 2], 0).astype(np.uint16)
    for back in range(size, 0, -2):
        # a span joins when at least back - 1 of its bytes are left; an odd one starts with a single byte
        a = int(np.searchsorted(-length, -(back - 1), side="right"))
        if not a:
            continue
        word = pair[base[:a] - back]
        starts_odd = odd[:a] & (length[:a] == back - 1)
        if starts_odd.any():
            word = np.where(starts_odd, head[:a], word)
        c[:a] = CRC16[c[:a] ^ word]
    out[order] = c
    return out


def _coded_number(n: int) -> bytes:
    """UTF-8 as extended to 36 bits."""
    if n < 0x80:
        return bytes([n])
    more = []
    lead = 0x3F
    while n > lead:
        more.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(0xFF00 >> (len(more) + 1)) & 0xFF | n, *more[::-1]])


@lru_cache(1 << 16)
def _header(number: int, n: int) -> bytes:
    head = b"\xff\xf8\x70\x02" + _coded_number(number) + struct.pack(">H", n - 1)
    return head + bytes([crc8(head)])


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def _linear(x: np.ndarray, order: int = 4) -> np.ndarray:
    """Quantised coefficients of each row by Levinson and Durbin's recursion on its autocorrelation."""
    v = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", v[:, k:], v[:, : v.shape[1] - k]) for k in range(order + 1)], axis=1).astype(float)
    r[:, 0] = r[:, 0] * 1.0001 + 1e-3
    a = np.zeros((len(x), order))
    err = r[:, 0].copy()
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        new = a.copy()
        new[:, i] = k
        new[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a = new
        err = np.maximum(err * (1 - k * k), 1e-6)
    return np.clip(np.rint(a * (1 << SHIFT)), -128, 127).astype(np.int32)


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def encode(payloads: list[bytes], limit: int = 1 << 19) -> list[bytes]:
    """A FLAC stream of each payload, byte b as sample b - 128. Payloads hold 16 bytes or more.

    About `limit` bytes are worked on at a time; a longer payload is cut between blocks, as frames don't depend on
    each other.
    """
    limit = max(BLOCK, limit // BLOCK * BLOCK)
    frames_of: list[list[tuple[bytes, np.ndarray]]] = [[] for _ in payloads]
    part: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        made = _encode([p for _, _, p in part], [at // BLOCK for _, at, _ in part])
        for (i, _, _), one in zip(part, made, strict=True):
            frames_of[i].append(one)

    for i, p in enumerate(payloads):
        for at in range(0, len(p), limit):
            part.append((i, at, p[at : at + limit]))
            size += len(part[-1][2])
            if size >= limit:
                flush()
                part, size = [], 0
    if part:
        flush()
    return [_stream(p, made) for p, made in zip(payloads, frames_of, strict=True)]


def _stream(p: bytes, made: list[tuple[bytes, np.ndarray]]) -> bytes:
    """Metadata with a seek point a frame, then the frames."""
    sizes = np.concatenate([x for _, x in made])
    digest = hashlib.md5(usedforsecurity=False)
    for at in range(0, len(p), 1 << 20):
        digest.update((np.frombuffer(p[at : at + (1 << 20)], np.uint8) ^ 0x80).tobytes())
    info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(p)).to_bytes(8, "big") + digest.digest()
    seek = np.zeros(len(sizes), np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
    seek["s"] = np.arange(len(sizes)) * BLOCK
    seek["o"], seek["n"] = np.cumsum(sizes) - sizes, np.minimum(BLOCK, len(p) - np.arange(len(sizes)) * BLOCK)
    table = seek.tobytes()
    return b"".join([b"fLaC\x00\x00\x00\x22", info, b"\x83", len(table).to_bytes(3, "big"), table, *[x for x, _ in made]])


def _encode(payloads: list[bytes], first_number: list[int]) -> list[tuple[bytes, np.ndarray]]:
    """Of each payload, whose first frame has the given number: its frames, joined, and their sizes."""
    counts = np.array([-(-len(p) // BLOCK) for p in payloads])
    first = np.cumsum(counts) - counts
    flat = np.frombuffer(b"".join(payloads) + bytes(BLOCK), np.uint8)
    begins = np.cumsum([0, *map(len, payloads)])
    number = np.arange(counts.sum()) - np.repeat(first, counts)
    start = np.repeat(begins[:-1], counts) + number * BLOCK
    number = number + np.repeat(np.array(first_number), counts)
    n = np.minimum(np.repeat(begins[1:], counts) - start, BLOCK)
    t = np.arange(BLOCK)
    live = t < n[:, None]
    x = np.where(live, flat[start[:, None] + t].astype(np.int32) - 128, 0)
    rows = len(x)

    # residuals of each predictor; the one with the least absolute sum is taken
    coef = _linear(x)
    tries = [x]
    for _ in range(2):
        tries.append(np.diff(tries[-1], axis=1, prepend=0))
    guess = np.zeros_like(x)
    for k in range(4):
        guess[:, k + 1 :] += coef[:, k, None] * x[:, : BLOCK - k - 1]
    tries.append(x - (guess >> SHIFT))
    orders = np.array([0, 1, 2, 4])
    cost = np.stack([(np.abs(r) * live)[:, o:].sum(1) for r, o in zip(tries, orders, strict=True)], axis=1)
    cost[:, 3] += 8
    pick = cost.argmin(1)
    order = orders[pick]
    res = np.choose(pick[:, None], tries)
    coded = live & (t >= order[:, None])
    u = np.where(coded, _zigzag(res), 0)

    # Rice parameters: four partitions in full blocks, one in short ones
    full = n == BLOCK
    blocks = coded.reshape(rows, PARTS, -1).sum(2)
    sums = np.stack([(u >> k).reshape(rows, PARTS, -1).sum(2) + blocks * (k + 1) for k in range(12)])
    rice = np.where(full[:, None], sums.argmin(0), sums.sum(2).argmin(0)[:, None])
    k_of = np.repeat(rice, BLOCK // PARTS, axis=1)
    q = u >> k_of
    length = np.where(coded, q + 1 + k_of, 0)
    mark = (t == order[:, None]) | (full[:, None] & (t % (BLOCK // PARTS) == 0) & (t > 0))
    length += 4 * mark

    heads = [_header(int(i), int(m)) for i, m in zip(number, n, strict=True)]
    head = np.array([len(h) for h in heads])
    lpc = pick == 3
    before = 8 * head + 8 + 8 * order + np.where(lpc, 9 + 8 * order, 0)
    ends = np.cumsum(length, axis=1)
    frame = (before + 6 + ends[:, -1] + 7) // 8 + 2
    at = np.cumsum(frame) - frame
    bits = np.zeros(8 * int(frame.sum()), np.uint8)
    base = 8 * at + 8 * head
    _put(bits, base, np.where(lpc, 0x20 | 3, 0x08 | order) << 1, 8)
    for j in range(4):
        w = np.flatnonzero(order > j)
        _put(bits, base[w] + 8 + 8 * j, x[w, j] & 0xFF, 8)
    w = np.flatnonzero(lpc)
    if len(w):
        p = base[w] + 8 + 32
        _put(bits, p, np.full(len(w), 7), 4)
        _put(bits, p + 4, np.full(len(w), SHIFT), 5)
        for j in range(4):
            _put(bits, p + 9 + 8 * j, coef[w, j] & 0xFF, 8)
    body = 8 * at + before
    _put(bits, body + 2, np.where(full, 2, 0), 4)
    body = body + 6
    pos = body[:, None] + ends - length
    r, c = np.nonzero(mark)
    _put(bits, pos[r, c], k_of[r, c], 4)
    pos = (pos + 4 * mark)[coded]
    q, k, v = q[coded], k_of[coded], u[coded]
    pos += q
    bits[pos] = 1
    for j in range(int(k.max(initial=0))):
        w = k > j
        bits[pos[w] + 1 + j] = (v[w] >> (k[w] - 1 - j)) & 1
    buf = np.packbits(bits)
    joined = bytearray(buf.tobytes())
    for s, h in zip(at.tolist(), heads, strict=True):
        joined[s : s + len(h)] = h
    buf = np.frombuffer(joined, np.uint8)
    check = crc16(buf, at, at + frame - 2)
    buf[at + frame - 2], buf[at + frame - 1] = check >> 8, check & 0xFF

    return [(bytes(joined[int(at[a]) : int(at[a + m - 1] + frame[a + m - 1])]), frame[a : a + m].astype(np.int64)) for a, m in zip(first.tolist(), counts.tolist(), strict=True)]


class Stream:
    """The metadata of one stream: bits, n (samples), md5, audio (offset of the first frame), seek points (sample, offset)."""

    def __init__(self, media: bytes):
        if media[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, []
        while not last:
            kind, size = media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
            last, body = bool(media[at] & 0x80), media[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.channels, self.bits, self.n = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
                self.md5 = body[18:34]
            elif kind == 3:
                seek = np.frombuffer(body, np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
                seek = seek[seek["s"] != np.iinfo(np.uint64).max]
                self.points = list(zip(seek["s"].tolist(), seek["o"].tolist(), seek["n"].tolist(), strict=True))
            at += 4 + size
        if self.channels != 1 or not 4 <= self.bits <= 16:
            raise ValueError("only mono streams of 4 to 16 bits are read")
        self.audio = at

    def complete(self) -> bool:
        at = 0
        for s, _, n in self.points:
            if s != at:
                return False
            at += n
        return at == self.n


def _frame(media: memoryview | bytes, at: int) -> tuple[int, int]:
    """Size of the frame's block, and where its subframe starts. Verifies the header's checksum."""
    if media[at] != 0xFF or media[at + 1] & 0xFC != 0xF8:
        raise ValueError("no frame here")
    code, rate = media[at + 2] >> 4, media[at + 2] & 15
    lead = media[at + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    p = at + 5 + more
    if code == 6:
        n, p = media[p] + 1, p + 1
    elif code == 7:
        n, p = (media[p] << 8 | media[p + 1]) + 1, p + 2
    else:
        n = 192 if code == 1 else 576 << (code - 2) if 2 <= code <= 5 else 256 << (code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(bytes(media[at:p])) != media[p]:
        raise ValueError("frame header checksum mismatch")
    return n, p + 1


def frames(data: bytes, starts: np.ndarray, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples and end offsets of the frames at starts, decoded in lockstep; verifies every checksum."""
    try:
        return _frames(data, starts, bits)
    except IndexError:
        raise ValueError("truncated or damaged frame") from None


def _frames(data: bytes, starts: np.ndarray, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    buf = np.frombuffer(bytes(data) + bytes(16), np.uint8)
    window = np.ndarray((len(buf) - 7,), ">u8", buf, strides=(1,))
    view = memoryview(data)
    heads = [_frame(view, int(s)) for s in starts]
    n = np.array([h[0] for h in heads], np.int64)
    pos = np.array([h[1] for h in heads], np.int64) * 8

    def take(p: np.ndarray, width: int) -> np.ndarray:
        w = window[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
        return (w >> np.uint64(64 - width)).astype(np.int64)

    def signed(v: np.ndarray, width: int) -> np.ndarray:
        return np.where(v >> (width - 1) & 1, v - (1 << width), v)

    kind = take(pos, 8)
    if (kind & 0x81).any():
        raise ValueError("wasted bits aren't read")
    kind >>= 1
    pos = pos + 8
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(starts)
    end = np.zeros(len(starts), np.int64)
    order = np.where(kind >= 32, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, -1))
    for i in np.flatnonzero(order < 0):
        if kind[i] > 1:
            raise ValueError("unknown subframe")
        m = 1 if kind[i] == 0 else int(n[i])
        v = signed(take(pos[i] + bits * np.arange(m), bits), bits)
        out[i] = np.repeat(v, n[i]) if kind[i] == 0 else v
        end[i] = pos[i] + bits * m
    some = np.flatnonzero(order >= 0)
    some = some[np.argsort(-(n[some] - order[some]), kind="stable")]
    if len(some):
        _predicted(out, end, some, n[some], order[some], kind[some], pos[some], bits, take, signed, window)
    close = (end + 7) // 8
    if (crc16(buf, np.asarray(starts), close) != (buf[close].astype(np.uint16) << 8 | buf[close + 1])).any():
        raise ValueError("frame checksum mismatch")
    return out, close + 2


def _predicted(out, end, some, n, order, kind, pos, bits, take, signed, window) -> None:
    """Fixed and linear subframes, in order of falling residual count: Rice codes first, then the predictors."""
    lanes, most = len(some), int(order.max())
    x = np.zeros((int(n.max()), lanes), np.int64)
    for j in range(most):
        w = np.flatnonzero(order > j)
        x[j, w] = signed(take(pos[w] + bits * j, bits), bits)
    pos = pos + bits * order
    coef, shift = np.zeros((max(1, most), lanes), np.int64), np.zeros(lanes, np.int64)
    for o in range(1, 5):
        w = np.flatnonzero((kind < 32) & (order == o))
        if len(w):
            coef[:o, w] = np.array(FIXED[o])[:, None]
    w = np.flatnonzero(kind >= 32)
    if len(w):
        for width in np.unique(got := take(pos[w], 4) + 1):
            v = w[got == width]
            shift[v] = signed(take(pos[v] + 4, 5), 5)
            for j in range(most):
                z = v[order[v] > j]
                coef[j, z] = signed(take(pos[z] + 9 + int(width) * j, int(width)), int(width))
            pos[v] += 9 + width * order[v]
        if (shift < 0).any():
            raise ValueError("negative shifts aren't read")
    method, parts = take(pos, 2), take(pos + 2, 4)
    if (method > 1).any():
        raise ValueError("unknown residual coding")
    pos = pos + 6
    width = 4 + method
    step = n >> parts
    turn = np.zeros(lanes, np.int64)
    rice = np.zeros(lanes, np.uint64)
    raw = np.zeros(lanes, bool)
    left = n - order
    active = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), side="left")
    one, half = np.uint64(1), np.uint64(32)
    res = np.zeros((int(left.max(initial=0)), lanes), np.int64)
    for r, a in enumerate(active.tolist()):
        at = np.flatnonzero(turn[:a] == r)
        if len(at):
            for wide in np.unique(width[at]):
                z = at[width[at] == wide]
                rice[z] = take(pos[z], int(wide))
                raw[z] = rice[z] == (1 << int(wide)) - 1
                pos[z] += wide
            if raw[at].any():
                raise ValueError("escaped partitions aren't read")
            turn[at] = np.where(turn[at] == 0, step[at] - order[at], turn[at] + step[at])
            turn[at] += (turn[at] == r) * step[at]
        p = pos[:a]
        w = window[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
        top = w >> half
        zero = np.zeros(a, np.int64)
        empty = np.flatnonzero(top == 0)
        while len(empty):
            zero[empty] += 32
            far = p[empty] + zero[empty]
            w[empty] = window[far >> 3].astype(np.uint64) << (far & 7).astype(np.uint64)
            top[empty] = w[empty] >> half
            empty = empty[top[empty] == 0]
        lead = np.int64(1054) - (top.astype(np.float64).view(np.int64) >> 52)
        k = rice[:a]
        low = (w << (lead + 1).astype(np.uint64)) >> one >> (np.uint64(63) - k)
        u = ((zero + lead) << k.astype(np.int64)) | low.astype(np.int64)
        res[r, :a] = (u >> 1) ^ -(u & 1)
        pos[:a] = p + zero + lead + 1 + k.astype(np.int64)
    end[some] = pos
    for o in np.unique(order):
        z = np.flatnonzero(order == o)
        if o == 0:
            for i in z:
                out[some[i]] = res[: n[i], i]
            continue
        y, c, s = x[:, z], coef[:o, z], shift[z]
        e = res[:, z]
        plain = not s.any()
        m = (n[z] - o).max()
        for t in range(int(m)):
            guess = c[0] * y[t + o - 1]
            for j in range(1, o):
                guess = guess + c[j] * y[t + o - 1 - j]
            y[t + o] = e[t] + (guess if plain else guess >> s)
        for i, k in enumerate(z):
            out[some[k]] = y[: n[k], i]


def decode(media: list[bytes], limit: int = 1 << 19) -> list[bytes]:
    """The payloads of 8-bit streams, all checksums verified, MD5 included; raises ValueError on any damage."""
    out: list[bytes] = []
    part: list[bytes] = []
    size = 0
    for m in media:
        part.append(m)
        size += len(m)
        if size > limit:
            out += _decode(part)
            part, size = [], 0
    return out + (_decode(part) if part else [])


def samples(media: bytes) -> np.ndarray:
    """All samples of one stream of any supported depth, frame after frame, without its seek points."""
    s = Stream(media)
    at, got, n = s.audio, [], 0
    while n < s.n:
        one, end = frames(media[at : at + FRAME_BYTES], np.array([0]), s.bits)
        got.append(one[0])
        n, at = n + len(one[0]), at + int(end[0])
    return np.concatenate(got) if got else np.zeros(0, np.int64)


def _decode(media: list[bytes], limit: int = 1 << 19) -> list[bytes]:
    streams = [Stream(m) for m in media]
    values: list[list[np.ndarray]] = [[] for _ in media]
    starts: list[int] = []
    own: list[int] = []
    parts: list[bytes] = []
    size = 0

    def flush() -> None:
        for i, v in zip(own, frames(b"".join(parts), np.array(starts, np.int64), 8)[0], strict=True):
            values[i].append(v.astype(np.int8))

    for i, (s, m) in enumerate(zip(streams, media, strict=True)):
        if s.bits != 8:
            raise ValueError("not 8-bit samples")
        if not s.complete():
            values[i] = [samples(m).astype(np.int8)]
            continue
        offsets = [s.audio + o for _, o, _ in s.points] + [len(m)]
        k = 0
        while k < len(s.points):  # frames of a long stream in several lots
            e = k + 1
            while e < len(s.points) and offsets[e + 1] - offsets[k] <= limit:
                e += 1
            starts += [size + o - offsets[k] for o in offsets[k:e]]
            own += [i] * (e - k)
            parts.append(m[offsets[k] : offsets[e]])
            size += len(parts[-1])
            k = e
            if size >= limit:
                flush()
                starts, own, parts, size = [], [], [], 0
    if starts:
        flush()
    out = []
    for s, got in zip(streams, values, strict=True):
        v = np.concatenate([*got, np.zeros(0, np.int8)])
        got.clear()
        if len(v) != s.n or s.md5.strip(b"\0") and hashlib.md5(v, usedforsecurity=False).digest() != s.md5:
            raise ValueError("stream checksum mismatch")
        out.append((v.view(np.uint8) ^ 0x80).tobytes())
    return out


def read_samples(media: bytes, first: int, count: int) -> np.ndarray:
    """Samples first to first + count - 1, decoding only the frames that hold them, found by the seek points."""
    s = Stream(media)
    if not s.complete():
        return samples(media)[first : first + count]
    points = [(a, o, n) for a, o, n in s.points if a < first + count and a + n > first]
    if not points:
        return np.zeros(0, np.int64)
    got, _ = frames(media, np.array([s.audio + o for _, o, _ in points]), s.bits)
    return np.concatenate(got)[first - points[0][0] :][:count]


def payload(text: str | None) -> bytes:
    """A text as UTF-8 with zero bytes up to a positive multiple of 64."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return b + bytes(-len(b) % 64 if b else 64)


def feature(v: bytes) -> str:
    """Peak, energy, zero crossings and mean of a payload's samples, in whole numbers."""
    peak = energy = cross = total = 0
    for at in range(0, len(v), 1 << 20):
        x = np.frombuffer(v[max(0, at - 1) : at + (1 << 20)], np.uint8).astype(np.int64) - 128
        cross += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        x = x[min(at, 1) :]
        peak, energy, total = max(peak, int(np.abs(x).max())), energy + int(x @ x), total + int(x.sum())
    return f"peak={peak};energy={energy};crossings={cross};sum={total}"


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `media`, the FLAC stream of each whole text (null: empty) padded with zero bytes to 64, and n_bytes."""

    docs = docs.drop("n_bytes", "media")
    at = docs.columns.index(text)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 128):
            texts = part.column(at).to_pylist()
            size = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield _with(part, n_bytes=pa.array(size, pa.int64()), media=pa.array(encode([payload(t) for t in texts]), pa.binary()))

    return docs.mapInArrow(made, T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def _with(part: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, *more.values()], names=[*part.schema.names, *more])


def load(stored: DataFrame, media: str = "media") -> DataFrame:
    """stored with `payload`, read back from the stream, and `feature`. A null stream gives nulls; damage raises."""

    stored = stored.drop("payload", "feature")
    at = stored.columns.index(media)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 128):
            own = part.column(at).to_pylist()
            got = iter(decode([m for m in own if m is not None]))
            rows = [None if m is None else next(got) for m in own]
            yield _with(part, payload=pa.array(rows, pa.binary()), feature=pa.array([None if r is None else feature(r) for r in rows], pa.string()))

    return stored.mapInArrow(read, T.StructType([*stored.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())]))


def pcm_blocks(stored: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each frame: key, block, sample_offset, n_samples, pcm (signed bytes). Null streams give no rows."""

    def cutup(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for k, m in zip(pdf["k"], pdf["m"], strict=True):
                m = bytes(m)
                s = Stream(m)
                points = s.points if s.complete() else [(0, 0, s.n)]
                vals = frames(m, np.array([s.audio + o for _, o, _ in points]), s.bits)[0] if s.complete() else [samples(m)]
                yield pd.DataFrame({key: [k] * len(vals), "block": range(len(vals)), "sample_offset": [a for a, _, _ in points], "n_samples": [len(v) for v in vals], "pcm": [v.astype(np.int8).tobytes() for v in vals]})

    kind = dict(stored.dtypes)[key]
    return stored.where(F.col(media).isNotNull()).select(F.col(key).alias("k"), F.col(media).alias("m")).mapInPandas(cutup, f"{key} {kind}, block int, sample_offset long, n_samples long, pcm binary")


def digests(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): what was stored and what was read back from the stored form.

    Null and empty texts are 64 zero bytes; equal texts give equal values; repeated rows and null ids stay as they
    are; other columns are ignored; an empty table gives no rows.
    """
    got = load(store(docs.select("doc_id", "text")).drop("text"))
    return got.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
