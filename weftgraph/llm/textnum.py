"""Numpy over many texts at once: byte buffers, word hashes, subword buckets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

#: Odd, so it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
U64 = np.uint64


def chunks(texts: Iterable[str | None], limit: int = 1 << 21) -> Iterator[list[str]]:
    """Lists of whole texts (null: empty) of about `limit` characters each; a longer text stands alone."""
    part: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield part


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(20, int(n).bit_length())
        out = np.ones(1, U64)
        with np.errstate(over="ignore"):
            while len(out) < size:
                out = np.concatenate([out, out * U64(pow(base, len(out), 1 << 64))])
        _powers[base] = have = out
    return have[:n]


@cache
def inverse(base: int = BASE) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
        x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def prefix(buf: np.ndarray, base: int = BASE) -> np.ndarray:
    """Prefix sums of byte times power; substring hashes are differences of them, see spans()."""
    out = np.zeros(len(buf) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((buf.astype(U64) + U64(1)) * powers(len(buf), base), out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hashes of buf[start:end], equal for equal bytes wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * powers(len(sums) + 1, inverse(base))[starts])


#: Letters and digits of ASCII and every byte of a longer UTF-8 sequence.
WORD = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: prefix sums, starts and ends of words, and for each text its first word and the word after its last."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    own = WORD[buf]
    edge = np.flatnonzero(np.diff(own, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    cut = np.searchsorted(starts, bounds)
    return prefix(buf), starts, ends, cut[:-1], cut[1:]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: hash of each word, and for each text its first word and the word after its last."""
    total, starts, ends, first, after = places(texts)
    return spans(total, starts, ends), first, after


def grams(texts: list[str], sizes: tuple[int, ...], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the byte n-grams at every place of lower-cased texts, letters kept and the rest made spaces.

    Returns an array for each size, and bounds: text i has the places bounds[2 i] to bounds[2 i + 1]. What it has
    depends on the text alone, not on its neighbours.
    """
    pad = b" " * max(sizes)
    parts = [b" " + t.lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(pad.join(parts) + pad, np.uint8)
    buf = np.where(LETTER[buf], buf, np.uint8(32)).astype(np.uint64)
    lengths = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + len(pad))])
    bounds = np.stack([starts, starts + lengths], axis=1).ravel()
    n = len(buf) - max(sizes)
    got = []
    for size in sizes:
        key = buf[:n].copy()
        for k in range(1, size):
            key |= buf[k : n + k] << U64(8 * k)
        with np.errstate(over="ignore"):
            got.append((((key + U64(size)) * U64(BASE)) >> U64(64 - bits)).astype(np.int64))
    return got, bounds


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over [bounds[2 i], bounds[2 i + 1]) for each i; zero for an empty span."""
    total = np.concatenate([values, np.zeros_like(values[:1])])
    out = np.add.reduceat(total, bounds, axis=0)[::2]
    out[bounds[::2] == bounds[1::2]] = 0
    return out
