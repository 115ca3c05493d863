"""Benchmark decontamination: latent semantic retrieval, then subsequence and answer checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import cut, give_back, slices

WINDOW = 32
STRIDE = 16
BITS = 14
#: Items of fewer words can't be told from chance by a share of them: all have to stand next to each other, and one word has to be the whole text.
LEAST = 5
#: Letters of scripts without spaces, each a word, and marks that part words.
LETTERS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17d3\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
MARKS = re.compile("[\u17d4-\u17da\u3000-\u3004\u3008-\u3020\u3030\u303d\u30fb\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
EITHER = re.compile(f"[{LETTERS.pattern[1:-1]}{MARKS.pattern[1:-1]}]")
#: Blocks in which partial products are added up, and how many partitions' sums are added first.
SPLIT = 128
SUMS = 8
#: Words whose passages are multiplied at once, and rows of them that stay in a core's cache.
TOGETHER = 80_000
ROWS = 256
#: Items whose vectors are in memory at once; more items take more passes.
BLOCK = 2_000


@dataclass
class Item:
    """words in order; mask: of each word the places it has, as bits; answer: bits of the places of the answer's words."""

    item_id: int
    words: np.ndarray
    mask: dict[int, int] = field(default_factory=dict)
    answer: int = 0


@dataclass
class Index:
    """embed: latent vector of each hashed word, weighted; queries: unit vectors of item windows; owner: item of each."""

    embed: np.ndarray
    queries: np.ndarray
    owner: np.ndarray
    items: list[Item]
    cosine: float
    lcs: float
    answer: float
    df: np.ndarray

    def __post_init__(self):
        """member: which hashed words an item has; hashed: those of an item, in order; shared: least words that a window has to share with it.

        need: words that a match has at least; keys, listed: an item's rarest words, one more than a match may miss,
        sorted, and the item of each; keyed: which hashed words a key has. Every match has a key.
        """
        self.member = np.zeros((len(self.items), 1 << BITS), bool)
        for k, it in enumerate(self.items):
            self.member[k, _ids(it.words)] = True
        self.hashed = [_ids(it.words) for it in self.items]
        sizes = np.array([len(it.words) for it in self.items], int)
        self.shared = np.floor(0.7 * self.lcs * np.minimum(sizes, WINDOW - STRIDE // 2)).astype(int)
        self.need = np.where(sizes < LEAST, sizes, np.ceil(self.lcs * sizes - 1e-9).astype(int))
        keys = [np.unique(it.words[np.argsort(self.df[_ids(it.words)], kind="stable")[: len(it.words) - m + 1]]) for it, m in zip(self.items, self.need, strict=True)]
        both = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        listed = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(both, kind="stable")
        self.keys, self.listed = both[order], listed[order]
        self.keyed = np.zeros(1 << BITS, bool)
        self.keyed[_ids(both)] = True
        self.reach = sizes + np.maximum(4, sizes // 4)


def _ids(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """textnum.words of the texts, where letters of scripts without spaces are words each."""
    return textnum.words([t if t.isascii() or not EITHER.search(t) else LETTERS.sub(r" \g<0> ", MARKS.sub(" ", t)) for t in texts])


def tokens(texts: DataFrame) -> DataFrame:
    """Rows with the hashed words of each of texts(t) as ids, 16 bits each, in order; none for a null or empty text.

    Besides, without ids, for each partition in how many of its texts (n) a hashed word (w) stands; w of -1 counts all.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in slices(batches, 512):
            for part in textnum.chunks(batch.column(0).to_pylist(), 1 << 18):
                h, a, b = _words(part)
                ids = _ids(h)
                seen = (np.repeat(np.arange(len(part)), b - a) << BITS | ids).astype(np.uint32)
                seen.sort()
                df += np.bincount(seen[np.flatnonzero(np.diff(seen, prepend=~seen[:1]))] & ((1 << BITS) - 1), minlength=1 << BITS)
                n += len(part)
                ends = pa.py_buffer((2 * np.append(a, b[-1])).astype(np.int32))
                column = pa.Array.from_buffers(pa.binary(), len(part), [None, ends, pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([column, *[pa.nulls(len(part), pa.int64())] * 2], names=["ids", "w", "n"])
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(hit) + 1, pa.binary()), pa.array(np.append(hit, -1)), pa.array(np.append(df[hit], n))], names=["ids", "w", "n"])

    return texts.select("t").mapInArrow(read, "ids binary, w long, n long")


def document_frequencies(read: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed word stands, and the number of texts, from tokens()."""
    df, n = np.zeros(1 << BITS), 0
    for w, k in read.where("w is not null").groupBy("w").agg(F.sum("n")).collect():
        if w < 0:
            n = int(k)
        else:
            df[w] = k
    return df, n


def _read(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashed words of some texts of a column of ids, and each one's first word and the word after its last."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    ids = np.frombuffer(column.buffers()[2] or b"", "<u2")
    k = 0
    while k < len(column):
        m = max(k + 1, int(np.searchsorted(ends, ends[k] + TOGETHER, "right")) - 1)
        yield ids[ends[k] : ends[m]], ends[k:m] - ends[k], ends[k + 1 : m + 1] - ends[k]
        k = m


def _windows(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the word windows of texts with words first[i] to end[i], and each window's text."""
    n = end - first
    per = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    own = np.repeat(np.arange(len(n)), per)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = first[own] + k * STRIDE
    return start, np.minimum(start + WINDOW, end[own]), own


def _tfidf(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows, columns and values of the passages' unit TF-IDF vectors, and the number of passages."""
    h, a, b = _words(texts)
    start, end, _ = _windows(a, b)
    row = np.repeat(np.arange(len(start)), end - start)
    place = np.arange(len(row)) - np.repeat(np.cumsum(end - start) - (end - start), end - start) + start[row]
    cell, n = np.unique((row << BITS) | _ids(h)[place], return_counts=True)
    row, col = cell >> BITS, cell & ((1 << BITS) - 1)
    val = n * idf[col]
    norm = np.sqrt(np.bincount(row, val * val, minlength=len(start)))
    return row, col, (val / norm[row]).astype(np.float32), len(start)


def _blocks(ids: np.ndarray, first: np.ndarray, end: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of texts in rows of STRIDE, filled up with pad, and each text's number of rows."""
    n = end - first
    blocks = -(-n // STRIDE)
    base = np.cumsum(blocks) - blocks
    out = np.full(int(blocks.sum()) * STRIDE, pad, np.int64)
    own = np.repeat(np.arange(len(n)), n)
    out[base[own] * STRIDE + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)] = ids
    return out.reshape(-1, STRIDE), blocks


def _sums(table: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sums of the rows of table that each row of words names."""
    total = np.empty((len(words), table.shape[1]), table.dtype)
    some = np.empty((ROWS, table.shape[1]), table.dtype)
    columns = np.ascontiguousarray(words.T)
    for k in range(0, len(words), ROWS):  # a few rows at a time: sums stay in the cache
        sums = np.take(table, columns[0, k : k + ROWS], axis=0, out=total[k : k + ROWS], mode="clip")
        for column in columns[1:]:
            sums += np.take(table, column[k : k + ROWS], axis=0, out=some[: len(sums)], mode="clip")
    return total


def _norms(words: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Lengths of the TF-IDF vectors of passages, rows of words; idf is 0 for what fills them up."""
    words = np.sort(words.astype(np.int32), axis=1)
    new = np.ones(words.shape, bool)
    new[:, 1:] = words[:, 1:] != words[:, :-1]
    at = np.flatnonzero(new)
    val = np.diff(at, append=words.size) * idf[words.ravel()[at]]
    return np.sqrt(np.bincount(at // words.shape[1], val * val, minlength=len(words)))


def _products(ids: np.ndarray, a: np.ndarray, b: np.ndarray, idf: np.ndarray, table: np.ndarray, back: np.ndarray, gram: np.ndarray) -> None:
    """Adds to back, still without its factor idf, and gram what the passages of texts with hashed words a[i] to b[i] give.

    idf and table, omega's rows times idf, have a last row of zeros.
    A passage is two blocks of STRIDE words, so sums over blocks serve two passages each, in both directions.
    """
    if not len(ids):
        return
    words, blocks = _blocks(ids, a, b, len(back))
    per = np.where(blocks > 0, np.maximum(1, blocks - 1), 0)
    base = np.cumsum(blocks) - blocks
    own = np.repeat(np.arange(len(per)), per)
    block = base[own] + np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per)
    more = np.flatnonzero(blocks[own] > 1)
    second = np.full((len(block), STRIDE), len(back), np.int64)
    second[more] = words[block[more] + 1]
    norm = _norms(np.concatenate([words[block], second], axis=1), idf)[:, None].astype(np.float32)
    total = _sums(table, words)
    y = total[block]
    y[more] += total[block[more] + 1]
    y /= norm
    gram += y.T @ y
    y /= norm
    total[:] = 0
    total[block] = y
    total[block[more] + 1] += y[more]
    flat = words.ravel()
    place = np.argsort(flat.astype(np.uint16), kind="stable") // STRIDE  # a radix sort; what fills up comes last
    times = np.bincount(flat, minlength=len(back) + 1)[:-1]
    first = np.cumsum(times) - times
    some = np.empty((ROWS, table.shape[1]), np.float32)
    order = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]
    often = int(np.count_nonzero(times > 4 * STRIDE))
    for w in order[:often].tolist():
        at = place[first[w] : first[w] + times[w]]
        back[w] += total[at].sum(0) if 4 * len(at) < len(total) else np.bincount(at, minlength=len(total)).astype(np.float32) @ total
    for k in range(often, len(order), ROWS):  # words that stand there about as often
        w = order[k : k + ROWS]
        sums = total[place[first[w]]]
        for j, m in enumerate(np.searchsorted(-times[w], -np.arange(1, times[w[0]])).tolist(), 1):
            sums[:m] += np.take(total, place[first[w[:m]] + j], axis=0, out=some[:m], mode="clip")
        back[w] += sums


def _apply(passages: DataFrame, idf: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A^T (A omega) and (A omega)^T (A omega) of the matrix A of the passages of texts(t), or tokens' rows of them, summed over partitions."""
    if "ids" not in passages.columns:
        passages = tokens(passages)
    passages = passages.where("ids is not null").select("ids")
    shared = passages.sparkSession.sparkContext.broadcast((idf, omega.astype(np.float32)))
    rank = omega.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, om = shared.value
        idf = np.append(idf, 0.0)
        table = np.concatenate([om * idf[:-1, None].astype(np.float32), np.zeros((1, rank), np.float32)])
        back, gram = np.zeros(om.shape, np.float32), np.zeros((rank, rank))
        seen = False
        for batch in slices(batches, 4096):
            seen = seen or bool(batch.num_rows)
            for ids, a, b in _read(batch.column(0)):
                _products(ids, a, b, idf, table, back, gram)
        if seen:
            back *= idf[:-1, None].astype(np.float32)
            blocks = [gram.astype(np.float32), *np.split(back, SPLIT)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, SPLIT), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["block", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["data"].iloc[0]) // 4)
        for x in pdf["data"]:
            total += np.frombuffer(x, np.float32)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "data": [total.astype(np.float32).tobytes()]})

    # sums meet block by block on the executors, some partitions' first; the driver gets each block once
    summed = passages.mapInArrow(part, "block int, data binary").withColumn("some", F.floor(F.spark_partition_id() / SUMS))
    summed = summed.groupBy("block", "some").applyInPandas(add, "block int, data binary").groupBy("block").applyInPandas(add, "block int, data binary")
    back, gram = np.zeros(omega.shape, np.float32), np.zeros((rank, rank))
    for r in summed.collect():
        block = np.frombuffer(r["data"], np.float32).reshape(-1, rank)
        if r["block"] < 0:
            gram = block.astype(np.float64)
        else:
            size = len(block)
            back[r["block"] * size : (r["block"] + 1) * size] = block
    shared.destroy()
    return back, gram


def latent(passages: DataFrame, idf: np.ndarray, rank: int = 64, over: int = 8, power: int = 1, seed: int = 3) -> np.ndarray:
    """Word vectors from a distributed randomised SVD of the passages' TF-IDF matrix: V of the leading right subspace.

    The first direction, which all passages share, is left out; the others are divided by their singular values.
    """
    q = np.random.default_rng(seed).standard_normal((1 << BITS, rank + over), np.float32)
    q /= np.linalg.norm(q, axis=0)
    for _ in range(power):
        back, _ = _apply(passages, idf, q)
        q = np.linalg.qr(back)[0]
    # Nystroem: back is A^T A q and gram q^T A^T A q, so the last pass serves for the subspace and for its directions
    back, gram = _apply(passages, idf, q)
    values, turn = np.linalg.eigh(gram)
    known = values > max(values[-1], 1e-30) * 1e-6
    left, sigma, _ = np.linalg.svd((back @ turn[:, known]) / np.sqrt(values[known]), full_matrices=False)
    got = left[:, : rank + 1] / np.maximum(sigma[: rank + 1], max(sigma[0], 1e-12) * 1e-4)
    return got[:, 1:] if got.shape[1] > 1 else got


def _answer(text: str, n: int) -> int:
    """Bits of the answer's places among n words: the last sentence, or the last quarter if that has under 3 words."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|(?<=[。！？])", text) if p.strip()]
    tail = len(_words([parts[-1]])[0]) if parts else 0
    k = tail if 3 <= tail < n else max(1, n // 4)
    return ((1 << k) - 1) << (n - k)


def _items(rows: list, embed: np.ndarray) -> tuple[list[Item], np.ndarray, np.ndarray]:
    items: list[Item] = []
    texts = []
    for r in sorted((r for r in rows if r["text"] is not None), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"])):
        h = _words([r["text"]])[0]
        if len(h):
            it = Item(r["item_id"], h, answer=_answer(r["text"], len(h)))
            for k, w in enumerate(h.tolist()):
                it.mask[w] = it.mask.get(w, 0) | 1 << k
            items.append(it)
            texts.append(h)
    if not items:
        return [], np.zeros((0, embed.shape[1]), np.float32), np.zeros(0, np.int64)
    ends = np.cumsum([len(h) for h in texts])
    first = ends - [len(h) for h in texts]
    return items, _embed(np.concatenate(texts), first, ends, embed), _windows(first, ends)[2]


def _embed(h: np.ndarray, first: np.ndarray, end: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """Unit latent vectors of the windows of texts with words first[i] to end[i], from sums over blocks of STRIDE words."""
    n = end - first
    ids, blocks = _blocks(_ids(h[first[0] : end[-1]] if len(n) else h), first, end, len(embed))
    base = np.cumsum(blocks) - blocks
    table = np.concatenate([embed, np.zeros_like(embed[:1])])
    out = np.zeros((len(_windows(first, end)[0]), embed.shape[1]), np.float32)
    at = 0
    for k in range(0, len(n), 64):  # a few texts at a time
        lo, hi = int(base[k]), int(base[k + 63] + blocks[k + 63]) if k + 63 < len(n) else len(ids)
        total = _sums(table, ids[lo:hi])
        per = np.where(blocks[k : k + 64] > 0, np.maximum(1, blocks[k : k + 64] - 1), 0)
        text = np.repeat(np.arange(len(per)), per)
        block = base[k : k + 64][text] - lo + np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        v = total[block]
        more = np.flatnonzero(blocks[k : k + 64][text] > 1)
        v[more] += total[block[more] + 1]
        out[at : at + len(v)] = v
        at += len(v)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def subsequence(item: Item, words: list[int]) -> tuple[int, int]:
    """Places of the item in a longest common subsequence with words, as bits, and its length. Bit-parallel."""
    return _longest(len(item.words), [m for w in words if (m := item.mask.get(w))])


def _longest(n: int, masks: list[int]) -> tuple[int, int]:
    """As subsequence, of n words and the masks of those of the others that the item has."""
    full = (1 << n) - 1
    v = full
    for m in masks:
        u = v & m
        v = ((v + u) | (v - u)) & full
    found = ~v & full
    return found, found.bit_count()


def _plausible(index: Index, near: np.ndarray, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows and queries whose cosine reaches the threshold and that share as many words as any match leaves in its best window."""
    w, q = np.divmod(np.flatnonzero(near >= index.cosine), max(1, near.shape[1]))
    keep = np.zeros(len(w), bool)
    for k in range(0, len(w), 8192):
        place = start[w[k : k + 8192], None] + np.arange(WINDOW)
        inside = place < end[w[k : k + 8192], None]
        item = index.owner[q[k : k + 8192]]
        shared = index.member[item[:, None], ids[np.minimum(place, len(ids) - 1)]] & inside
        keep[k : k + 8192] = shared.sum(1) >= index.shared[item]
    return w[keep], q[keep]


def _overlapping(index: Index, h: np.ndarray, ids: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Regions (text, item, start, end) around an item's keys that hold as many of its words as a match has.

    No match lies outside them: it has a key, and all of it is within the item's reach of that.
    """
    maybe = np.flatnonzero(index.keyed[ids])
    lo, hi = np.searchsorted(index.keys, h[maybe], "left"), np.searchsorted(index.keys, h[maybe], "right")
    place = np.repeat(maybe, hi - lo)
    if not len(place):
        return []
    per = (hi - lo)[hi > lo]
    item = index.listed[np.repeat(lo[hi > lo], per) + np.arange(len(place)) - np.repeat(np.cumsum(per) - per, per)]
    text = np.searchsorted(end, place, "right")
    a, b = np.maximum(first[text], place - index.reach[item] + 1), np.minimum(end[text], place + index.reach[item])
    keep = np.zeros(len(place), bool)
    for k in range(0, len(place), 4096):
        at = a[k : k + 4096, None] + np.arange(int((b - a)[k : k + 4096].max()))
        inside = index.member[item[k : k + 4096, None], ids[np.minimum(at, len(ids) - 1)]] & (at < b[k : k + 4096, None])
        keep[k : k + 4096] = inside.sum(1) >= index.need[item[k : k + 4096]]
    got: list[tuple[int, int, int, int]] = []
    order = np.flatnonzero(keep)[np.lexsort((place[keep], item[keep], text[keep]))]
    for t, i, x, y in zip(text[order].tolist(), item[order].tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        if got and got[-1][:2] == (t, i) and x <= got[-1][3]:
            got[-1] = (t, i, got[-1][2], y)
        else:
            got.append((t, i, x, y))
    return got


def _covered(index: Index, k: int, ids: np.ndarray, mark: np.ndarray) -> bool:
    """Whether as many places of item k as a match has hold a hashed word of ids; mark is all False, before and after."""
    mark[ids] = True
    places = np.count_nonzero(mark[index.hashed[k]])
    mark[ids] = False
    return places >= index.need[k]


def _judge(index: Index, item: Item, h: list[int], lo: int, hi: int, alone: bool = False) -> tuple[float, float]:
    """Best share of the item's words, and of its answer's, in order within a span little longer than the item."""
    n = len(item.words)
    region = h[lo:hi]
    if n == 1:  # a word stands everywhere: only a text that is this word holds the item
        return (1.0, 1.0) if alone and region == item.words.tolist() else (0.0, 0.0)
    if n < LEAST:
        own = item.words.tolist()
        return (1.0, 1.0) if any(region[k : k + n] == own for k in range(len(region) - n + 1)) else (0.0, 0.0)
    masks = [item.mask.get(w, 0) for w in region]
    hits = [m for m in masks if m]
    least = index.lcs * n
    # no span has more of the item than the whole region, nor a subsequence more than the places that any word has
    if reduce(or_, hits, 0).bit_count() < least - 1e-9 or _longest(n, hits)[1] < least - 1e-9:
        return 0.0, 0.0
    # words of the item before each place, so that spans with too few of them aren't looked at
    upto = [0, *accumulate(map(bool, masks))]
    reach = n + max(4, n // 4)
    best = (0.0, 0.0)
    for k in range(max(1, len(region) - reach + 1)):
        # a span that starts elsewhere than at a word of the item has a better one after it, or is the last
        upper = upto[min(k + reach, len(region))]
        if upper - upto[k] < least or (not masks[k] and k + reach < len(region)):
            continue
        found, length = _longest(n, hits[upto[k] : upper])
        best = max(best, (length / n, (found & item.answer).bit_count() / item.answer.bit_count()))
        if best == (1.0, 1.0):
            break
    return best


def search(index: Index, texts: list[str | None]) -> list[tuple[int, int, float, float, float]]:
    """(text's number, item, cosine, subsequence share, answer share) for each text and item that pass all checks."""
    got = []
    done = 0
    for part in textnum.chunks(texts, 1 << 20):
        h, a, b = _words(part)
        start, end, own = _windows(a, b)
        vectors = _embed(h, a, b, index.embed)
        ids = _ids(h)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        mark = np.zeros(1 << BITS, bool)
        for k in range(0, len(start), 4096):
            near = vectors[k : k + 4096] @ index.queries.T
            for w, q in zip(*_plausible(index, near, ids, start[k : k + 4096], end[k : k + 4096]), strict=True):
                key = (int(own[k + w]), int(index.owner[q]))
                if best.get(key, (0, 0, 0))[:2] == (1.0, 1.0):
                    continue
                at, n = int(start[k + w]), len(index.items[key[1]].words)
                lo, hi = max(int(a[key[0]]), at - n), min(int(b[key[0]]), at + WINDOW + n)
                if not _covered(index, key[1], ids[lo:hi], mark):
                    continue
                lcs, ans = _judge(index, index.items[key[1]], h[lo:hi].tolist(), 0, hi - lo)
                if lcs >= index.lcs and ans >= index.answer:
                    c = float(near[w, q])
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (lcs, ans, c), key=lambda x: (x[0], x[1]))
        for d, i, lo, hi in _overlapping(index, h, ids, a, b):
            if best.get((d, i), (0, 0, 0))[:2] == (1.0, 1.0):
                continue
            if not _covered(index, i, ids[lo:hi], mark):
                continue
            lcs, ans = _judge(index, index.items[i], h[lo:hi].tolist(), 0, hi - lo, bool(b[d] - a[d] == 1))
            if lcs >= index.lcs and ans >= index.answer:
                near = vectors[np.flatnonzero((own == d) & (start < hi) & (end > lo))] @ index.queries[index.owner == i].T
                best[d, i] = max(best.get((d, i), (0.0, 0.0, 0.0)), (lcs, ans, float(near.max())), key=lambda x: (x[0], x[1]))
        got += [(done + d, index.items[i].item_id, c, lcs, ans) for (d, i), (lcs, ans, c) in best.items()]
        done += len(part)
    return got


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.5, lcs: float = 0.7, answer: float = 0.5, rank: int = 128, fit_docs: int | None = None) -> DataFrame:
    """Rows (doc_id, item_id, cosine, lcs, answer) for every document of docs(doc_id, text) that holds an item of
    benchmark(item_id, text), exactly or paraphrased.

    Word counts are over all documents, and the latent space is fitted on the passages of all of them and of the
    benchmark; a number of `fit_docs` asks for a fit on about so many documents (at most twice that), drawn by a hash
    of the id, which shapes the returned cosines, not which places are found. Then every passage of every
    document is compared with every item window, and candidates of at least `cosine` are judged by the longest common
    subsequence of words (share of the item at least `lcs`, within a span a quarter longer than the item) and by the
    share of the answer's words in it. Whatever their cosine, so are all places with a rare word of an item and enough
    of its words around, which no match can do without; the returned cosine may thus be less. Nothing is capped. Null and empty texts hold nothing; items of under 5 words
    have to stand there as they are, and one of a single word has to be the whole text; one without a word is in no text;
    letters of scripts without spaces are words each; repeated rows give repeated results; an empty table on either side gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, lcs double, answer double"
    docs = docs.select("doc_id", "text")
    bench = benchmark.select("item_id", "text")
    n_items = bench.count()
    if not n_items:
        return spark.createDataFrame([], schema)
    # the words are written once, for their counts and for both passes of the fit
    read = cut(tokens(docs.select(F.col("text").alias("t"))))
    df, n = document_frequencies(read)
    if not n:
        return spark.createDataFrame([], schema)
    idf = np.log((1 + n) / (1 + df)) + 1
    asked = bench.select(F.col("text").alias("t"))
    if fit_docs is None:
        # a partition's sums are as large as the word vectors, so partitions are read together
        fit = read.unionByName(tokens(asked)).where("ids is not null").select("ids").coalesce(2 * spark.sparkContext.defaultParallelism)
    else:
        drawn = docs.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, fit_docs / n)) + 1)).limit(2 * fit_docs)
        fit = cut(drawn.select(F.col("text").alias("t")).unionByName(asked).where("t is not null").repartition(8))
    embed = (latent(fit, idf, rank) * idf[:, None]).astype(np.float32)
    give_back()
    found = None
    blocks = -(-n_items // BLOCK)
    for k in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        items, queries, owner = _items(rows, embed)
        shared = spark.sparkContext.broadcast(Index(embed, queries, owner, items, cosine, lcs, answer, df))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                hits = search(shared.value, batch.column(1).to_pylist())
                ids = batch.column(0).to_pylist()
                columns = [pa.array([ids[x[0]] for x in hits], pa.int64()), pa.array([x[1] for x in hits], pa.int64()), *[pa.array([x[i] for x in hits], pa.float64()) for i in (2, 3, 4)]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "cosine", "lcs", "answer"])

        one = docs.mapInArrow(look, schema)
        found = one if found is None else found.unionByName(one)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold a benchmark item; a null doc_id counts as one id for all its rows."""
    bad = cut(contaminated(docs, benchmark, **options).select("doc_id").distinct()).withColumnRenamed("doc_id", "_weft_bad")
    return docs.join(bad, docs.doc_id.eqNullSafe(bad._weft_bad), "left_anti")
