"""Removal of repeated byte strings with a distributed merge of front-coded sorted suffix runs.

A string of LENGTH bytes holds LENGTH - GRAM + 1 grams; the least by hash is its anchor, wherever the string stands,
so equal strings meet at equal anchors. Only suffixes that start at anchors are sorted, and only those whose gram
comes up more than once in the corpus.

A chunk of documents is worked on in pieces of a few megabytes; a longer document is cut into pieces that overlap by
LENGTH - 1 bytes, so each string is in one. Whole strings are compared by bytes, or by 128 bits of hashes where they
don't meet.

1. Each piece hashes its grams and sends each anchor's hash once; buckets tell the chunks which repeat.
2. Each chunk sorts the suffixes at its repeated anchors and sends them front-coded, one run for each bucket. Anchors
   that stand in the same surroundings are sent once, the first; the others are known to be repeats. Anchors in very
   many chunks send the hashes of their strings instead, which spread over all buckets.
3. Each bucket merges its runs with a loser tree that keeps the length of known common prefixes. Suffixes with a
   common gram stand together, and the strings around them are compared with the first of their kind.
4. Each chunk removes what the buckets found.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .textnum import U64

GRAM = 32
CHUNK = 4 << 20
#: Bytes that are in memory with their hashes at once.
PIECE = 2 << 20
BUCKET = 16 << 20
#: An anchor in more chunks than this sends the hashes of its strings.
HOT = 64
FLAGS = U64(3)
#: Base of the second hash.
OTHER = 0xD1342543DE82EF95
ROW = "g long, bucket int, kind int, data binary"


class Anchors:
    """Anchors of a piece's texts: at (place), doc, lo and hi (first and last start of its strings), gram (hash).

    shift: of each text, what takes a place in the piece to one in its document; number: its document's in the chunk.
    """

    def __init__(self, piece: list[tuple[int, int, bytes]], length: int):
        self.length = length
        texts = [t for _, _, t in piece]
        self.number = np.array([d for d, _, _ in piece], np.int64)
        self.shift = np.array([b for _, b, _ in piece], np.int64) - np.cumsum([0, *map(len, texts)])[:-1]
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.bounds = np.cumsum([0, *map(len, texts)])
        n = len(self.buf) - GRAM + 1
        self.sums = textnum.prefix(self.buf)
        self.other: np.ndarray | None = None
        empty = np.zeros(0, np.int64)
        self.at, self.lo, self.hi, self.doc, self.gram = empty, empty, empty, empty, empty.astype(U64)
        if len(self.buf) < length:
            return
        starts = np.arange(n)
        h = textnum.spans(self.sums, starts, starts + GRAM)
        width = max(21, int(n).bit_length())
        key = (h >> U64(width) << U64(width)) | starts.astype(U64)
        span = length - GRAM + 1
        low, step = key, 1
        while step * 2 <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < span:
            low = np.minimum(low[: len(key) - span + 1], low[span - step : span - step + len(key) - span + 1])
        first = (low & U64((1 << width) - 1)).astype(np.int64)
        # strings that cross the end of a document don't count
        size = np.diff(self.bounds)
        good = np.concatenate([np.arange(b, b + max(0, s - length + 1)) for b, s in zip(self.bounds[:-1], size, strict=True)]) if len(size) else empty
        if not len(good):
            return
        got = first[good]
        new = np.flatnonzero((np.diff(got, prepend=-1) != 0) | (np.diff(good, prepend=-2) != 1))
        self.at, self.lo = got[new], good[new]
        self.hi = good[np.append(new[1:], len(good)) - 1]
        self.doc = np.searchsorted(self.bounds, self.at, "right") - 1
        self.gram = h[self.at] & ~FLAGS

    def around(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of hash of all that an anchor's strings hold, with the anchor's place in it."""
        if self.other is None:
            self.other = textnum.prefix(self.buf, OTHER)
        with np.errstate(over="ignore"):
            place = (self.at[k] - self.lo[k]).astype(U64) * U64(textnum.BASE) + (self.hi[k] - self.lo[k]).astype(U64)
            return tuple(textnum.mix(textnum.spans(sums, self.lo[k], self.hi[k] + self.length, base) + place) for sums, base in ((self.sums, textnum.BASE), (self.other, OTHER)))


def pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts in pieces of about PIECE bytes, as (number, offset, bytes); a longer text's pieces overlap by length - 1."""
    part: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), PIECE):
            one = t[at : at + PIECE + length - 1]
            if part and size + len(one) > PIECE + length:
                yield part
                part, size = [], 0
            part.append((i, at, one))
            size += len(one)
    if part:
        yield part


def firsts(key: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether each row is the first of its key by the columns of order, the most significant first."""
    by = np.lexsort((*order[::-1], *key))
    out = np.zeros(len(by), bool)
    new = np.zeros(len(by), bool)
    new[:1] = True
    for k in key:
        new[1:] |= np.diff(k[by]) != 0
    out[by[new]] = True
    return out


def front_code(suffixes: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Of sorted suffixes of at most 255 bytes: common prefixes with the one before, tail lengths, tails."""
    common, size, tails, last = bytearray(), bytearray(), [], b""
    for s in suffixes:
        k = shared(last, s, 0)
        common.append(k)
        size.append(len(s) - k)
        tails.append(s[k:])
        last = s
    return bytes(common), bytes(size), b"".join(tails)


def shared(a: bytes, b: bytes, k: int) -> int:
    """Length of the common prefix, of which k bytes are known."""
    n = min(len(a), len(b))
    while k + 16 <= n and a[k : k + 16] == b[k : k + 16]:
        k += 16
    while k < n and a[k] == b[k]:
        k += 1
    return k


def unfold(common: bytes, size: bytes, tails: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for k, n in zip(common, size, strict=True):
        last = last[:k] + tails[at : at + n]
        at += n
        out.append(last)
    return out


class LoserTree:
    """Merges runs of sorted strings with known common prefixes; no byte of a known common prefix is read again.

    Of each run's head the tree keeps its common prefix with the head that beat it. Both contenders at a node are not
    less than the last output, so the one with the longer common prefix is the lesser; only equal ones are compared,
    and from there on.
    """

    def __init__(self, runs: list[list[bytes]], common: list[bytes]):
        self.runs, self.common = runs, common
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.place = [0] * len(runs)
        self.head: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (self.size - len(runs))
        self.known = [0] * self.size
        self.loser = [0] * self.size
        self.compared = 0
        win = list(range(self.size))
        level = self.size
        while level > 1:
            level //= 2
            win = [self._play(level + k, win[2 * k], win[2 * k + 1]) for k in range(level)]
        self.winner = win[0]

    def _play(self, node: int, a: int, b: int) -> int:
        """Winner of a and b; the loser stays at node."""
        x, y = self.head[a], self.head[b]
        if y is None:
            self.loser[node] = b
            return a
        if x is None:
            self.loser[node] = a
            return b
        i, j = self.known[a], self.known[b]
        if i > j:
            self.loser[node] = b
            return a
        if j > i:
            self.loser[node] = a
            return b
        k = shared(x, y, i)
        self.compared += k - i + 1
        if x[k : k + 1] < y[k : k + 1] or (x[k : k + 1] == y[k : k + 1] and a < b):
            self.known[b], self.loser[node] = k, b
            return a
        self.known[a], self.loser[node] = k, a
        return b

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, index in it, common prefix with the string before) in sorted order."""
        head, known, loser, place = self.head, self.known, self.loser, self.place
        while head[self.winner] is not None:
            w = self.winner
            k = place[w]
            yield w, k, known[w]
            place[w] = k = k + 1
            run = self.runs[w]
            if k < len(run):
                head[w], known[w] = run[k], self.common[w][k]
            else:
                head[w] = None
            node = (self.size + w) // 2
            while node:
                other = loser[node]
                if head[other] is not None:
                    if head[w] is None or known[w] < known[other]:
                        loser[node], w = w, other
                    elif known[w] == known[other]:
                        w = self._play(node, w, other)
                node //= 2
            self.winner = w


def _chunk(docs: pd.DataFrame, copies: set) -> tuple[pd.DataFrame, list[bytes]]:
    """A chunk's documents in order, each once, and their texts; those of whole copies are left empty."""
    docs = docs.drop_duplicates(["oid", "tie"]).sort_values(["oid", "tie"], kind="stable").reset_index(drop=True)
    texts = [b"" if k in copies else (t or "").encode("utf-8", "surrogatepass") for k, t in zip(zip(docs["oid"], docs["tie"], strict=True), docs["text"], strict=True)]
    return docs, texts


def _copies(notes: pd.DataFrame) -> set:
    own = notes[notes["kind"] == -1]
    return set(zip(own["oid"], own["tie"], strict=True))


def _rows(g: int, parts: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame({"g": np.full(len(parts), g, np.int64), "bucket": np.array([p[0] for p in parts], np.int32), "kind": np.array([p[1] for p in parts], np.int32), "data": [p[2] for p in parts]})


def _announce(length: int, buckets: int):
    def run(docs: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        if docs.empty:
            return _rows(0, [])
        _, texts = _chunk(docs, _copies(notes))
        found = [np.unique(Anchors(x, length).gram, return_counts=True) for x in pieces(texts, length)]
        h, back = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
        h |= (np.bincount(back, np.concatenate([x[1] for x in found])) > 1).astype(U64)
        b = (h >> U64(32)) % U64(buckets)
        order = np.argsort(b, kind="stable")
        cut = np.searchsorted(b[order], np.arange(buckets + 1))
        return _rows(int(docs["g"].iloc[0]), [(k, 0, h[order[cut[k] : cut[k + 1]]].tobytes()) for k in range(buckets) if cut[k] < cut[k + 1]])

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = [np.frombuffer(x, U64) for x in pdf["data"]]
    every = np.concatenate(parts)
    h, inverse, n = np.unique(every & ~FLAGS, return_inverse=True, return_counts=True)
    told = (n > 1) | (np.bincount(inverse, (every & U64(1)).astype(float)) > 0)
    out, at = [], 0
    for g, p in zip(pdf["g"], parts, strict=True):
        own = inverse[at : at + len(p)]
        at += len(p)
        own = own[told[own]]
        if len(own):
            out.append(_rows(int(g), [(0, 0, (h[own] | (n[own] > HOT).astype(U64)).tobytes())]))
    return pd.concat(out) if out else _rows(0, [])


def _send(length: int, buckets: int):
    def run(docs: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        if docs.empty:
            return _rows(0, [])
        g = int(docs["g"].iloc[0])
        docs, texts = _chunk(docs, _copies(notes))
        answers = [np.frombuffer(x, U64) for x in notes.loc[notes["kind"] == 0, "data"]]
        if not answers:
            return _rows(g, [])
        told = np.sort(np.concatenate(answers))
        oid, tie = docs["oid"].to_numpy(np.int64), docs["tie"].to_numpy(np.int64)
        parts: list[tuple[int, int, bytes]] = []
        gone: list[np.ndarray] = []
        for piece in pieces(texts, length):
            _suffixes(Anchors(piece, length), told, oid, tie, buckets, parts, gone)
        parts += _gone(g, gone)
        return _rows(g, parts)

    return run


def _suffixes(a: Anchors, told: np.ndarray, oid: np.ndarray, tie: np.ndarray, buckets: int, parts: list, gone: list) -> None:
    """Add to parts what a piece sends, and to gone the spans that repeat in it."""
    length = a.length
    place = np.minimum(np.searchsorted(told, a.gram), len(told) - 1)
    k = np.flatnonzero((told[place] & ~FLAGS) == a.gram)
    hot = (told[place[k]] & U64(1)).astype(bool)
    # documents stand in order, so a lesser place is an earlier one
    first = firsts(a.around(k), (a.at[k],))
    shift, number = a.shift[a.doc], a.number[a.doc]
    gone.append(np.stack([number[k[~first]], a.lo[k[~first]] + shift[k[~first]], a.hi[k[~first]] + length + shift[k[~first]]], axis=1))
    k, hot = k[first], hot[first]

    z = k[hot]
    if len(z):
        count = a.hi[z] - a.lo[z] + 1
        start = np.repeat(a.lo[z], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        own, local = np.repeat(number[z], count), start + np.repeat(shift[z], count)
        h, h2 = textnum.spans(a.sums, start, start + length), textnum.spans(a.other, start, start + length, OTHER)
        one = firsts((h, h2), (start,))
        gone.append(np.stack([own[~one], local[~one], local[~one] + length], axis=1))
        h, h2, own, local = h[one], h2[one], own[one], local[one]
        b = (h >> U64(32)) % U64(buckets)
        order = np.argsort(b, kind="stable")
        cut = np.searchsorted(b[order], np.arange(buckets + 1))
        for j in range(buckets):
            w = order[cut[j] : cut[j + 1]]
            if len(w):
                parts.append((j, 2, pickle.dumps((h[w], h2[w], oid[own[w]], tie[own[w]], own[w].astype(np.int32), local[w].astype(np.int64)))))

    z = k[~hot]
    if len(z):
        data = a.buf.tobytes()
        b = ((a.gram[z] >> U64(32)) % U64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        cut = np.searchsorted(b[order], np.arange(buckets + 1))
        around, around2 = a.around(z)
        for j in range(buckets):
            w = order[cut[j] : cut[j + 1]]
            if not len(w):
                continue
            y = z[w]
            suffix = [data[p:e] for p, e in zip(a.at[y].tolist(), (a.hi[y] + length).tolist(), strict=True)]
            by = sorted(range(len(y)), key=suffix.__getitem__)
            w, y = w[by], y[by]
            left = b"".join(data[s:p] for s, p in zip(a.lo[y].tolist(), a.at[y].tolist(), strict=True))
            meta = (oid[number[y]], tie[number[y]], number[y].astype(np.int32), a.at[y] + shift[y], (a.at[y] - a.lo[y]).astype(np.uint8), (a.at[y] - a.hi[y]).astype(np.int16), around[w], around2[w])
            parts.append((j, 1, pickle.dumps((front_code([suffix[i] for i in by]), left, meta))))


def _gone(g: int, spans: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """Removed spans (document's number, start, end) as one row; its bucket is the chunk's, as any would do."""
    every = np.concatenate(spans) if spans else np.zeros((0, 3), np.int64)
    return [(g % 2**20, 3, np.ascontiguousarray(every, np.int64).tobytes())] if len(every) else []


def _merge(length: int):
    """Compare what meets in a bucket; gives back spans to remove, kind 3."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list[np.ndarray]] = {}
        for g, x in zip(pdf.loc[pdf["kind"] == 3, "g"], pdf.loc[pdf["kind"] == 3, "data"], strict=True):
            out.setdefault(int(g), []).append(np.frombuffer(x, np.int64).reshape(-1, 3))
        hashed = pdf[pdf["kind"] == 2]
        if len(hashed):
            h, h2, oid, tie, doc, start = (np.concatenate(c) for c in zip(*map(pickle.loads, hashed["data"]), strict=True))
            g = np.repeat(hashed["g"].to_numpy(), [len(pickle.loads(x)[0]) for x in hashed["data"]])
            late = ~firsts((h, h2), (oid, tie, start))
            _spread(out, g[late], np.stack([doc[late], start[late], start[late] + length], axis=1))
        runs = pdf[pdf["kind"] == 1].sort_values("g", kind="stable")
        if len(runs):
            _compare(runs, length, out)
        rows = [_rows(g, [(0, 3, np.concatenate(x).tobytes())]) for g, x in out.items()]
        return pd.concat(rows) if rows else _rows(0, [])

    return run


def _spread(out: dict, g: np.ndarray, spans: np.ndarray) -> None:
    order = np.argsort(g, kind="stable")
    g, spans = g[order], spans[order]
    edge = np.flatnonzero(np.diff(g, prepend=-1))
    for a, b in zip(edge, [*edge[1:], len(g)], strict=False):
        out.setdefault(int(g[a]), []).append(spans[a:b].astype(np.int64))


def _compare(runs: pd.DataFrame, length: int, out: dict) -> None:
    loaded = [pickle.loads(x) for x in runs["data"]]
    suffixes = [unfold(*x[0]) for x in loaded]
    base = np.cumsum([0, *map(len, suffixes)])
    tree = LoserTree(suffixes, [x[0][0] for x in loaded])
    seen = np.fromiter((x for r, k, c in tree for x in (base[r] + k, c)), np.int64).reshape(-1, 2)
    order, common = seen[:, 0], seen[:, 1]
    oid, tie, doc, at, left, right, around, around2 = (np.concatenate([x[2][c] for x in loaded])[order] for c in range(8))
    g = np.repeat(runs["g"].to_numpy(), np.diff(base))[order]
    group = np.cumsum(common < GRAM)
    left = left.astype(np.int64)
    lo, hi = at - left, at - right.astype(np.int64)
    first = firsts((around, around2, group), (oid, tie, at))
    _spread(out, g[~first], np.stack([doc[~first], lo[~first], hi[~first] + length], axis=1))
    # different surroundings of one gram: string by string
    several = np.flatnonzero(first)
    several = several[np.bincount(group[several], minlength=group[-1] + 1)[group[several]] > 1]
    if not len(several):
        return
    flat = [s for x in suffixes for s in x]
    starts = [np.concatenate([[0], np.cumsum(x[2][4].astype(np.int64))]) for x in loaded]
    room = length - GRAM
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group[several])) + 1, [len(several)]])
    lot = 0
    while lot < len(edges) - 1:  # whole groups, about 8,192 suffixes at a time
        end = max(lot + 1, int(np.searchsorted(edges, edges[lot] + 8192, "right")) - 1)
        part = several[edges[lot] : edges[end]]
        lot = end
        table = np.zeros((len(part), room + length), np.uint8)
        run = np.searchsorted(base, order[part], "right") - 1
        for i, (e, r) in enumerate(zip(part.tolist(), run.tolist(), strict=True)):
            k = int(order[e]) - int(base[r])
            s = starts[r]
            near = loaded[r][1][s[k] : s[k + 1]]
            if near:
                table[i, room - len(near) : room] = np.frombuffer(near, np.uint8)
            tail = flat[int(order[e])]
            table[i, room : room + len(tail)] = np.frombuffer(tail, np.uint8)
        power = textnum.powers(room + length)
        with np.errstate(over="ignore"):
            sums = np.zeros((len(part), room + length + 1), U64)
            np.cumsum((table.astype(U64) + U64(1)) * power, axis=1, out=sums[:, 1:])
            back = np.arange(room + 1)
            value = sums[:, room - back + length] - sums[:, room - back]
            key = textnum.mix(value * textnum.powers(room + 1, textnum.inverse())[room - back]) + group[part].astype(U64)[:, None] * U64(textnum.BASE) + back.astype(U64)
        own = (back <= left[part][:, None]) & (back >= right[part].astype(np.int64)[:, None])
        e, o = np.nonzero(own)
        rank = np.empty(len(part), np.int64)
        rank[np.lexsort((at[part], tie[part], oid[part]))] = np.arange(len(part))
        late = _verified(table, room - o, length, e, firsts_of(textnum.mix(key[e, o]), rank[e]), rank[e])
        e, o = e[late], o[late]
        _spread(out, g[part[e]], np.stack([doc[part[e]], at[part[e]] - o, at[part[e]] - o + length], axis=1))


def firsts_of(key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of each row the row of its key that has the least rank."""
    by = np.lexsort((rank, key))
    head = np.maximum.accumulate(np.where(np.append(True, np.diff(key[by]) != 0), np.arange(len(by)), 0))
    out = np.empty(len(by), np.int64)
    out[by] = by[head]
    return out


def _verified(table: np.ndarray, start: np.ndarray, length: int, row: np.ndarray, first: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether each string table[row, start : start + length] has the bytes of the first that shares its hash, another one.

    Where two strings share a hash and differ, all of that hash are compared by bytes instead.
    """
    late = first != np.arange(len(first))
    view = np.lib.stride_tricks.sliding_window_view(table, length, axis=1)
    where = np.flatnonzero(late)
    wrong: set[int] = set()
    for k in range(0, len(where), 1 << 15):
        w = where[k : k + (1 << 15)]
        same = (view[row[w], start[w]] == view[row[first[w]], start[first[w]]]).all(1)
        wrong.update(first[w[~same]].tolist())
    for f in wrong:
        seen: set[bytes] = set()
        members = np.flatnonzero(first == f)
        for i in members[np.argsort(rank[members], kind="stable")]:
            b = view[row[i], start[i]].tobytes()
            late[i] = b in seen
            seen.add(b)
    return late


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(length: int, keep_text: bool):
    def run(docs: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        if docs.empty:
            return pd.DataFrame({c.split()[0]: [] for c in RESULT.split(", ")} | ({"kept": []} if keep_text else {}))
        copies = _copies(notes)
        docs, texts = _chunk(docs, set())
        spans = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in notes.loc[notes["kind"] == 3, "data"]]
        gone = np.concatenate(spans) if spans else np.zeros((0, 3), np.int64)
        gone = gone[np.argsort(gone[:, 0], kind="stable")]
        cut = np.searchsorted(gone[:, 0], np.arange(len(texts) + 1))
        rows = []
        for i, (o, t, text) in enumerate(zip(docs["oid"], docs["tie"], texts, strict=True)):
            mark = np.zeros(len(text) + 1, np.int32)
            if (o, t) in copies:
                if len(text) >= length:
                    mark[0], mark[-1] = 1, -1
            else:
                own = gone[cut[i] : cut[i + 1]]
                np.add.at(mark, own[:, 1], 1)
                np.add.at(mark, own[:, 2], -1)
            out = np.cumsum(mark[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~out].tobytes()
            spans_of = int(np.count_nonzero(np.diff(out.astype(np.int8), prepend=0) == 1))
            rows.append((docs["doc_id"].iloc[i], len(text), len(text) - len(kept), spans_of, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
        got = pd.DataFrame(rows, columns=[*(c.split()[0] for c in RESULT.split(", ")), *(["kept"] if keep_text else [])])
        return got.assign(doc_id=pd.array([None if pd.isna(x) else int(x) for x in got["doc_id"]], "Int64"))

    return run


def remove_repeats(docs: DataFrame, length: int = 100, keep_text: bool = False) -> DataFrame:
    """Per document of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked.

    Every byte covered by a string of `length` bytes that also starts earlier, in a document of smaller doc_id or
    further left in its own, is removed; strings are judged on the input and don't cross documents. `length` is 64 to
    200. A null text is empty; a null doc_id is the smallest; rows of equal doc_id and text are one document, those of
    equal doc_id and other texts are ordered by a digest of them; an empty table gives no rows; other columns are
    ignored.
    """
    if not 64 <= length <= 200:
        raise ValueError("length must be 64 to 200")
    text = F.coalesce("text", F.lit(""))
    sha = F.sha2(text, 256)
    own = docs.select("doc_id", F.col("text"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("oid"), F.conv(F.substring(sha, 1, 15), 16, 10).cast("long").alias("tie"), sha.alias("sha"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(1, -(-total // CHUNK)), max(1, -(-total // BUCKET))
    g = F.pmod(F.xxhash64("oid", "tie"), F.lit(chunks))
    data = own.select("doc_id", "text", "oid", "tie", g.alias("g"))
    # whole copies of an earlier text need no suffixes; only ids and digests meet here, pre-aggregated
    ids = own.select("oid", "tie", "sha").distinct()
    least = ids.groupBy("sha").agg(F.min(F.struct("oid", "tie")).alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = ids.join(least, "sha").where("oid <> least.oid or tie <> least.tie").select(g.alias("g"), "oid", "tie", F.lit(-1).alias("kind"), F.lit(None).cast("binary").alias("data"))

    def notes(df: DataFrame) -> DataFrame:
        zero = F.lit(0).cast("long")
        return df.select("g", zero.alias("oid"), zero.alias("tie"), "kind", "data").unionByName(copies)

    def with_docs(other: DataFrame, run, schema: str) -> DataFrame:
        other = other.select(*[F.col(c).alias(c) for c in other.columns])  # fresh attributes: both sides come from docs
        return data.groupBy("g").cogroup(other.groupBy("g")).applyInPandas(run, schema)

    announced = with_docs(copies, _announce(length, buckets), ROW)
    answers = announced.groupBy("bucket").applyInPandas(_answer, ROW)
    sent = with_docs(notes(answers), _send(length, buckets), ROW)
    found = sent.groupBy("bucket").applyInPandas(_merge(length), ROW)
    return with_docs(notes(found), _finish(length, keep_text), RESULT + (", kept binary" if keep_text else ""))
