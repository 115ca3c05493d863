"""Sequence packing by a grouping genetic algorithm on distributed islands."""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, chain, compress, pairwise, repeat
from operator import is_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import cut, give_back, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", shard long, island int, bin int, offset long, bins int, fitness double"
#: Words kept with their ids in a worker, in each of two generations.
CACHE = 500_000
_SPACE = re.compile(r"[ \t\n\r\f\v]")
#: A full stop or comma after another mark belongs to the same token as that; 1C to 1F are marks to the tokenizer.
_RUN = re.compile(r"[.,] (?<=[^\w\s]..|[_\x1c-\x1f]..)")
_tokenizers: dict[str, Words] = {}


def split(text: str) -> list[str]:
    """A text's words. Those of Latin-1 are lower-cased, and a lone full stop or comma at a word's end stands alone:
    the tokenizer gives the same ids for either form, and fewer distinct words are to be kept."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _SPACE.split(text)
    text = text.lower()
    if not _RUN.search(text):
        text = text.replace(". ", " . ").replace(", ", " , ")
    # the four separators that are white space to Python alone
    return _SPACE.split(text) if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text else text.split()


class Words:
    """Little-endian 32-bit ids of texts by the tokenizer at path, with those of words kept.

    The tokenizer lower-cases, drops white space and merges nothing across it, nor across the border of letters and
    marks, so a text's ids are those of its parts in order. When a generation of words is full the one before it is
    let go, so memory is bounded however many words there are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _encode(self, found: list[str]) -> None:
        """Learn words, many in one call; a token belongs to the word that it starts in."""
        for k in range(0, len(found), 256):
            part = found[k : k + 256]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in part])
            at = np.array([a for a, _ in got.offsets], np.int64)
            ends = (4 * np.searchsorted(at, starts)).tolist()
            ids = np.array(got.ids, "<u4").tobytes()
            self.known.update((w, ids[a:b]) for w, a, b in zip(part, ends, ends[1:], strict=False))

    def _learn(self, missing: set[str]) -> None:
        new = []
        for w in missing:
            if (got := self.old.get(w)) is None:
                new.append(w)
            else:
                self.known[w] = got
        self._encode(new)

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) >= CACHE:
            self.old, self.known = self.known, {"": b""}
        parts = [split(t) for t in texts]
        flat = list(chain.from_iterable(parts))
        found = list(map(self.known.get, flat))
        gaps = list(compress(range(len(found)), map(is_, found, repeat(None))))
        if gaps:
            self._learn({flat[i] for i in gaps})
            for i in gaps:
                found[i] = self.known[flat[i]]
        ends = [0, *accumulate(map(len, parts))]
        return [b"".join(found[a:b]) for a, b in pairwise(ends)]


def words(path: str) -> Words:
    if path not in _tokenizers:
        _tokenizers[path] = Words(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int = 0, keep_words: bool = True) -> DataFrame:
    """Of each row of docs(doc_id, text): its ids and end_id, cut every `size` ids; a null text is empty."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words(tokenizer)
        last = np.array([end_id], "<u4").tobytes()
        gc.disable()  # nothing here is cyclic, and there is much to walk
        for batch in slices(batches, 1024):
            rows = []
            found = (ids for part in textnum.chunks(batch.column(1).to_pylist(), 1 << 20) for ids in own.ids(part))
            for doc, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                ids += last
                for k in range(0, len(ids), 4 * size):
                    part = ids[k : k + 4 * size]
                    rows.append((doc, k // (4 * size), k // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        if not keep_words:
            own.known, own.old = {"": b""}, {}
            give_back()
        gc.enable()

    return docs.select("doc_id", "text").mapInArrow(told, PIECES)


class Bins:
    """Bins as lists of items, found by their room: `open` has bit r if a bin has room r."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.stacks: dict[int, list[int]] = {}
        self.open = 0

    def add(self, items: list[int], room: int) -> None:
        self._file(len(self.items), room)
        self.items.append(items)
        self.room.append(room)

    def _file(self, b: int, room: int) -> None:
        if room:
            self.stacks.setdefault(room, []).append(b)
            self.open |= 1 << room

    def best_fit(self, order: list[int], sizes: list[int]) -> None:
        """Put items, in this order, each where the least room is left; a new bin if it fits nowhere."""
        for i in order:
            s = sizes[i]
            fits = self.open >> s
            if fits:
                r = s + (fits & -fits).bit_length() - 1
                stack = self.stacks[r]
                b = stack.pop()
                if not stack:
                    self.open ^= 1 << r
                self.items[b].append(i)
                self.room[b] = r - s
                self._file(b, r - s)
            else:
                self.add([i], self.capacity - s)

    def fitness(self) -> float:
        """Falkenauer's: mean squared fill."""
        return float(np.mean((1 - np.array(self.room) / self.capacity) ** 2)) if self.room else 1.0


def _rank(x: Bins) -> tuple[int, float]:
    return len(x.items), -x.fitness()


def _best(found: list[Bins]) -> Bins:
    return min(found, key=_rank)


def crossover(a: Bins, b: Bins, sizes: list[int], rng: np.random.Generator, share: float = 0.4) -> Bins:
    """Whole bins of b, the better filled the likelier, go into a; a's bins that repeat their items are dissolved and
    their other items, largest first, best-fitted into what is left."""
    room = np.array(b.room)
    order = np.argsort(room + rng.random(len(room)) * a.capacity * 0.02, kind="stable")
    given = order[: max(1, int(len(order) * share * rng.uniform(0.5, 1.5)))]
    taken = {i for k in given for i in b.items[k]}
    child = Bins(a.capacity)
    for k in given:
        child.add(list(b.items[k]), b.room[k])
    loose: list[int] = []
    for items, left in zip(a.items, a.room, strict=True):
        if taken.isdisjoint(items):
            child.add(list(items), left)
        else:
            loose += [i for i in items if i not in taken]
    loose.sort(key=lambda i: -sizes[i])
    child.best_fit(loose, sizes)
    return child


def mutate(x: Bins, sizes: list[int], rng: np.random.Generator, share: float = 0.3) -> Bins:
    """The emptiest bins and as many others are dissolved and their items, largest first, best-fitted into what is left."""
    n = len(x.items)
    m = max(2, int(n * share))
    gone = set(np.argsort(-np.array(x.room), kind="stable")[:m].tolist()) | set(rng.integers(0, n, m).tolist())
    out = Bins(x.capacity)
    loose: list[int] = []
    for k in range(n):
        if k in gone:
            loose += x.items[k]
        else:
            out.add(list(x.items[k]), x.room[k])
    loose.sort(key=lambda i: -sizes[i])
    out.best_fit(loose, sizes)
    return out


def greedy(sizes: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """A first packing: best fit in an order of sizes under noise, so that the members of a population differ."""
    out = Bins(capacity)
    noise = np.asarray(sizes) * rng.uniform(0.7, 1.3, len(sizes))
    out.best_fit(np.argsort(-noise, kind="stable").tolist(), sizes)
    return out


def evolve(sizes: list[int], capacity: int, seed: int, generations: int, population: int, migrants: list[Bins]) -> tuple[Bins, int]:
    """The best packing found and the number of children that entered the population.

    The population starts from noisy greedy packings, or from migrants. Each generation crosses two members; the child,
    at times mutated, replaces the worst if it has fewer bins, or as many that are fuller. Evolution ends with the
    generations, or when a packing has the fewest bins that the total allows.
    """
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // capacity)
    pool = list(migrants)
    while len(pool) < population:
        pool.append(greedy(sizes, capacity, rng))
    rank = [_rank(x) for x in pool]
    accepted = 0
    for _ in range(generations):
        if min(rank)[0] <= least:
            break
        # the better of two draws, and another one
        a = min(rng.integers(len(pool), size=2).tolist(), key=rank.__getitem__)
        b = (a + int(rng.integers(1, len(pool)))) % len(pool)
        child = crossover(pool[a], pool[b], sizes, rng)
        if rng.random() < 0.7:
            child = mutate(child, sizes, rng)
        worst = max(range(len(pool)), key=rank.__getitem__)
        if (new := _rank(child)) < rank[worst]:
            pool[worst], rank[worst] = child, new
            accepted += 1
    return _best(pool), accepted


def _epoch(df: DataFrame, capacity: int, generations: int, population: int, number: int) -> DataFrame:
    """One epoch of every (shard, island): from nothing, or from the solutions that stand in its rows by `origin`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0])
        key = ["doc_id", "piece", "start", "length", "ids_crc32"]
        starts: list[Bins] = []
        if "origin" in pdf:
            solutions = [x.sort_values([*key, "bin", "offset"], kind="stable") for _, x in pdf.groupby("origin")]
            items = solutions[0]
            sizes = items["length"].tolist()
            for x in solutions:
                of: dict[int, list[int]] = {}
                for i, b in enumerate(x["bin"].tolist()):
                    of.setdefault(b, []).append(i)
                bins = Bins(capacity)
                for members in of.values():
                    bins.add(members, capacity - sum(sizes[i] for i in members))
                starts.append(bins)
        else:
            items = pdf.sort_values(key, kind="stable")
            sizes = items["length"].tolist()
        got, _ = evolve(sizes, capacity, (shard * 31 + island) * 31 + number, generations, population, starts)
        where, offset = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64)
        for b, members in enumerate(got.items):
            at = 0
            for i in sorted(members):
                where[i], offset[i] = b, at
                at += sizes[i]
        return items[key].assign(shard=shard, island=np.int32(island), bin=where, offset=offset, bins=np.int32(len(got.items)), fitness=got.fitness())

    return df.groupBy("shard", "island").applyInPandas(run, PLACED)


def _packed(items: DataFrame, capacity: int, shards: int, islands: int, epochs: int, generations: int, population: int, salt: int) -> DataFrame:
    """Items with shard, bin and offset: the best solution of each shard's islands after the last epoch."""
    shard = F.pmod(F.xxhash64("doc_id", "piece", "start", F.lit(salt)), F.lit(shards))
    df = items.withColumn("shard", shard).withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(islands)])))
    now = cut(_epoch(df, capacity, generations, population, 0))
    for number in range(1, epochs):
        # a shard with as few bins as its total allows is done; its islands have nothing to send
        state = now.groupBy("shard").agg(F.min("bins").alias("b"), (F.sum("length") / islands).alias("total"))
        solved = cut(state.where(F.col("b") <= F.ceil(F.col("total") / capacity)).select("shard"))
        if solved.count() >= shards:
            break
        done, now = now.join(solved, "shard", "left_semi"), now.join(solved, "shard", "left_anti")
        # each island's elite also goes to the next island of its shard
        to = F.array(F.struct(F.col("island").alias("to"), F.lit(0).alias("origin")), F.struct(((F.col("island") + 1) % islands).cast("int").alias("to"), F.lit(1).alias("origin")))
        sent = now.withColumn("x", F.explode(to)).withColumn("island", F.col("x.to")).withColumn("origin", F.col("x.origin")).drop("x", "bins", "fitness")
        now = cut(_epoch(sent, capacity, generations, population, number).unionByName(done.select(*now.columns)))
    best = now.groupBy("shard").agg(F.min(F.struct("bins", -F.col("fitness"), "island"))["island"].alias("island"))
    return now.join(best, ["shard", "island"])


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, shard_items: int = 4096, islands: int = 2, epochs: int = 2, generations: int = 10, population: int = 4, settled: float = 0.99, keep_words: bool = True) -> DataFrame:
    """Pack all rows of docs(doc_id, text) into sequences of at most `size` tokens: a row for each piece.

    A row's ids are the tokenizer's, then end_id; only longer ones are cut, into pieces of `size`. Pieces are dealt to
    shards of about `shard_items` by a hash, whatever the input's size; a shard's islands evolve packings and pass
    their elites on between epochs. Bins filled less than `settled` are dissolved and their pieces packed again, with
    those of other shards, until one shard is left, which evolves four times as long. Null and empty texts are one token; null ids, ties and repeated
    rows are packed like any others; an empty table gives no rows; other columns are ignored.
    keep_words leaves the ids of known words with a worker for its next task.
    """
    left = cut(pieces(docs, tokenizer, size, end_id, keep_words))
    done: list[DataFrame] = []
    for level in range(8):
        n = left.count()
        shards = max(1, -(-n // shard_items))
        got = cut(_packed(left, size, shards, islands, epochs, generations * (1 if shards > 1 else 4), population, level))
        got = got.withColumn("sequence_id", (F.lit(level).cast("long") * (1 << 58)) + F.col("shard") * (1 << 20) + F.col("bin"))
        if shards == 1:
            done.append(got)
            break
        fill = got.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
        got = cut(got.join(fill, "sequence_id"))
        loose = F.col("filled") < settled * size
        again = got.where(loose)
        if level == 7 or again.count() > 0.8 * n:  # these don't fill bins any better in other company
            done.append(got)
            break
        done.append(got.where(~loose))
        left = cut(again.select("doc_id", "piece", "start", "length", "ids_crc32"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in done])
