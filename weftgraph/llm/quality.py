"""Quality grades by ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .common import with_columns

#: Grades: toxic, poor, good.
GRADES = 3


@dataclass
class Model:
    """weights of hashed words, times their values, and of shape features, shared by all grades; ordered thresholds between grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int


#: Of each longer word also its first bytes count, so that inflected forms share weights.
STEMS = (4, 5)
#: Smoothing of a word's counts in a grade, least and for 5,000 texts or more, and the log ratio up to which a word is left out.
SMOOTH = (0.5, 3.0)
LEAST = 1.5
#: Shape features, after the hashed words: shares of upper case, digits and marks, mean word length, share of repeated features, log length.
SHAPES = 6


def _features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and their stems of each text without repeats, the texts' first and end places among them, and shape features."""
    total, starts, ends, a, b = textnum.places(texts)
    own = np.repeat(np.arange(len(texts)), b - a)
    cells = []
    for k in (*STEMS, 1 << 30):
        w = np.flatnonzero(ends - starts > (k if k < 1 << 30 else 0))
        h = textnum.spans(total, starts[w], np.minimum(starts[w] + k, ends[w])) ^ np.uint64(k)
        cells.append((own[w].astype(np.int64) << 32) | (textnum.mix(h) >> np.uint64(64 - bits)).astype(np.int64))
    cell = np.unique(np.concatenate(cells))
    row, col = cell >> 32, cell & ((1 << bits) - 1)
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    n = np.maximum(b - a, 1)
    shape = np.zeros((len(texts), SHAPES))
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        size = max(1, len(raw))
        shape[i, :3] = np.count_nonzero((raw >= 65) & (raw <= 90)) / size, np.count_nonzero((raw >= 48) & (raw <= 57)) / size, np.count_nonzero(_MARK[raw]) / size
        shape[i, 3] = min(len(raw) / n[i], 20) / 20
    shape[:, 4] = 1 - np.diff(cut) / (3 * n)
    shape[:, 5] = np.log1p(n) / 10
    return col, cut[:-1], cut[1:], shape


_MARK = np.array([33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 for c in range(256)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _values(rows: list, y: np.ndarray, bits: int) -> np.ndarray:
    """Of each word, by how much its smoothed log frequency differs most between texts on both sides of a threshold."""
    count = np.stack([np.bincount(np.concatenate([rows[i][0] for i in np.flatnonzero(y == g)] or [np.zeros(0, int)]), minlength=1 << bits) for g in range(GRADES)])
    size = np.bincount(y, minlength=GRADES)
    smooth = float(np.clip(SMOOTH[1] * len(rows) / 5000, *SMOOTH))
    ratios = []
    for k in range(1, GRADES):
        low = np.log((count[:k].sum(0) + smooth) / (size[:k].sum() + 2 * smooth))
        high = np.log((count[k:].sum(0) + smooth) / (size[k:].sum() + 2 * smooth))
        ratios.append(np.abs(high - low) * (count.sum(0) >= 2))
    return np.maximum(0, np.max(ratios, axis=0) - LEAST)


def fit(texts: list[str], grades: list[int], bits: int = 18, epochs: int = 8, rate: float = 1.0, seed: int = 11) -> Model:
    """Maximum likelihood by stochastic gradient descent: P(grade > k) = sigmoid(w.x - threshold_k) with rising thresholds.

    Thresholds are a first one and positive gaps, so they stay ordered. A word counts once in a text, however long that
    is, with the value that _values() gives it: words that say little are left out, and one tell-tale word weighs in
    long texts too. Steps adapt to how far a weight has moved. Grades are weighted by rarity.
    """
    w = np.zeros((1 << bits) + SHAPES)
    value = np.ones(1 << bits)
    base, gap = -1.0, np.ones(GRADES - 2)
    if texts:
        rows = []
        for part in textnum.chunks(texts):
            col, a, b, shape = _features(part, bits)
            rows += [(col[i:j], s) for i, j, s in zip(a, b, shape, strict=True)]
        y = np.array(grades)
        value = _values(rows, y, bits)
        share = np.bincount(y, minlength=GRADES) / len(y)
        weight = np.where(share > 0, np.sqrt(1 / np.maximum(share, 1e-9)), 0)[y]
        weight /= weight.mean()
        rng = np.random.default_rng(seed)
        seen = np.full(1 << bits, 1e-2)
        for epoch in range(epochs):
            step = rate / (1 + 0.5 * epoch)
            for i in rng.permutation(len(rows)):
                ids, shape = rows[i]
                v = value[ids]
                x = w[ids] @ v + w[-SHAPES:] @ shape
                cuts = base + np.concatenate([[0], np.cumsum(np.exp(gap))])
                # bounds of the grade's interval: P = F(upper - x) - F(lower - x)
                up = 1.0 if y[i] == GRADES - 1 else _sigmoid(cuts[y[i]] - x)
                low = 0.0 if y[i] == 0 else _sigmoid(cuts[y[i] - 1] - x)
                # with a logistic link the derivative of log P in x is F(upper) + F(lower) - 1
                gx = weight[i] * (up + low - 1)
                own = v * gx
                seen[ids] += own * own
                # a text's step is shared among its words, or long texts would overshoot
                w[ids] += step * own / np.sqrt(seen[ids]) / max(1.0, (v @ v) ** 0.5)
                w[-SHAPES:] += 0.1 * step * gx * shape
                p = max(up - low, 1e-6)
                grad = np.zeros(GRADES - 1)
                if y[i] < GRADES - 1:
                    grad[y[i]] += up * (1 - up) / p
                if y[i] > 0:
                    grad[y[i] - 1] -= low * (1 - low) / p
                grad *= weight[i] * step * 0.1
                base += grad.sum()
                for k in range(GRADES - 2):
                    gap[k] = np.clip(gap[k] + grad[k + 1 :].sum() * np.exp(gap[k]), -5, 3)
    folded = np.append(w[:-SHAPES] * value, w[-SHAPES:])
    return Model(folded.astype(np.float32), base + np.concatenate([[0], np.cumsum(np.exp(gap))]), bits)


def predict(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade (0 to GRADES - 1) and tail probabilities P(grade > k) of each whole text; null is empty."""
    scores = []
    for part in textnum.chunks(texts):
        col, a, b, shape = _features(part, model.bits)
        total = textnum.sums(model.weights[col].astype(np.float64), np.stack([a, b], axis=1).ravel()) if len(col) else np.zeros(len(part))
        scores.append(total + shape @ model.weights[-SHAPES:])
    x = np.concatenate(scores) if scores else np.zeros(0)
    tail = _sigmoid(x[:, None] - model.thresholds[None, :])
    return tail.sum(1), tail


def sample(docs: DataFrame, labels: DataFrame, rows: int = 6000) -> tuple[list[str], list[int]]:
    """About `rows` labelled documents (at most twice that), by a hash of the id: 0 toxic, 1 poor, 2 good.

    Labels without an id, with a null quality, or given to no document are left out; contradictory labels of one id
    count as the least grade.
    """
    grade = F.when(F.coalesce("toxic", F.lit(0)) == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    own = labels.select(F.col("doc_id").alias("label_id"), grade.alias("grade")).where("grade is not null and label_id is not null").groupBy("label_id").agg(F.min("grade").alias("grade"))
    n = own.count()
    if not n:
        return [], []
    drawn = own.where(F.pmod(F.xxhash64(F.col("label_id"), F.lit(23)), F.lit(1_000_000)) / 1e6 < min(1.0, rows / n)).limit(2 * rows)
    got = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "grade").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["grade"], r["text"]))
    return [r["text"] for r in got], [r["grade"] for r in got]


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000, **options) -> Model:
    return fit(*sample(docs, labels, rows), **options)


def grade(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs with expected_grade (0 to 2), p_not_toxic, p_good, and selected: not toxic and good with `least` each.

    Only the text is read, whole. Null and empty texts have no words and are graded by their shape alone; repeated
    rows are graded alike; existing columns of these names are replaced; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def told(texts: list) -> list[pa.Array]:
        mean, tail = predict(shared.value, texts)
        return [pa.array(mean), pa.array(tail[:, 0].copy()), pa.array(tail[:, 1].copy())]

    got = with_columns(docs, text, [T.StructField(c, T.DoubleType()) for c in ("expected_grade", "p_not_toxic", "p_good")], told)
    return got.withColumn("selected", (F.col("p_not_toxic") >= least) & (F.col("p_good") >= least))
