"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .common import give_back, with_columns

UNKNOWN = "und"
SIZES = (2, 3, 4)


@dataclass
class Model:
    """langs: learned values in order; table: logits of each bucket, averaged over a text; threshold: least accepted score."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    bits: int


def _bags(texts: list[str], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    got = []
    for part in textnum.chunks(texts, 1 << 17):
        ids, bounds = textnum.grams(part, SIZES, bits)
        for i in range(len(part)):
            a, b = bounds[2 * i], bounds[2 * i + 1]
            uniq, n = np.unique(np.concatenate([x[a:b] for x in ids]), return_counts=True)
            got.append((uniq.astype(np.int32), (n / n.sum()).astype(np.float32)))
    return got


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], bits: int = 16, dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Train on rows in a fixed order by stochastic gradient descent; every fifth row calibrates instead.

    Each training text also gives one short span of itself, so that scores hold for short texts. The temperature
    minimises the calibration rows' log loss; the threshold is the least score of 0.5 or more above which at most
    one accepted calibration row in 100 is wrong.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.5, bits)
    y = np.array([names.index(x) for x in langs])
    held = np.arange(len(y)) % 5 == 4
    spans = []
    for t in texts:
        w = t.split()
        k = int(rng.integers(1, 12))
        a = int(rng.integers(0, max(1, len(w) - k)))
        spans.append(" ".join(w[a : a + k]))
    bags = _bags([*texts, *spans], bits)
    y, held = np.concatenate([y, y]), np.concatenate([held, held])
    emb = (rng.standard_normal((1 << bits, dim)) * 0.1).astype(np.float32)
    w = (rng.standard_normal((dim, len(names))) * 0.1).astype(np.float32)
    b = np.zeros(len(names), np.float32)
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(train):
            ids, p = bags[i]
            x = p @ emb[ids]
            g = _softmax(x @ w + b)
            g[y[i]] -= 1
            gx = w @ g
            w -= step * np.outer(x, g)
            b -= step * 0.1 * g
            emb[ids] -= (step * 20) * np.minimum(p, 0.05)[:, None] * gx[None, :]
    table = (emb @ w).astype(np.float32)
    check = np.flatnonzero(held) if held.any() else np.arange(len(y))
    z = np.array([p @ table[ids] + b for ids, p in (bags[i] for i in check)])
    best = min((2.0 ** (k / 2) for k in range(-6, 9)), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean())
    prob = _softmax(z / best)
    score, wrong = prob.max(axis=1), prob.argmax(axis=1) != y[check]
    order = np.argsort(-score, kind="stable")
    errors = np.cumsum(wrong[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(errors <= 0.01)
    least = float(score[order][fine[-1]]) if len(fine) else 1.0
    return Model(names, table, b, float(best), max(0.5, min(least, 0.9)), bits)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each whole text; `und` with score 0 for null and texts without a letter."""
    out: list[str] = []
    scores: list[np.ndarray] = []
    for part in textnum.chunks(texts, 1 << 19):
        if not model.langs:
            out += [UNKNOWN] * len(part)
            scores.append(np.zeros(len(part)))
            continue
        ids, bounds = textnum.grams(part, SIZES, model.bits)
        z = sum(textnum.sums(np.take(model.table, x, axis=0), bounds) for x in ids)
        count = (bounds[1::2] - bounds[::2]) * len(SIZES)
        p = _softmax((z / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
        lettered = np.array([any(map(str.isalpha, t)) for t in part])
        out += [model.langs[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1), lettered, strict=True)]
        scores.append(np.where(lettered, p.max(axis=1), 0.0))
    return out, np.concatenate(scores) if scores else np.zeros(0)


def sample(docs: DataFrame, per_lang: int = 200) -> tuple[list[str], list[str]]:
    """About `per_lang` labelled rows of each language (at most twice that many), by a hash of the id, to the driver."""
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_lang / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_000)) / 1e6
    rows = known.where(draw < share[F.col("lang")]).select("doc_id", "lang", "text").limit(2 * per_lang * len(counts)).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    order = np.random.default_rng(1).permutation(len(rows))
    return [rows[i]["text"] for i in order], [rows[i]["lang"] for i in order]


def train(docs: DataFrame, per_lang: int = 200, **options) -> Model:
    """Fit on a bounded sample of the labelled rows of docs(doc_id, text, lang): the caller removes held-out rows."""
    texts, langs = sample(docs, per_lang)
    model = fit(texts, langs, **options)
    del texts, langs
    give_back()
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and accepted (has a letter and the score reaches the calibrated threshold).

    Only the text is read. Null texts and texts without a letter give `und`, score 0 and accepted false; an empty
    table gives no rows; existing columns of the three names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def told(texts: list) -> list[pa.Array]:
        langs, scores = predict(shared.value, texts)
        ok = [x != UNKNOWN and s >= shared.value.threshold for x, s in zip(langs, scores, strict=True)]
        return [pa.array(langs, pa.string()), pa.array(np.asarray(scores, float)), pa.array(ok, pa.bool_())]

    return with_columns(docs, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())], told)


def held_out(docs: DataFrame) -> DataFrame:
    """docs with held_out: crc32 of the id as text is 2 modulo 4; false for a null id."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
