"""Corpus pipeline over documents: language ID, near-dedup, decontamination, surrogates for personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents; the last returns a row for each piece of a packed sequence. A stage's docs are read several
times, so they have to be a table or a cut plan, not a long lineage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, langid, nearcopies, packing, pii
from weftgraph.llm.common import cut, ship, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Key of the surrogates; production jobs set their own.
PII_KEY = "weftgraph-demo-key"
SEQUENCE = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with calibrated confidence; the model learns outside the held-out rows."""
    ship(spark)
    marked = langid.held_out(docs.select(*COLUMNS))
    model = langid.train(marked.where("not held_out"))
    return langid.identify(docs.select(*COLUMNS), model).where("accepted").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies, five-word Jaccard similarity 0.8 or more."""
    ship(spark)
    return nearcopies.representatives(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, personal data replaced; n_chars follows the text."""
    return pii.replace(docs.select(*COLUMNS), PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document into sequences."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE, keep_words=False)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii_surrogates", surrogates), ("best_fit_packing", best_fit_packing)]

#: The language model and the latent retrieval aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
