"""From raw documents to token ids, in five stages over whole texts.

Every stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it.
Texts that are null count as empty; an empty table passes through empty. Rows that agree in id, source
and text are one document from the second stage on, whatever their other columns (of these, the least
row stays); rows that share an id only are different documents. All stages but the last return the
columns of ``documents``, and any that the input has besides, whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cadenza.llm import bpe, mixing, secrets, simhash, toxicity
from cadenza.llm.common import content, free_name, lookup, stored
from cadenza.llm.plans import TOXIC_FROM, toxicity_network

#: The stages end in neural scores, sampled models and tokenizer merges, which SQL cannot express.
ORACLE_SQL = None


def _document() -> Column:
    """What makes a row a document of its own."""
    return F.struct("doc_id", F.sha2(content().cast("binary"), 256).alias("text"), "source")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below the threshold."""
    made = free_name(docs, "score")
    scored = toxicity.score(docs, toxicity_network(spark, docs, sf_dir), into=made)
    return scored.filter(F.col(made) < TOXIC_FROM).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id (then text, then source), of each group of near copies."""
    groups = simhash.near_duplicates(docs.select(_document().alias("document"), "text"), words=3, distance=2, key="document")
    kept = groups.filter(F.col("document") == F.col("component_id")).select("document").distinct()
    given = docs.select(_document().alias("document"), F.struct(*docs.columns).alias("row"))
    found = given.join(lookup(kept), "document", "left_semi")
    return found.groupBy("document").agg(F.min("row").alias("row")).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    models = secrets.train(secrets.labelled_sample(docs))
    return secrets.redact(docs, models).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum: documents as often as their source's target asks, in training order."""
    given = docs.select(_document().alias("document"), "text", "source")
    planned = mixing.plan(given, mixing.turns(docs), key="document").filter("copies > 0")
    due = stored(planned.select("document", F.explode("positions").alias("position")), "due")
    # One row stands for all that are the same document; ``due`` has the copies of each of them.
    rows = docs.select(_document().alias("document"), F.struct(*docs.columns).alias("row")).groupBy("document").agg(F.min("row").alias("row"))
    return mixing.in_training_order(due.join(rows, "document")).select("row.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, and the text they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.round_trip(docs.select("doc_id", "source", "text"), path)
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return docs
