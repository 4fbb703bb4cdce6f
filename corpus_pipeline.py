"""Corpus pipeline: from raw documents to packed training sequences.

Toxic documents go, then those whose language cannot be told; of near copies one
stays; the rest is mixed to target weights and packed. Every stage works on all
its predecessor kept. Each operator's own handling of nulls, empty and very long
texts, ties, repeated rows, empty tables and clashing names holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm import language_id, near_text, queries, toxicity
from duelframe.llm.common import fresh_name, table
from duelframe.session import spool

#: The stages decide with learned models and exact set comparisons, which SQL cannot express.
ORACLE_SQL = None
#: Near copies: five-word shingles, similarity 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the cut; the network learns from the labels of all but the held-out quarter."""
    model = toxicity.learn(docs, toxicity.learning_labels(table(spark, sf_dir, "labels")))
    score = fresh_name(docs.columns, "toxicity")
    return docs.withColumn(score, toxicity.toxicity_of("text", model)).where(F.col(score) < toxicity.CUT).drop(score)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null and letterless texts go. Where no language is given, the one told is set."""
    profiles = language_id.learn_profiles(language_id.training_rows(docs))
    found = fresh_name(docs.columns, "language_found")
    judged = docs.withColumn(found, language_id.language_of("text", profiles)).where(F.col(f"{found}.lang") != language_id.UNKNOWN)
    return judged.withColumn("lang", F.coalesce("lang", F.col(f"{found}.lang"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_text.keep_one(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents picked to the target weights, each read once at most; the last one of a leaf's prefix is cut at its quota."""
    mixed = queries.mixture(docs, max_epochs=1).readings()
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    return queries.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
