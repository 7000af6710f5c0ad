"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing, near_dedup, quality, spm
from tessera.llm.common import table, written
from tessera.session import ship_package

#: The probability of good quality below which a document is rejected.
GOOD = 0.7
#: Longer blocks than the operator's default leave most documents whole.
MIX = mixing.Mix(block_words=512)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted to labelled rows outside the held-out fold."""
    ship_package(spark)
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    scored = quality.scores(docs, model, *docs.columns, score="__quality")
    return scored.where(F.col("__quality") >= GOOD).drop("__quality")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id stays."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the least id stays."""
    ship_package(spark)
    return near_dedup.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the documents that stayed, mixed to the sources' target weights."""
    return mixing.mixed_documents(docs, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every passage, with the end id, and the digest of the text they decode to."""
    ship_package(spark)
    kept = ["doc_id", "lang", "source", "n_chars"]
    encoded = spm.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), *kept)
    return encoded.select(*kept, F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: A trained classifier, sketches and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of *sf_dir*."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
