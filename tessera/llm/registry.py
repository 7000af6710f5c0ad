"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, exact_dedup, fingerprints, merkle, mixing, near_dedup, ngram_lm, quality, spm, token_files
from tessera.llm.common import crc_mod, table, written
from tessera.session import shipped


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assignments(table(spark, sf_dir, "documents"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    messages = rows.select("conv_id", "turn", "role", chat.text_parts(F.coalesce("text", F.lit(""))).alias("parts"))
    return chat.read_back(chat.format_chats(messages))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = spm.encode(table(spark, sf_dir, "documents"), model, "doc_id")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.write_and_read(table(spark, sf_dir, "documents"), vocabulary)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_edited(table(spark, sf_dir, "documents"))


#: The length of the longest n-grams of the registered query; three take more disk than its budget, see the README.
ORDER = 2


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ngram_lm.train(docs, crc_mod("doc_id", 7) != 2, ORDER)
    return ngram_lm.scores(docs, model, "doc_id").withColumn("held_out", crc_mod("doc_id", 7) == 2)


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = written(merkle.archive(table(spark, sf_dir, "pages")), "archive")
    return merkle.audit(records, merkle.damaged(records))


#: The probability of good quality from which a document counts as good.
GOOD = 0.7


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.scores(docs, model, "doc_id").select(
        "doc_id",
        (crc_mod("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


QUERIES = {
    "op1_mixing": shipped(op1_mixing),
    "op2_token_files": shipped(op2_token_files),
    "op3_fingerprints": shipped(op3_fingerprints),
    "op4_ngram_lm": shipped(op4_ngram_lm),
    "op5_warc_fixity": shipped(op5_warc_fixity),
    "op6_quality": shipped(op6_quality),
    "op7_chat": shipped(op7_chat),
    "op8_exact_dedup": shipped(op8_exact_dedup),
    "op9_near_dedup": shipped(op9_near_dedup),
    "op10_sentencepiece": shipped(op10_sentencepiece),
}

ORACLE_SQL = {
    "op5_warc_fixity": merkle.sql(),
    "op7_chat": chat.sql(),
    "op8_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
}
