"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Three stages, each grouping by the *full text* beside its digest, so a digest collision can never merge two texts:

1. local: the partial aggregate of stage 2 collapses equal texts inside a task;
2. salted: one row per (text, task) meets in ``salts`` groups per text, the salt being the task's number;
3. global: at most ``salts`` winners per text are combined.

A text that makes up a third of all rows therefore reaches any task as one row per upstream task and salt.
Texts are not shuffled again to map rows to their group: digests are joined, narrow on both sides; groups that hold
over a thousandth of all rows, at most a thousand, are broadcast instead.  The digests are known by then to stand for one text each; one
that covered two texts would stop the job, never merge them.

Null texts count as empty.  Rows with equal text and equal ``doc_id`` are copies of one row: all are reported
with the same ``keep_id``, and ``survivors`` returns one of them.  Null ids sort below every other id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SORTED_BYTES, join_groups, parts_of, text_of, written

SALTS = 32
HOT = 1000


def groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: ``text_sha256, text, keep_id, group_size, collides``."""
    text = text_of(docs)
    rows = docs.select(
        F.sha2(text, 256).alias("text_sha256"),
        text.alias("text"),
        F.col("doc_id"),
        (F.spark_partition_id() % salts).alias("_salt"),
    )
    salted = rows.groupBy("text_sha256", "_salt", "text").agg(
        F.max("doc_id").alias("_max"), F.count(F.lit(1)).alias("_n")
    )
    return salted.groupBy("text_sha256", "text").agg(
        F.max("_max").alias("keep_id"), F.sum("_n").alias("group_size")
    )


def assignments(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    won = groups(docs, salts)
    classes = won.groupBy("text_sha256").agg(
        F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
        F.count(F.lit(1)).alias("_texts"),
    )
    sound = classes.select(
        "text_sha256",
        F.when(F.col("_texts") > 1, F.raise_error(F.concat(F.lit("two texts share digest "), "text_sha256")).cast("bigint"))
        .otherwise(F.col("keep_id"))
        .alias("keep_id"),
        "group_size",
    )
    # One narrow row for each text, which is read twice; the texts are moved for it once.
    sound = written(sound, "exact-groups")
    rows = docs.select(F.col("doc_id"), F.sha2(text_of(docs), 256).alias("text_sha256"))
    total = sound.agg(F.sum("group_size")).head()[0] or 0
    # At most HOT groups can hold a HOT-th of all rows each: those are broadcast, so no task gets a hot digest's rows.
    return join_groups(rows, sound, "text_sha256", "group_size", total, HOT).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def survivors(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns; of copies of one row, any one.

    Whole rows go through the salted and the global stage, so a group's winner comes out of them without a join.
    """
    names = docs.columns
    others = [F.col(c).alias(f"c{i}") for i, c in enumerate(names) if c != "text"]
    rows = docs.select(
        F.unhex(F.sha2(text_of(docs), 256)).alias("_digest"),
        text_of(docs).alias("_text"),
        # A struct is never null, so null ids compete, too, below all others.
        F.struct(F.col("doc_id").alias("id")).alias("_id"),
        F.struct(F.col("text").isNull().alias("null_text"), *others).alias("_row"),
        (F.spark_partition_id() % salts).alias("_salt"),
    )
    best = [F.max_by("_row", "_id").alias("_row"), F.max("_id").alias("_id")]
    stays = rows.groupBy("_digest", "_salt", "_text").agg(*best).groupBy("_digest", "_text").agg(*best)
    back = [F.when(~F.col("_row.null_text"), F.col("_text")).alias(c) if c == "text" else F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)]
    return stays.select(*back).coalesce(parts_of(docs, SORTED_BYTES))
