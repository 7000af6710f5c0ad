"""Helpers shared by the training-data operators: shared storage and table access."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import size_of, spread  # noqa: F401
from tessera.storage import ROW_GROUP, dropped, new_path, shared_dir, written  # noqa: F401

#: A word is a maximal run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a table's part, where the session's number of shuffle partitions would make smaller ones.
PART_BYTES = 64 << 20
#: The same of texts that a task sorts.
SORTED_BYTES = 16 << 20


def parts_of(df: DataFrame, size: int = PART_BYTES) -> int:
    """Parts for tables about as large as *df*: of *size* bytes, but two a core, and no more than a shuffle makes.

    Sizes are the optimizer's estimates; they decide the layout of files only.
    """
    spark = df.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * spark.sparkContext.defaultParallelism, min(math.ceil(size_of(df) / size), shuffled))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(docs[column], F.lit(""))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column's decimal text, modulo *modulus*; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def meet(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join by sorted shuffles.

    Spark takes sizes after an explode, an Arrow function or a list's aggregate from the row before, and those of tables
    from compressed files: it would broadcast through the driver what is many times as large as it seems.
    """
    return left.join(right.hint("merge"), on, how)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """Join *rows* to the one row that *groups* has for their *key* (never null), without a task for a hot group's rows.

    *size* counts a group's rows among *total*.  At most *share* groups can hold over a *share*-th of the rows each;
    those, and no others, are broadcast.  Rows without a group keep nulls.
    """
    rest = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) * share > total).select(
        F.col(key).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in rest]
    )
    cold = groups.select(F.col(key).alias("__cold"), *[F.col(c).alias(f"__cold_{c}") for c in rest])
    filler, kind = F.xxhash64(*rows.columns), dict(groups.dtypes)[key]
    if kind in ("string", "binary"):
        filler = F.hex(filler) if kind == "string" else F.unhex(F.hex(filler))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    marked = marked.withColumn("__key", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(filler))
    return meet(marked, cold, F.col("__key") == F.col("__cold"), "left").select(
        *rows.columns, *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in rest]
    )


def join_held(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """The rows whose *key* is in *groups*, with the columns of its one row there, as :func:`join_groups` keeps hot groups apart.

    *groups* is a table, as it is read several times; *size* is left out of the result.
    """
    # Fewer than *share* groups hold over a *share*-th of the rows each, so the list is bounded.
    hot = [r[0] for r in groups.where(F.col(size) * share > total).select(key).collect()]
    slim = groups.drop(size)
    if not hot:
        return meet(rows, slim, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(is_hot).join(F.broadcast(slim.where(is_hot)), key).unionByName(meet(rows.where(~is_hot), slim.where(~is_hot), key))
