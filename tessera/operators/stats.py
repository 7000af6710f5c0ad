"""Review statistics: counts, top-k, averages, thresholds, semi-joins and partition sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import PUNCTUATION, comma_list, pieces
from tessera.session import spread


def review_counts(reviews: DataFrame, user: str, in_year: Column) -> DataFrame:
    """One row: ``n_reviews, n_in_year, n_users``, in one pass."""
    return reviews.agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count_if(in_year).alias("n_in_year"),
        F.count_distinct(user).alias("n_users"),
    )


def top_counts(df: DataFrame, key: str, k: int) -> DataFrame:
    """The *k* most frequent keys, ties by key: ``key, n``."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def word_counts(docs: DataFrame, text: str = "text", stop: DataFrame | None = None, punctuation: str = PUNCTUATION, *keys: str) -> DataFrame:
    """``[keys,] word, n`` without stop words.  Words are counted before the anti-join, which then sees few rows."""
    each = spread(docs).select(*keys, F.explode(pieces(text, punctuation)).alias("word")).where("word <> ''")
    counted = each.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(stop, "word", "left_anti") if stop is not None else counted


def top_words(docs: DataFrame, k: int, text: str = "text", stop: DataFrame | None = None) -> DataFrame:
    return word_counts(docs, text, stop).select("word", "n").orderBy(F.desc("n"), "word").limit(k)


def category_average(ratings: DataFrame, items: DataFrame, item: str, stars: str, categories: Column | None = None) -> DataFrame:
    """``category, avg_stars`` weighted by review, to one digit.

    *ratings* are summed by item before the join, so the join sees one row an item.  Items repeated in *items* count
    once; a category named twice by an item counts twice; null and empty lists have no category.
    """
    listed = categories if categories is not None else F.when(F.col("categories") != "", comma_list("categories"))
    per_item = ratings.groupBy(item).agg(F.sum(stars).alias("s"), F.count(F.lit(1)).alias("n"))
    named = items.dropDuplicates([item]).select(item, F.explode(listed).alias("category"))
    both = named.join(per_item, item)
    return both.groupBy("category").agg(F.round(F.sum("s") / F.sum("n"), 1).alias("avg_stars"))


def key_count_threshold(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keys with more than *n* rows: ``key, n``."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n)


def partition_sizes(df: DataFrame, key: str, n: int, prefix: int | None = 1) -> DataFrame:
    """Rows by partition when keys are dealt out by their first *prefix* characters' code, or by the whole key.

    Empty partitions are reported too: ``partition, n``.
    """
    text = F.col(key).cast("string")
    code = F.ascii(text) if prefix == 1 else F.pmod(F.xxhash64(F.substring(text, 1, prefix) if prefix else text), F.lit(1 << 31))
    sizes = df.groupBy((code % n).cast("int").alias("partition")).agg(F.count(F.lit(1)).alias("n"))
    numbers = df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition"))
    return numbers.join(sizes, "partition", "left").select("partition", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def partitioned(df: DataFrame, number: Column, n: int) -> DataFrame:
    """*df* dealt to *n* partitions: a row goes to partition *number* modulo *n*, nulls to the first."""
    return df.repartitionById(n, F.coalesce(F.pmod(number.cast("long"), F.lit(n)), F.lit(0)).cast("int"))


def physical_partition_sizes(df: DataFrame) -> DataFrame:
    """Rows in each partition the frame has as it stands, empty ones too: ``partition, n``."""
    sizes = df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n"))
    numbers = df.sparkSession.range(df.rdd.getNumPartitions()).select(F.col("id").cast("int").alias("partition"))
    return numbers.join(sizes, "partition", "left").select("partition", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def in_selected(df: DataFrame, key: str, selected: DataFrame) -> DataFrame:
    """Rows of *df* whose key is among *selected*."""
    return df.join(selected, key, "left_semi")


def top_per_group(df: DataFrame, group: str, k: int, *order: Column | str) -> DataFrame:
    """The first *k* rows of each group with their ``rank``; groups are cut before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
