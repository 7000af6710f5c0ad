"""Content recommendation: TF-IDF word profiles and their cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import PUNCTUATION_MORE
from tessera.operators.stats import top_per_group, word_counts
from tessera.storage import written


def tf_idf(docs: DataFrame, item: str, text: str, stop: DataFrame | None = None, rare: float = 1e-4) -> DataFrame:
    """``item, word, score`` of words that make up more than *rare* of all words.

    tf is a word's count over the item's largest count (rare words included); idf is log2(items / items with the
    word); an item is any value of *item*, with or without words.
    """
    # Three aggregates read it: the texts are cut once.
    counted = written(word_counts(docs, text, stop, PUNCTUATION_MORE, item), "word-counts")
    by_word = counted.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total"))
    # One-row frames: the number of items, and of words.
    items = docs.agg(F.count_distinct(item).alias("n_items"))
    every = counted.agg(F.sum("n").alias("n_words"))
    kept = (
        by_word.crossJoin(F.broadcast(every))
        .where(F.col("total") > F.col("n_words") * rare)
        .crossJoin(F.broadcast(items))
        .select("word", F.log2(F.col("n_items") / F.col("df")).alias("idf"))
    )
    tf = counted.withColumn("tf", F.col("n") / F.max("n").over(Window.partitionBy(item)))
    return tf.join(kept, "word").select(item, "word", (F.col("tf") * F.col("idf")).alias("score"))


def item_profiles(scores: DataFrame, item: str, k: int = 200) -> DataFrame:
    """``item, words``: the *k* best words, ties by word."""
    top = top_per_group(scores, item, k, F.desc("score"), F.col("word"))
    ranked = F.sort_array(F.collect_list(F.struct("rank", "word")))
    return top.groupBy(item).agg(ranked.alias("r")).select(item, F.col("r.word").alias("words"))


def user_profiles(reviews: DataFrame, profiles: DataFrame, user: str, item: str) -> DataFrame:
    """``user, words``: all words of the items reviewed; items without a profile add none."""
    seen = reviews.select(user, item).distinct().join(profiles, item, "left")
    each = seen.select(user, F.explode_outer("words").alias("word"))
    return each.groupBy(user).agg(F.sort_array(F.collect_set("word")).alias("words"))


def model_rows(items: DataFrame, users: DataFrame, item: str, user: str) -> DataFrame:
    """Both kinds of profile as ``type, profile_id, profile_vector``, to be written as JSON lines."""
    row = lambda df, kind, key: df.select(
        F.lit(kind).alias("type"), F.col(key).cast("string").alias("profile_id"), F.col("words").alias("profile_vector")
    )
    return row(items, "business_profile", item).unionByName(row(users, "user_profile", user))


def cosine(pairs: DataFrame, users: DataFrame, items: DataFrame, user: str, item: str, threshold: float = 0.01) -> DataFrame:
    """``user, item, sim`` of pairs with at least *threshold*; a missing or empty profile has similarity 0."""
    none = F.array().cast("array<string>")
    both = (
        pairs.join(users.withColumnRenamed("words", "__u"), user, "left")
        .join(items.withColumnRenamed("words", "__i"), item, "left")
        .select(user, item, F.coalesce("__u", none).alias("u"), F.coalesce("__i", none).alias("i"))
    )
    size = F.sqrt(F.size("u").cast("double")) * F.sqrt(F.size("i").cast("double"))
    sim = F.coalesce(F.try_divide(F.size(F.array_intersect("u", "i")).cast("double"), size), F.lit(0.0))
    return both.select(user, item, sim.alias("sim")).where(F.col("sim") >= threshold)
