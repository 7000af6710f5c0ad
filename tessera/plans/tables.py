"""The driver's tables in the roles of the operators' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words left out of the word counts; a list of this module's choosing.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "la", "de", "le", "les", "des", "et", "en", "der", "die", "das", "und", "el", "que", "los")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stop_words(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in STOP_WORDS])).alias("word"))


def order_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user, item, stars``: customers rate suppliers by quantity; of several, the largest."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("item"), F.col("l_quantity").alias("stars"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("user", "item").agg(F.max("stars").alias("stars"))


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user, item, stars, day, l_orderkey, l_linenumber``: every rating, several a user and item."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user"), F.col("o_orderdate").cast("timestamp").alias("day"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("item"), F.col("l_quantity").alias("stars"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("user", "item", "stars", "day", "l_orderkey", "l_linenumber")


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user, item, stars, ts, event_id``: every event's value folded to 1 to 5."""
    stars = (F.floor("value") % 5 + 1).cast("double")
    item = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("user"), item.alias("item"), stars.alias("stars"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user, item, value`` of events: the item is the number in ``props``."""
    events = read(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("long").alias("item"), "value")


def event_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user, item, stars``: events' values folded to 1 to 5; of several, the largest."""
    stars = (F.floor("value") % 5 + 1).cast("double")
    return event_pairs(spark, sf_dir).groupBy("user", "item").agg(F.max(stars).alias("stars"))


def order_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item, user``: which customers each supplier served."""
    return order_ratings(spark, sf_dir).select("item", "user")


def line_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``basket, item``: suppliers by order."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("basket"), F.col("l_suppkey").cast("string").alias("item"))


def event_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_pairs(spark, sf_dir).select(F.col("user").alias("basket"), F.col("item").cast("string").alias("item"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("features"), "label")
