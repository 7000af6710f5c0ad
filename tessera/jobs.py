"""Whole jobs from files to files, one for each entry point: sources, operators and sinks put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import year_of
from tessera.operators import bfr, cf, content, encode, itemsets, lsh, metrics, stats
from tessera.sources import readers, writers
from tessera.storage import written
from tessera.streaming.chunks import cluster_files

ITEM_PARAMS, USER_PARAMS = lsh.hash_params(24), lsh.hash_params(40, 29)


def review_statistics(spark: SparkSession, reviews: str, output: str, stop_words: str, year: int, users: int, words: int) -> dict:
    """Counts, top users and top words of a review file, written as one JSON document."""
    rows = readers.reviews(spark, reviews)
    counts = stats.review_counts(rows, "user_id", year_of("date") == year)
    report = writers.review_report(
        counts, stats.top_counts(rows, "user_id", users), stats.top_words(rows, words, stop=readers.stop_words(spark, stop_words)).select("word")
    )
    writers.document(output, report)
    return report


def category_averages(spark: SparkSession, reviews: str, businesses: str, output: str, n: int) -> dict:
    """The *n* categories with the best average, written as one JSON document."""
    rated = readers.reviews(spark, reviews).select("business_id", "stars")
    found = stats.category_average(rated, readers.businesses(spark, businesses), "business_id", "stars")
    report = {"result": [[r.category, r.avg_stars] for r in found.orderBy(F.desc("avg_stars"), "category").limit(n).collect()]}
    writers.document(output, report)
    return report


def partition_report(spark: SparkSession, reviews: str, output: str, n: int, partitions: int | None = None) -> dict:
    """Partition sizes, and businesses with over *n* reviews; given *partitions*, rows are dealt by the id's first character."""
    rows = readers.reviews(spark, reviews).select("business_id")
    if partitions:
        rows = stats.partitioned(rows, F.ascii("business_id"), partitions)
    sizes = [r.n for r in stats.physical_partition_sizes(rows).orderBy("partition").collect()]
    many = stats.key_count_threshold(rows, "business_id", n).orderBy("business_id")
    report = {"n_partitions": len(sizes), "n_items": sizes, "result": [[r[0], r[1]] for r in many.collect()]}
    writers.document(output, report)
    return report


def extract_state(spark: SparkSession, reviews: str, businesses: str, output: str, state: str = "NV", user: str = "review_id") -> None:
    """Reviews of one state's businesses as a headered CSV of two columns, ``user_id`` being the column *user*."""
    chosen = readers.businesses(spark, businesses).where(F.col("state") == state).select("business_id").distinct()
    rows = stats.in_selected(readers.reviews(spark, reviews).select(F.col(user).alias("user_id"), "business_id"), "business_id", chosen)
    writers.csv(rows.select("user_id", "business_id"), output)


def frequent_sets(spark: SparkSession, baskets: str, output: str, support: int, case: int = 1, more_than: int | None = None) -> dict:
    """Candidates and frequent itemsets of a basket file, written as a report; seconds of each step."""
    seconds: dict[str, float] = {}
    with writers.timed(seconds, "itemsets"):
        rows = readers.basket_csv(spark, baskets, swap=case != 1)
        if more_than is not None:
            large = itemsets.baskets(rows, more_than).select("basket")
            rows = rows.join(large, "basket", "left_semi")
        candidates, found = itemsets.son(rows, support)
        found = written(found, "itemsets")
    with writers.timed(seconds, "report"):
        writers.write_itemset_report(output, candidates, found)
    return seconds


def jaccard_pairs(spark: SparkSession, reviews: str, output: str, threshold: float = 0.05, bands: int = 24) -> None:
    """Pairs of businesses with similar users, found by MinHash and verified, as ``b1, b2, sim``."""
    members = readers.reviews(spark, reviews).select(F.col("business_id").alias("id"), "user_id").distinct()
    index = encode.dense_index(members, "user_id")
    numbered = written(members.join(index, "user_id").select("id", F.col("idx").alias("x")), "members")
    near = lsh.candidates(lsh.signatures(numbered, ITEM_PARAMS, index.count()), bands)
    writers.json_lines(_model(lsh.jaccard(numbered, threshold, near), "b1", "b2"), output)


def train_profiles(spark: SparkSession, reviews: str, model: str, stop_words: str) -> None:
    """Word profiles of businesses and users, as rows of ``type, profile_id, profile_vector``."""
    rows = readers.reviews(spark, reviews)
    scores = content.tf_idf(rows, "business_id", "text", readers.stop_words(spark, stop_words))
    items = written(content.item_profiles(scores, "business_id"), "profiles")
    users = content.user_profiles(rows, items, "user_id", "business_id")
    writers.json_lines(content.model_rows(items, users, "business_id", "user_id"), model)


def predict_by_profiles(spark: SparkSession, pairs: str, model: str, output: str) -> None:
    """``user_id, business_id, sim`` of the pairs of a review file whose profiles are alike."""
    wanted = readers.reviews(spark, pairs).select("user_id", "business_id").distinct()
    users = readers.profiles(spark, model, "user_profile").withColumnRenamed("id", "user_id")
    items = readers.profiles(spark, model, "business_profile").withColumnRenamed("id", "business_id")
    writers.json_lines(content.cosine(wanted, users, items, "user_id", "business_id"), output)


def _ratings(spark: SparkSession, reviews: str) -> DataFrame:
    """``user, item, stars`` of a review file; of several, the latest by date."""
    rows = readers.reviews(spark, reviews).select(F.col("user_id").alias("user"), F.col("business_id").alias("item"), "stars", "date", "review_id")
    return cf.latest(rows, "date", "review_id")


def _model(pairs: DataFrame, one: str, two: str) -> DataFrame:
    return pairs.select(F.col("a").alias(one), F.col("b").alias(two), "sim")


def train_ratings(spark: SparkSession, reviews: str, model: str, by_items: bool = True) -> None:
    """The Pearson model of items as ``b1, b2, sim``, or that of users as ``u1, u2, sim``."""
    ratings = written(_ratings(spark, reviews), "ratings")
    if by_items:
        writers.json_lines(_model(cf.item_model(ratings), "b1", "b2"), model)
    else:
        index = encode.dense_index(ratings, "item")
        found = cf.user_model(ratings, index, USER_PARAMS, index.count(), len(USER_PARAMS) - 1)
        writers.json_lines(_model(found, "u1", "u2"), model)


def predict_ratings(spark: SparkSession, train: str, test: str, model: str, output: str, by_items: bool = True) -> None:
    """``user_id, business_id, stars`` of the test file's pairs whose user and item are in the training file."""
    ratings = written(_ratings(spark, train), "ratings")
    wanted = readers.reviews(spark, test).select(F.col("user_id").alias("user"), F.col("business_id").alias("item"))
    if by_items:
        found = cf.item_predict(wanted, ratings, readers.item_model(spark, model))
    else:
        found = cf.user_predict(wanted, ratings, readers.user_model(spark, model))
    writers.json_lines(found.select(F.col("user").alias("user_id"), F.col("item").alias("business_id"), "stars"), output)


def cluster_points(spark: SparkSession, folder: str, k: int, assignment: str, rounds: str, states: str) -> bfr.Bfr:
    """Cluster a folder of point files; write ``{point: cluster}`` and the table of rounds."""
    state = cluster_files(spark, folder, states, k)
    writers.write_assignment(assignment, state.assignment())
    writers.csv(state.round_table(spark).coalesce(1), rounds)
    return state


def evaluate(spark: SparkSession, found: str, truth: str) -> dict:
    """Normalized mutual information of two label files, and the sizes of their clusters, largest first."""
    one, other = readers.labels(spark, found), readers.labels(spark, truth)
    sizes = lambda x: [[r.label, r.n] for r in metrics.cluster_sizes(x).collect()]
    return {"nmi": metrics.nmi(one, other).head().nmi, "found": sizes(one), "truth": sizes(other)}
