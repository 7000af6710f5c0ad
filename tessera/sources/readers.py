"""Scans: JSON lines, CSV, text, point chunks, label files and saved models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera import schemas


def json_lines(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """One record a line; a bad line stops the job unless *strict* is false."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def reviews(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.REVIEW)


def businesses(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.BUSINESS)


def basket_csv(spark: SparkSession, path: str, swap: bool = False, partitions: int | None = None) -> DataFrame:
    """A headered two-column CSV as ``basket, item``; *swap* takes the second column for the basket."""
    rows = spark.read.option("header", True).schema("c0 string, c1 string").csv(path)
    basket, item = ("c1", "c0") if swap else ("c0", "c1")
    out = rows.select(F.col(basket).alias("basket"), F.col(item).alias("item"))
    return out.repartition(partitions) if partitions else out


def points_of_lines(lines: DataFrame) -> DataFrame:
    """``point_id, features`` of lines of an integer id and numbers; numbers are cast, never evaluated."""
    parts = F.split("value", ",")
    numbers = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: F.trim(x).cast("double"))
    return lines.select(F.trim(parts[0]).cast("long").alias("point_id"), numbers.alias("features"))


def points_csv(spark: SparkSession, path: str) -> DataFrame:
    """Points in files of comma-separated lines without header."""
    return points_of_lines(spark.read.text(path))


def chunk_files(spark: SparkSession, folder: str) -> list[str]:
    """The files of a folder in order of their names: chunks that are processed one after another."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(folder).select("path")
    return sorted(r.path for r in listed.collect())


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """``word``, one a line, without white space around it."""
    return spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("word")).distinct()


def item_model(spark: SparkSession, path: str) -> DataFrame:
    """``a, b, sim`` with a < b, one row a pair; a pair given twice stops the job."""
    return _model(spark.read.schema(schemas.ITEM_MODEL).json(path), "b1", "b2")


def user_model(spark: SparkSession, path: str) -> DataFrame:
    return _model(spark.read.schema(schemas.USER_MODEL).json(path), "u1", "u2")


def _model(rows: DataFrame, one: str, two: str) -> DataFrame:
    pairs = rows.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), "sim")
    once = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.count(F.lit(1)).alias("n"))
    twice = F.raise_error(F.concat(F.lit("the model has a pair twice: "), F.col("a"), F.lit(", "), F.col("b"))).cast("double")
    return once.select("a", "b", F.when(F.col("n") > 1, twice).otherwise(F.col("sim")).alias("sim"))


def profiles(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``id, words`` of the profiles of one type: ``business_profile`` or ``user_profile``."""
    rows = spark.read.schema(schemas.PROFILE_MODEL).json(path)
    return rows.where(F.col("type") == kind).select(F.col("profile_id").alias("id"), F.col("profile_vector").alias("words"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """``point_id, label`` from a file that is one JSON object."""
    whole = spark.read.option("wholetext", True).text(path)
    pairs = whole.select(F.explode(F.from_json("value", "map<string,int>")))
    return pairs.select(F.col("key").cast("long").alias("point_id"), F.col("value").alias("label"))
