"""Evaluation of clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nmi(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row, ``nmi``: normalized mutual information of two labelings ``point_id, label``, over the mean entropy.

    Points must be the same in both; points of only one are left out.  Two labelings of one cluster each agree fully.
    """
    both = one.select("point_id", F.col("label").alias("a")).join(other.select("point_id", F.col("label").alias("b")), "point_id")
    cells = both.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # Windows over the contingency table, which has a cell for each pair of clusters.
    p = cells.select(
        "a", "b", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"),
    ).withColumns({"pa": F.sum("p").over(Window.partitionBy("a")), "pb": F.sum("p").over(Window.partitionBy("b"))})
    entropy = lambda name: -F.sum(F.col("p") * F.log(name))
    sums = p.agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"), entropy("pa").alias("ha"), entropy("pb").alias("hb"))
    return sums.select(F.coalesce(F.try_divide(F.col("mi"), (F.col("ha") + F.col("hb")) / 2), F.lit(1.0)).alias("nmi"))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """``label, n``, largest first; one row a cluster."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")
