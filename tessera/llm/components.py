"""Connected components of an edge table, by least labels with pointer jumping; of few edges, at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import dropped, join_held, meet, written

#: Edges that one task joins in its memory, some 50 MB.  Rounds over as few rows take a moment each, and the driver keeps
#: a thread for a minute for every shuffle and broadcast: hundreds of them, where many rounds follow each other.
AT_ONCE = 100_000


def _at_once(edges: DataFrame) -> DataFrame:
    """The same as :func:`components`, by one task."""
    kind = edges.schema["a"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, of = {}, None

        def find(x):  # noqa: ANN001, ANN202
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for batch in batches:
            of = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        if root:
            yield pa.RecordBatch.from_arrays([pa.array(list(root), of), pa.array([find(x) for x in list(root)], of)], names=["node", "label"])

    return edges.coalesce(1).mapInArrow(run, T.StructType([T.StructField("node", kind), T.StructField("label", kind)]))


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """From edges ``a, b``: ``node, label`` for each node in them, the label being the least node it can reach.

    Edges and labels stay in tables; each round they are rewritten to the shared folder.  Labels halve their distance
    to the least node each round, so rounds grow with the logarithm of the longest path.  Loops count as edges.
    A hub's edges, and the nodes of a large class, are not gathered: what they look up has one row, which is broadcast
    for the few keys that hold over a thousandth of all rows.
    """
    once = written(edges.select("a", "b").distinct(), "cc-once", files)
    if once.count() <= AT_ONCE:
        labels = written(_at_once(once), "cc-labels")
        dropped(once)
        return labels
    both = written(once.union(once.select("b", "a")).distinct(), "cc-edges", files)
    dropped(once)
    first = F.least(F.min("b"), F.col("a"))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(first.alias("label"), F.count(F.lit(1)).alias("degree")), "cc-labels", files)
    n_edges, n_nodes = both.count(), labels.count()
    while True:
        near = (
            join_held(both, labels.withColumnRenamed("node", "b"), "b", "degree", n_edges)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("__near"))
        )
        stepped = written(
            meet(labels, near, "node").select("node", "degree", F.col("label").alias("__old"), F.least("label", "__near").alias("__to")), "cc-steps", files
        )
        held = stepped.groupBy("__to").agg(F.count(F.lit(1)).alias("__n"))
        ahead = written(meet(labels.select(F.col("node").alias("__to"), F.col("label").alias("__next")), held, "__to"), "cc-ahead", files)
        moved = written(
            join_held(stepped, ahead, "__to", "__n", n_nodes).select("node", "degree", "__old", F.least("__to", "__next").alias("label")), "cc-labels", files
        )
        dropped(stepped, ahead, labels)
        labels = moved.select("node", "label", "degree")
        labels._tessera_path = moved._tessera_path
        if moved.where("__old <> label").isEmpty():
            dropped(both)
            return labels.select("node", "label")
