"""Clustering of point chunks that keeps summaries only (discard, compression and retained sets).

Points are rows ``point_id, features``.  A cluster's summary is its count, sums and sums of squares by dimension: a
few numbers for each cluster, held by the driver.  Memberships stay in frames of ``point_id, kind, cluster``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import dropped, written


@dataclass
class Summary:
    n: float
    sums: np.ndarray
    squares: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    @property
    def sigma(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.squares / self.n - self.mean**2, 0.0))

    def __add__(self, other: Summary) -> Summary:
        return Summary(self.n + other.n, self.sums + other.sums, self.squares + other.squares)


def cluster_summary(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``cluster, dim, n, sum, sumsq, mean, std`` of points with a cluster."""
    each = assigned.select(cluster, F.posexplode(F.col("features").cast("array<double>")).alias("dim", "v"))
    sums = each.groupBy(cluster, "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum"), F.sum(F.col("v") * F.col("v")).alias("sumsq"))
    mean = F.col("sum") / F.col("n")
    return sums.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(F.col("sumsq") / F.col("n") - mean * mean, F.lit(0.0))))


def _summed(points: DataFrame, column: str, assign: Callable[[np.ndarray], np.ndarray] | None = None) -> dict[int, Summary]:
    """The summaries of clusters named by *column*, or by *assign* of the features, on the driver.

    A task adds up its points by cluster and sends clusters times dimensions, however many points.
    """
    features = F.col("features").cast("array<double>")
    rows = points.select(features.alias("features"), *([] if assign else [F.col(column).cast("int").alias("cluster")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            cluster = assign(x) if assign else batch.column(1).to_numpy()
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                held = sums.setdefault(c, [0, 0.0, 0.0])
                held[:] = held[0] + len(own), held[1] + own.sum(axis=0), held[2] + (own**2).sum(axis=0)
        for c, (n, one, two) in sums.items():
            d = len(one)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d, c, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n, np.int64)), pa.array(one), pa.array(two)],
                names=["cluster", "dim", "n", "one", "two"],
            )

    parts = rows.mapInArrow(run, "cluster int, dim int, n long, one double, two double")
    found = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"))
    table = found.toPandas().sort_values(["cluster", "dim"])
    return {int(c): Summary(float(g.n.iloc[0]), g.one.to_numpy(), g.two.to_numpy()) for c, g in table.groupby("cluster")}


def collect_summaries(assigned: DataFrame, cluster: str = "cluster") -> dict[int, Summary]:
    """The summaries of points with a cluster, on the driver."""
    return _summed(assigned, cluster)


def closest(x: np.ndarray, centres: np.ndarray, sigmas: np.ndarray | None = None, limit: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """``(number of the first nearest centre or -1, distance)`` of each row of *x*.

    With *sigmas* the distance counts in units of spread; a dimension without spread allows no deviation.
    """
    found = np.full(len(x), -1), np.full(len(x), np.inf)
    for c in range(len(centres)):
        gap = x - centres[c]
        if sigmas is not None:
            with np.errstate(divide="ignore", invalid="ignore"):
                gap = np.where(sigmas[c] > 0, gap / sigmas[c], np.where(gap == 0, 0.0, np.inf))
        d = np.sqrt((gap**2).sum(axis=1))
        better = d < found[1]
        found[0][better], found[1][better] = c, d[better]
    found[0][found[1] >= limit] = -1
    return found


def nearest(points: DataFrame, centres: np.ndarray, sigmas: np.ndarray | None = None, limit: float = np.inf) -> DataFrame:
    """*points* with ``cluster`` and ``distance`` by :func:`closest`."""

    @F.pandas_udf("cluster int, distance double")
    def find(features: pd.Series) -> pd.DataFrame:
        x = np.stack(features.to_numpy()).astype(float) if len(features) else np.zeros((0, 1))
        number, distance = closest(x, centres, sigmas, limit)
        return pd.DataFrame({"cluster": number, "distance": distance})

    return points.withColumn("__f", find("features")).select(*points.columns, F.col("__f.cluster").alias("cluster"), F.col("__f.distance").alias("distance"))


def first_points(points: DataFrame, k: int, seed: int = 200) -> list:
    """The *k* points with the smallest hashed ids: first centres."""
    return points.select("point_id", "features").orderBy(F.xxhash64("point_id", F.lit(seed)), "point_id").limit(k).collect()


def k_means(points: DataFrame, k: int, iterations: int = 3, seed: int = 200) -> DataFrame:
    """*points* with ``cluster``: the assignment of the last round, before its centres move.

    The first centres are :func:`first_points`; empty clusters vanish; ties go to the first.
    """
    first = first_points(points, k, seed)
    if not first:
        return points.withColumn("cluster", F.lit(-1))
    centres = np.array([r.features for r in first], float)
    for _ in range(iterations - 1):
        held = centres
        found = _summed(points, "", lambda x, held=held: closest(x, held)[0])
        centres = np.array([found[c].mean for c in sorted(found)])
    return nearest(points, centres).drop("distance")


def split_by_size(assigned: DataFrame, more_than: int) -> tuple[DataFrame, DataFrame]:
    """``(clustered, singles)``: points in clusters of more than *more_than*, and the others without a cluster."""
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("__n"))
    joined = assigned.join(sizes, "cluster")
    return joined.where(F.col("__n") > more_than).drop("__n"), joined.where(F.col("__n") <= more_than).drop("__n", "cluster")


@dataclass
class Bfr:
    """The state between chunks; :meth:`update` takes the next chunk.

    Summaries are on the driver; retained points and memberships are tables in the shared folder.
    """

    k: int
    iterations: int = 3
    alpha: float = 3.0
    seed: int = 200
    discard: dict[int, Summary] = field(default_factory=dict)
    compression: dict[int, Summary] = field(default_factory=dict)
    retained: DataFrame | None = None
    memberships: list[DataFrame] = field(default_factory=list)
    rounds: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    merged: dict[int, int] = field(default_factory=dict)
    fresh: int = 0

    def _limit(self, dims: int) -> float:
        return self.alpha * max(dims - 1, 1) ** 0.5

    def _take(self, assigned: DataFrame, kind: str) -> None:
        made = assigned.select("point_id", F.lit(kind).alias("kind"), F.col("cluster").cast("int").alias("cluster"))
        self.memberships.append(written(made, "bfr-members"))

    def _assign(self, points: DataFrame, sets: dict[int, Summary]) -> DataFrame:
        keys = sorted(sets)
        if not keys:
            return points.withColumn("cluster", F.lit(-1))
        means, sigmas = np.array([sets[c].mean for c in keys]), np.array([sets[c].sigma for c in keys])
        found = nearest(points, means, sigmas, self._limit(means.shape[1]))
        number = F.element_at(F.array(*[F.lit(c) for c in keys]), F.col("cluster") + 1)
        return found.withColumn("cluster", F.when(F.col("cluster") >= 0, number).otherwise(F.lit(-1))).drop("distance")

    def _compress(self, points: DataFrame, more_than: int) -> None:
        """Cluster leftovers: large clusters are compressed under fresh numbers, the rest is retained."""
        points = written(points, "bfr-left")
        grouped = written(k_means(points, 3 * self.k, self.iterations, self.seed), "bfr-grouped")
        clustered, singles = split_by_size(grouped, more_than)
        clustered = clustered.withColumn("cluster", F.col("cluster") + self.fresh)
        found = collect_summaries(clustered)
        self.compression |= found
        self._take(clustered, "compression")
        self.fresh = max([self.fresh, *(c + 1 for c in found)])
        before, self.retained = self.retained, written(singles.select("point_id", "features"), "bfr-retained")
        dropped(points, grouped, *([] if before is None else [before]))

    def _merge_compression(self) -> None:
        """Merge compressed clusters whose centres are near, nearest first."""
        while len(self.compression) > 1:
            keys = sorted(self.compression)
            best = None
            for i, a in enumerate(keys):
                for b in keys[i + 1 :]:
                    d = self._apart(self.compression[a], self.compression[b])
                    if best is None or d < best[0]:
                        best = (d, a, b)
            if best is None or best[0] >= self._limit(len(self.compression[keys[0]].sums)):
                return
            _, a, b = best
            self.compression[a] = self.compression[a] + self.compression.pop(b)
            self.merged[b] = a

    @staticmethod
    def _apart(a: Summary, b: Summary) -> float:
        return float(closest(a.mean[None, :], b.mean[None, :], b.sigma[None, :])[1][0])

    def update(self, chunk: DataFrame) -> None:
        points = chunk.select("point_id", F.col("features").cast("array<double>").alias("features"))
        if not self.discard:
            # Chunks before, if any, left points behind but no discard set.
            points = written(points if self.retained is None else points.unionByName(self.retained), "bfr-points")
            grouped = written(k_means(points, 5 * self.k, self.iterations, self.seed), "bfr-grouped")
            inside, outside = split_by_size(grouped, 3)
            inside = written(inside.drop("cluster"), "bfr-inside")
            base = written(k_means(inside, self.k, self.iterations, self.seed).where("cluster >= 0"), "bfr-base")
            self.discard = collect_summaries(base)
            self._take(base, "discard")
            self._compress(outside, 3)
            dropped(points, grouped, inside, base)
        else:
            near = written(self._assign(points, self.discard), "bfr-near")
            self._add(near, self.discard, "discard")
            left = written(self._assign(near.where("cluster = -1").drop("cluster"), self.compression), "bfr-near")
            self._add(left, self.compression, "compression")
            rest = left.where("cluster = -1").select("point_id", "features")
            self._compress(rest.unionByName(self.retained), 1)
            self._merge_compression()
            dropped(near, left)
        size = lambda sets: int(sum(s.n for s in sets.values()))
        self.rounds.append(
            (len(self.rounds) + 1, len(self.discard), size(self.discard), len(self.compression), size(self.compression), self.retained.count())
        )

    def _add(self, assigned: DataFrame, sets: dict[int, Summary], kind: str) -> None:
        taken = assigned.where("cluster >= 0")
        for c, s in collect_summaries(taken).items():
            sets[c] = sets[c] + s
        self._take(taken, kind)

    def round_table(self, spark) -> DataFrame:
        names = "round_id int, nof_cluster_discard int, nof_point_discard int, nof_cluster_compression int, nof_point_compression int, nof_point_retained int"
        return spark.createDataFrame(self.rounds, names)

    def assignment(self) -> DataFrame:
        """``point_id, cluster_id`` after compressed clusters near a discard cluster are merged into it; others are -1.

        The discard set is left as it is, so chunks may follow.
        """
        discard, home = dict(self.discard), {}
        for c in sorted(self.compression) if discard else ():
            near = min(discard, key=lambda d: (self._apart(self.compression[c], discard[d]), d))
            if self._apart(self.compression[c], discard[near]) < self._limit(len(discard[near].sums)):
                discard[near] = discard[near] + self.compression[c]
                home[c] = near
        final: dict[int, int] = {}
        for c in range(self.fresh):
            at = c
            while at in self.merged:
                at = self.merged[at]
            final[c] = home.get(at, -1)
        moved = F.element_at(F.array(*[F.lit(final[c]) for c in range(self.fresh)] or [F.lit(-1)]), F.col("cluster") + 1)
        rows = self.memberships[0]
        for m in self.memberships[1:]:
            rows = rows.unionByName(m)
        taken = rows.select("point_id", F.when(F.col("kind") == "discard", F.col("cluster")).otherwise(moved).alias("cluster_id"))
        return taken.unionByName(self.retained.select("point_id", F.lit(-1).alias("cluster_id")))

    def save(self, folder: str) -> None:
        """Write the whole state below *folder*, which must be new."""
        told = lambda sets: [[c, s.n, s.sums.tolist(), s.squares.tolist()] for c, s in sorted(sets.items())]
        content = {
            "k": self.k, "iterations": self.iterations, "alpha": self.alpha, "seed": self.seed, "fresh": self.fresh, "rounds": self.rounds,
            "discard": told(self.discard), "compression": told(self.compression), "merged": sorted(self.merged.items()),
        }
        rows = self.memberships[0]
        for m in self.memberships[1:]:
            rows = rows.unionByName(m)
        rows.write.parquet(f"{folder}/members")
        self.retained.write.parquet(f"{folder}/retained")
        # Written last: a state without it is not whole.
        spark = self.retained.sparkSession
        spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.text(f"{folder}/summary")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Bfr:
        """The state that :meth:`save` wrote; it works on tables of its own."""
        told = json.loads(spark.read.text(f"{folder}/summary").head().value)
        sets = lambda rows: {c: Summary(n, np.array(one), np.array(two)) for c, n, one, two in rows}
        state = cls(told["k"], told["iterations"], told["alpha"], told["seed"])
        state.discard, state.compression = sets(told["discard"]), sets(told["compression"])
        state.fresh, state.merged, state.rounds = told["fresh"], dict(told["merged"]), [tuple(r) for r in told["rounds"]]
        state.retained = written(spark.read.parquet(f"{folder}/retained"), "bfr-retained")
        state.memberships = [written(spark.read.parquet(f"{folder}/members"), "bfr-members")]
        return state


def run(chunks: list[DataFrame], k: int, **options) -> Bfr:
    """All chunks, one after another; at least one."""
    state = Bfr(k, **options)
    for chunk in chunks:
        state.update(chunk)
    return state
