"""Clustering of point files: a folder's files in order of their names, or a stream of them, both fit for restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.bfr import Bfr
from tessera.sources.readers import chunk_files, points_csv, points_of_lines


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def _state(spark: SparkSession, states: str, k: int, upto: int) -> tuple[int, Bfr]:
    """The last whole state of at most *upto* chunks: ``(chunks taken, state)``."""
    for n in range(upto, 0, -1):
        if _exists(spark, f"{states}/{n}/summary/_SUCCESS"):
            return n, Bfr.load(spark, f"{states}/{n}")
    return 0, Bfr(k)


def _saved(spark: SparkSession, state: Bfr, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    state.save(folder)


def cluster_files(spark: SparkSession, folder: str, states: str, k: int) -> Bfr:
    """Take the files of *folder* in order of their names, one chunk each.

    After each chunk the state is saved below *states*; a run that is started again goes on after the last of them.
    Files must not be added before ones already taken.
    """
    files = chunk_files(spark, folder)
    taken, state = _state(spark, states, k, len(files))
    for n, path in enumerate(files[taken:], taken + 1):
        state.update(points_csv(spark, path))
        _saved(spark, state, f"{states}/{n}")
    return state


def cluster_stream(spark: SparkSession, folder: str, states: str, checkpoint: str, k: int) -> StreamingQuery:
    """Start a query that takes each new file of *folder* as a chunk, in order of arrival, and ends when all are read.

    The state after batch *n* is saved below *states* under *n* + 1: a batch that comes again, after a restart too, starts
    from the state before it.
    """

    def update(batch: DataFrame, number: int) -> None:
        if _exists(spark, f"{states}/{number + 1}/summary/_SUCCESS"):
            return
        _, state = _state(spark, states, k, number)
        state.update(points_of_lines(batch))
        _saved(spark, state, f"{states}/{number + 1}")

    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(folder)
    return lines.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_state(spark: SparkSession, states: str, batches: int, k: int) -> Bfr:
    """The state after *batches* batches."""
    return _state(spark, states, k, batches)[1]
