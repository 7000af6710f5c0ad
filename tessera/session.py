"""Session settings and shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are written for; all can be changed at run time.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
#: What bounds a task's memory where texts are long: bytes of a batch sent to Python, and of a row group held by a writer
#: and read at a time.  A session's own settings stay.
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "parquet.block.size": str(8 << 20)}

#: Bytes of inputs that a few tasks may get for themselves.
SMALL = 16 << 20


def size_of(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's bytes; it decides layouts only."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """*df* dealt to all cores if it is small, as one file is that only one task would read; others stay as they are."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size_of(df) < SMALL else df


_shipped: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application."""
    for key, value in BOUNDS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(root):  # it came as an archive, as do the workers' copies
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("tessera", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query whose workers can import this package."""

    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship_package(spark)
        return query(spark, *args)

    return run
