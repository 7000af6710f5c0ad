"""Tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group: what a task holds while it writes, and reads at a time.
ROW_GROUP = 8 << 20
_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one where it is unset, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="tessera-shared-"))
    return _FALLBACK[0]


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
    """Cut lineage: write *df* as Parquet to the shared folder, in at most *files* parts, and read it back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    (df.coalesce(files) if files else df).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` made, once nothing refers to them."""
    for df in tables:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(df._tessera_path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
