"""Tables written between steps, in the folder that the cluster shares.

The folder is ``spark.checkpoint.dir``. Where it is unset the session must be local (tests), and a
temporary folder is set. A staged table cuts lineage like ``checkpoint()`` but computes its input once,
and a lost executor costs nothing: the files are on shared storage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only in a local session without it."""
    path = spark.conf.get(_SETTING, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="evidra-")
    spark.conf.set(_SETTING, path)
    return path


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 whole texts, so that a Python worker and its buffers stay small; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 2000:
        spark.conf.set(name, "2000")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/evidra/{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end; what is to stay has to be written inside to a place of its own."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(spark, parent)
