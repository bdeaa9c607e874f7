"""Checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What released() has open: the paths that were handed out since, one list a block.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder set by setCheckpointDir(). Where neither is set a local session gets a folder
    of its own; any other is refused, since its executors could not read what the driver's disk holds."""
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def in_block() -> bool:
    """Whether what is written now goes at the end of a released() block."""
    return bool(_OPEN)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nobody has. What is written there goes at the end of the enclosing released()
    block, or else when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut, and it survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, "kept")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what queries put into the shared folder within it; results have to be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            fs, at = _hadoop(spark, path)
            fs.delete(at, True)
