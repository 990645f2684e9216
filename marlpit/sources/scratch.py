"""Folders for intermediate tables, which all executors must see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str = "scratch") -> str:
    """A new path in the session's checkpoint folder. On one machine, as in tests, a temporary folder will do; a cluster must name a shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="scratch-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table written once and read again, for results that several plans use."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder in whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function like :func:`kept`, whose tables are deleted at the end of the block; what leaves it must not read them."""
    folder = new_folder(spark)

    def held(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield held
    finally:
        remove(spark, folder)
