"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows of one 8-byte key that may be broadcast: 8 MB of keys.
BROADCAST_ROWS = 1_000_000
#: Rows of a file, of tables whose number of rows is known.
FILE_ROWS = 20_000


def named_folder(spark: SparkSession) -> str | None:
    """The session's checkpoint folder."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def on_one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; on one machine, where none is set, as in tests, a temporary one."""
    found = named_folder(spark)
    if not found:
        if not on_one_machine(spark):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as it takes for no column of ``df`` to begin with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder in whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: The folder of the innermost :func:`scope` of this thread.
_inner: ContextVar[str | None] = ContextVar("_inner", default=None)


#: Has Spark delete the shuffle files of a query when it ends, not when the driver's memory is next swept.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The groups, as a power of two, that a task looks up in its generated hash table; all others take a second, slower look-up for each row.
FAST_GROUPS = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A block for which a setting of the session holds."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _put(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder}/table-{uuid.uuid4().hex}"
    spark = df.sparkSession
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _gathered(df: DataFrame, rows: int | None, each: int) -> DataFrame:
    return df if rows is None else df.coalesce(max(1, -(-rows // each)))


def written(df: DataFrame, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
    """``df`` as a table written in the shared folder and read again: lineage ends there, whichever executor is lost. Within a
    :func:`scope` it is deleted at that one's end. ``rows``: as many as it has at most, of which a task then writes about ``each``, so that
    a small table isn't a file and a task for each partition of a shuffle."""
    return _put(_gathered(df, rows, each), _inner.get() or shared_folder(df.sparkSession))


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """A block at whose end all tables :func:`written` in it are deleted, whether it fails or not. It gives a function that writes a
    table to outlast the block, as :func:`written` does; all else that leaves the block must not read its tables."""
    outer = _inner.get() or shared_folder(spark)
    folder = f"{outer}/scope-{uuid.uuid4().hex}"
    token = _inner.set(folder)
    try:
        yield lambda df, rows=None, each=FILE_ROWS: _put(_gathered(df, rows, each), outer)
    finally:
        _inner.reset(token)
        remove(spark, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function like :func:`written`, whose tables are deleted at the end of the block; what leaves it must not read them."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def kept(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield kept
    finally:
        remove(spark, folder)
