"""Tables kept by key that are written by changes alone: logs in hash buckets, merged when read, compacted now and then.

A batch writes only the buckets of its keys, under a generation of its own; deleted keys stay as marked rows. A read takes the last row of
each key of all generations, so a batch that is written again, or an old file that a stopped compaction has left, changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlpit.functions.scalar import col
from marlpit.operators.store import latest
from marlpit.sources.scratch import remove

BUCKET, GENERATION, DELETED = "_bucket", "_generation", "_deleted"
#: Generations of a batch: its own, and those that are made of it and older ones before the next comes.
EACH = 1000


class KeyedTable:
    """The last row of each key, under ``path``.

    ``order`` columns say which of two rows of a key is the later one, whatever the order in which they came; of equal ones that of the later batch
    counts, and of one batch the greatest. A deletion is a row too: a row that came late, but is older, doesn't bring the key back.
    ``bucket_by`` names the key columns that make the bucket, all by default; a bucket is what one task writes.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = 64, bucket_by: list[str] | None = None):
        self.spark, self.path, self.keys, self.order, self.buckets, self.bucket_by = spark, path.rstrip("/"), keys, order, buckets, bucket_by or keys

    def _place(self, generation: int, bucket: int | None = None) -> str:
        return f"{self.path}/{GENERATION}={generation}" + ("" if bucket is None else f"/{BUCKET}={bucket}")

    def _numbers(self, path: str, name: str) -> list[int]:
        """The numbers of a folder's ``name=`` folders."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []
        return sorted(int(n.split("=")[1]) for n in found if n.startswith(f"{name}="))

    def generations(self) -> list[int]:
        """Those that were written to their end."""
        done = []
        for g in self._numbers(self.path, GENERATION):
            mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._place(g)}/_SUCCESS")
            if mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark):
                done.append(g)
        return done

    def layout(self) -> dict[int, list[int]]:
        """The generations of each bucket."""
        held: dict[int, list[int]] = {}
        for g in self.generations():
            for b in self._numbers(self._place(g), BUCKET):
                held.setdefault(b, []).append(g)
        return held

    def bucket(self) -> Column:
        """The bucket of a row's key."""
        return F.pmod(F.xxhash64(*(col(k) for k in self.bucket_by)), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, batch: int, deleted: str | None = None) -> None:
        """One batch of changes; ``deleted`` names a boolean column that marks deletions. Written again, it replaces itself."""
        gone = F.coalesce(col(deleted), F.lit(False)) if deleted else F.lit(False)
        columns = [c for c in rows.columns if c != deleted]
        marked = rows.select(*(col(c) for c in columns), gone.alias(DELETED))
        last = latest(marked, self.keys, [*self.order, DELETED, *(c for c in columns if c not in (*self.keys, *self.order))])
        last.withColumn(BUCKET, self.bucket()).repartition(F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(self._place(EACH * batch))

    def history(self, buckets: Iterable[int] | None = None, before_batch: int | None = None) -> DataFrame | None:
        """All rows as written, of some buckets and of batches before one; None if there are no files."""
        wanted = [g for g in self.generations() if (before_batch is None or g < EACH * before_batch) and self._numbers(self._place(g), BUCKET)]
        if not wanted:
            return None
        found = self.spark.read.option("basePath", self.path).option("mergeSchema", "true").parquet(*map(self._place, wanted))
        return found if buckets is None else found.filter(F.col(BUCKET).isin(sorted(buckets)))

    def of_keys(self, keys: DataFrame, before_batch: int | None = None) -> DataFrame | None:
        """:meth:`history` of the keys given in a table, from their buckets alone; their numbers, at most ``buckets``, are collected."""
        held = self.history([r[0] for r in keys.select(self.bucket()).distinct().collect()], before_batch)
        given = [k for k in self.keys if k in keys.columns]
        return None if held is None else held.join(keys.select(*(col(k) for k in given)).distinct(), given, "left_semi")

    def _last(self, rows: DataFrame) -> DataFrame:
        # what was merged after a batch is no newer than the batch
        return latest(rows.withColumn(GENERATION, F.expr(f"{GENERATION} div {EACH}")), self.keys, [*self.order, GENERATION])

    def read(self, keys: DataFrame | None = None, before_batch: int | None = None) -> DataFrame | None:
        """The last row of each key that isn't deleted, or of given keys only. None for a table without batches."""
        held = self.history(before_batch=before_batch) if keys is None else self.of_keys(keys, before_batch)
        return None if held is None else self._last(held).filter(~F.col(DELETED)).drop(DELETED, BUCKET, GENERATION)

    def compact(self, most: int = 4) -> list[int]:
        """Merges each bucket that lies in more than ``most`` generations into one, and deletes what was merged; gives those buckets.

        Deletions stay, so that a row which is older, but comes later, stays deleted.
        """
        return self._rewritten({b: gs for b, gs in self.layout().items() if len(gs) > most})

    def forget(self, deletions: Column) -> list[int]:
        """Drops deletions that no older row can follow any more, as the condition says, from buckets that lie in one generation."""
        return self._rewritten({b: gs for b, gs in self.layout().items() if len(gs) == 1}, deletions)

    def _rewritten(self, held: dict[int, list[int]], forgotten: Column | None = None) -> list[int]:
        if not held:
            return []
        target = max(self.generations()) + 1
        rows = self._last(self.history(held))
        if forgotten is not None:
            rows = rows.filter(~(F.col(DELETED) & F.coalesce(forgotten, F.lit(False))))
        rows.drop(GENERATION).repartition(F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(self._place(target))
        for b, generations in held.items():
            for g in generations:
                remove(self.spark, self._place(g, b))
        for g in self.generations():
            if g != target and not self._numbers(self._place(g), BUCKET):
                remove(self.spark, self._place(g))
        return sorted(held)


def upsert_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, deleted: str | None = None, compact_over: int | None = 4) -> StreamingQuery:
    """Writes each batch of a stream as changes, and merges buckets of more than ``compact_over`` generations; processes what is there and stops."""

    def merge(batch: DataFrame, number: int) -> None:
        table.write(batch, number, deleted)
        if compact_over is not None:
            table.compact(compact_over)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
