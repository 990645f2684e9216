"""Features of entities that follow changes: partial states are merged where rows are new, and only entities of which a row has changed are computed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions.scalar import col
from marlpit.operators.store import latest
from marlpit.sources.scratch import scratch
from marlpit.streaming.keyed_table import DELETED, KeyedTable

#: What is kept of an entity's values; each of two parts gives that of the whole.
STATE = ("n", "total", "low", "high", "values")


def states(rows: DataFrame, entity: str, value: str) -> DataFrame:
    """(entity, n, total, low, high, values): rows with a value, their sum and ends, and a sketch of distinct values."""
    x = F.nanvl(col(value).cast("double"), F.lit(None).cast("double"))
    return rows.groupBy(col(entity)).agg(F.count(x).alias("n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"), F.hll_sketch_agg(x.cast("string"), F.lit(12)).alias("values"))


def merged(parts: DataFrame, entity: str) -> DataFrame:
    """States of the same entities put together."""
    return parts.groupBy(col(entity)).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("values").alias("values"))


class IncrementalFeatures:
    """Counts, sums, means, ends and distinct values by entity, under ``path``, kept up to date by batches of changes.

    A change has the entity, the row's key within it, a value, and a number that says which of two changes of a row is the later one. A row that
    moves to another entity is a deletion there and a new row here.
    """

    def __init__(self, spark: SparkSession, path: str, entity: str, row: str, value: str, sequence: str, buckets: int = 64):
        self.entity, self.row, self.value, self.sequence = entity, row, value, sequence
        self.rows = KeyedTable(spark, f"{path}/rows", [entity, row], [sequence], buckets, [entity])
        self.held = KeyedTable(spark, f"{path}/states", [entity], ["_version"], buckets)

    def apply(self, changes: DataFrame, batch: int, deleted: str | None = None) -> dict[str, int]:
        """Takes one batch up; gives how many entities were merged and how many computed again. A batch applied again changes nothing.

        Rows that weren't known are merged into their entity's state. Entities with a row that was, deletions among them, are computed again from
        their own buckets' rows. All other entities are neither read nor written.
        """
        spark = changes.sparkSession
        with scratch(spark) as kept:
            gone = F.coalesce(col(deleted), F.lit(False)) if deleted else F.lit(False)
            given = changes.select(col(self.entity), col(self.row), col(self.value), col(self.sequence), gone.alias("_gone"))
            # the last change of each row, as the table of rows takes it; nothing of the batch is read back
            last = kept(latest(given, [self.entity, self.row], [self.sequence, "_gone", self.value]))
            known = self.rows.of_keys(last.select(col(self.entity), col(self.row)), batch)
            again = kept(last.limit(0).select(col(self.entity)) if known is None else known.select(col(self.entity)).distinct())
            self.rows.write(last, batch, "_gone")
            new = last.filter("not _gone").join(again, self.entity, "left_anti")
            fresh = kept(states(new, self.entity, self.value))
            before = self.held.read(fresh.select(col(self.entity)), batch)
            parts = fresh if before is None else fresh.unionByName(before.select(fresh.columns))
            one = kept(merged(parts, self.entity))
            two = kept(states(self.rows.read(again), self.entity, self.value)) if not again.isEmpty() else one.limit(0)
            empty = again.join(two.select(col(self.entity)), self.entity, "left_anti")
            out = one.unionByName(two).withColumn("_none", F.lit(False)).unionByName(empty.withColumn("_none", F.lit(True)), allowMissingColumns=True)
            self.held.write(out.withColumn("_version", F.lit(batch)), batch, "_none")
            return {"merged": one.count(), "computed_again": again.count()}

    def features(self, entities: DataFrame | None = None) -> DataFrame:
        """(entity, n, total, mean, low, high, distinct_values) of all entities that have rows, or of given ones only."""
        found = self.held.read(entities)
        if found is None:
            raise LookupError("no batch has been applied yet")
        mean = F.try_divide(F.col("total"), F.col("n"))
        return found.select(col(self.entity), "n", "total", mean.alias("mean"), "low", "high", F.hll_sketch_estimate("values").alias("distinct_values"))

    def compact(self, most: int = 4) -> None:
        self.rows.compact(most)
        self.held.compact(most)
