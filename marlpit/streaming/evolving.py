"""A stream of JSON lines whose columns may grow: new ones are logged and the stream is started again, what doesn't fit its type is kept aside.

The source is read as text, so a new schema needs no new checkpoint. A batch that holds an unknown field is not written: its columns are added
to the log beside the checkpoint, the query stops, and started again it takes the same batch up with the new columns.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types that a new column may get, in the order in which they are tried; a column that none of them fits is a string.
TRIED = ("bigint", "double", "boolean", "timestamp")
RESCUED, FIELDS = "_rescued", "_fields"
LOG = "version int, place int, name string, type string"


class ColumnLog:
    """The columns of a stream, version by version, as a table under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> list:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return []
        return self.spark.read.schema(LOG).parquet(self.path).collect()

    def columns(self) -> dict[str, str]:
        """Types by name, in the order in which they came."""
        return {r.name: r.type for r in sorted(self._rows(), key=lambda r: (r.version, r.place))}

    def versions(self) -> int:
        return len({r.version for r in self._rows()})

    def add(self, columns: dict[str, str]) -> None:
        """A further version; one file, so that it is there as a whole or not at all."""
        known = self.columns()
        new = [(n, t) for n, t in columns.items() if n not in known]
        if new:
            self.spark.createDataFrame([(self.versions(), k, n, t) for k, (n, t) in enumerate(new)], LOG).coalesce(1).write.mode("append").parquet(self.path)


def parsed(lines: DataFrame, columns: dict[str, str], value: Column) -> DataFrame:
    """``lines`` with its fields as a map, the known columns by their types, and ``_rescued``: a JSON object of the fields that don't fit them.

    A line that isn't an object is rescued whole, under an empty name; an empty one has nothing to rescue.
    """
    held = lines.withColumn(FIELDS, F.from_json(value, "map<string,string>"))
    text = lambda n: F.try_element_at(FIELDS, F.lit(n))
    typed = {n: text(n) if t == "string" else text(n).try_cast(t) for n, t in columns.items()}
    wrong = [F.when(text(n).isNotNull() & typed[n].isNull(), F.struct(F.lit(n).alias("key"), text(n).alias("value"))) for n, t in columns.items() if t != "string"]
    wrong.append(F.when(F.col(FIELDS).isNull() & (F.trim(value) != ""), F.struct(F.lit("").alias("key"), value.alias("value"))))
    rest = F.array_compact(F.array(*wrong))
    kept = [c for c in lines.columns if c not in columns]
    return held.select(*kept, FIELDS, *(c.alias(n) for n, c in typed.items()), F.when(F.size(rest) > 0, F.to_json(F.map_from_entries(rest))).alias(RESCUED))


def new_columns(fields: DataFrame, known: dict[str, str]) -> dict[str, str]:
    """Types of the fields that aren't known: the first of ``TRIED`` that all their values fit; in the order of their names."""
    entries = fields.select(F.explode(FIELDS).alias("name", "text")).filter(~F.col("name").isin([*known]) if known else F.lit(True))
    fits = [F.count(F.col("text").try_cast(t)).alias(f"fits_{t}") for t in TRIED]
    rows = entries.groupBy("name").agg(F.count("text").alias("n"), *fits).orderBy("name").collect()
    return {r.name: next((t for t in TRIED if r.n and r[f"fits_{t}"] == r.n), "string") for r in rows}


def append_evolving(spark: SparkSession, path: str, target: str, checkpoint: str, columns: dict[str, str] | None = None, files_per_trigger: int | None = None, most_restarts: int = 100) -> int:
    """Appends the JSON lines of a folder's new files to ``target``, a folder for each batch; gives how often the stream was started again.

    ``columns`` names types that are known before any file is read. A batch that is run again replaces its own folder, so no row is lost or doubled.
    Values that don't fit their column are null there and in ``_rescued``; types never change once they are logged. Names of fields are case-sensitive,
    and two that differ by case alone end the stream with an error of Spark's.
    """
    log = ColumnLog(spark, f"{checkpoint}/columns")
    if columns:
        log.add(columns)
    for restarts in range(most_restarts + 1):
        known, grown = log.columns(), []

        def write(batch: DataFrame, number: int, known: dict[str, str] = known, grown: list = grown) -> None:
            found = parsed(batch, known, F.col("_line"))
            more = new_columns(found, known)
            if more:
                log.add(more)
                grown.append(more)
                raise RuntimeError(f"new columns: {', '.join(more)}")
            found.drop(FIELDS, "_line").write.mode("overwrite").parquet(f"{target}/batch={number}")

        reader = spark.readStream.format("text")
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        lines = reader.load(path).select(F.col("value").alias("_line"), F.col("_metadata.file_path").alias("_source_file"))
        query = lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
            return restarts
        except StreamingQueryException:
            if not grown:
                raise
    raise RuntimeError(f"columns were new {most_restarts} times")


def read_evolved(spark: SparkSession, target: str) -> DataFrame:
    """All rows that were appended, with the columns of all versions."""
    return spark.read.option("mergeSchema", "true").parquet(target).drop("batch")
