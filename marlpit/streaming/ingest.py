"""Incremental file ingestion by Structured Streaming: add metadata, append or upsert, process what is there and stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marlpit.functions.scalar import col


def file_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """A stream of a folder's files. Without a schema, the merged one of the files that are there at the start.

    Times without zone become timestamps, which watermarks need.
    """
    if schema is None:
        batch = spark.read.format(fmt).options(**options)
        schema = (batch.option("mergeSchema", "true") if fmt == "parquet" else batch).load(path).schema
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.load(path)
    return df.select(*(col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else col(f.name) for f in df.schema), "_metadata")


def with_ingestion_metadata(df: DataFrame, run_date: str) -> DataFrame:
    """When and from which file each row came, and the run's date. Works on streams and on batches of files."""
    source = F.col("_metadata.file_path")
    kept = [col(c) for c in df.columns if c != "_metadata"]
    return df.select(*kept, F.current_timestamp().alias("_ingestion_timestamp"), source.alias("_source_file"), F.lit(run_date).cast("date").alias("_run_date"))


def append_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there to Parquet, then stops; files that the checkpoint knows aren't read again."""
    query = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def append_table(df: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """As :func:`append_available`, to a catalog table."""
    query = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).toTable(table)
    query.awaitTermination()
    return query


def deduplicated(df: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key that comes within the delay; state is dropped behind the watermark."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON messages; needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("row"), F.col("timestamp").alias("_message_time")).select("row.*", "_message_time")
