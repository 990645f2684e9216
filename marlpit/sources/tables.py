"""Scans and sinks: files, catalog tables, JDBC; plain, appended, partitioned, clustered and versioned writes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marlpit.functions.scalar import col
from marlpit.operators.store import fingerprint, write_clustered  # noqa: F401  (re-exported)

FORMATS = ("parquet", "csv", "json", "orc")


def read_files(spark: SparkSession, path: str | list[str], fmt: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Files of a format; with a schema nothing is inferred."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; there are {', '.join(FORMATS)}")
    reader = spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {}) | options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, partitions: int, **properties: str) -> DataFrame:
    """A database table in ranges of a numeric column, so that the read is parallel."""
    return spark.read.jdbc(url, table, column, low, high, partitions, properties=properties)


def read_first_of(spark: SparkSession, names: Iterable[str], fallback_rows: int | None = None) -> DataFrame:
    """The first of these tables that is there: the first name in whole, others too unless ``fallback_rows`` cuts them (for a trial run)."""
    for k, name in enumerate(names):
        if spark.catalog.tableExists(name):
            df = spark.table(name)
            return df.limit(fallback_rows) if k and fallback_rows else df
    raise LookupError(f"none of the tables is there: {', '.join(names)}")


def use_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Makes the database if it isn't there, under ``location`` if one is given, and the current one."""
    at = "" if location is None else f" LOCATION '{location}'"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{at}")
    spark.catalog.setCurrentDatabase(name)


def write_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by: Iterable[str] = ()) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; there are {', '.join(FORMATS)}")
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*by) if by else writer).save(path)


def write_with_fingerprint(df: DataFrame, path: str) -> str:
    """Writes Parquet and gives the fingerprint of what was written."""
    df.write.mode("overwrite").parquet(path)
    return fingerprint(df.sparkSession.read.parquet(path)).first().fingerprint


def write_table(df: DataFrame, name: str, mode: str = "overwrite", by: Iterable[str] = ()) -> None:
    """A managed table; ``append`` adds rows."""
    writer = df.write.format("parquet").mode(mode)
    (writer.partitionBy(*by) if by else writer).saveAsTable(name)


def write_version(df: DataFrame, path: str, version: str) -> str:
    """A new version's folder, whatever columns earlier versions have; gives its path."""
    target = f"{path.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(target)
    return target


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that the rows fall in and no others, so that a second run doubles nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> None:
    """A table in buckets of the keys; joins of two such tables on them need no shuffle."""
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def union_models(frames: Iterable[DataFrame]) -> DataFrame:
    """Tables one under the other by column name; a column that one lacks is null there."""
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("there are no tables to unite")
    return out


def by_keys(df: DataFrame, key: str, keys: DataFrame | Iterable) -> DataFrame:
    """Rows of the keys: a join where they come as a table, a pushed-down filter where they are listed."""
    return df.join(keys.select(col(key)), key, "left_semi") if isinstance(keys, DataFrame) else df.filter(col(key).isin(list(keys)))
