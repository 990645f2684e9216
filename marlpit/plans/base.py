"""What the registered queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

#: Orders before this day are the reference, those from it on the current table.
CUT_DAY = "1998-01-01"
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the order of sums moves their last digits; -0 becomes 0."""
    return df.select(*((F.round(F.col(f"`{f.name}`"), digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema))


def orders_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders before and from the cut day."""
    orders = table(spark, sf_dir, "orders")
    day = F.lit(CUT_DAY).cast("timestamp_ntz")
    return orders.filter(F.col("o_orderdate") < day), orders.filter(F.col("o_orderdate") >= day)
