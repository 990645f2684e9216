"""Files laid out by several keys at once, and reads that open only those files that can hold what is asked for.

A key's rank among its own quantiles has a few bits; the ranks' bits, one of each key in turn, make an address. Rows that are near by every key
are near by address, so files of a box of addresses are narrow in all keys. A small table beside the files has their ends.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlpit.functions.scalar import bin_of, col

#: Bits of a key's rank; an address has at most 62.
RANK_BITS = 8
#: Files for which the driver cuts boxes, from sixteen counts for each.
BOXED_FILES = 4096


def ordinal(name: str, dtype: T.DataType) -> Column:
    """A number in the order of the column's values; of a string its first six bytes."""
    if isinstance(dtype, T.StringType):
        start = F.rpad(F.hex(F.substring(F.encode(col(name), "UTF-8"), 1, 6)), 12, "0")
        return F.conv(start, 16, 10).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(col(name).cast("timestamp")).cast("double")
    return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))


def rank_ends(df: DataFrame, keys: list[str], bits: int = RANK_BITS) -> dict[str, list[float]]:
    """The values that part each key into ``2^bits`` ranges of about as many rows, all keys in one aggregate."""
    kinds, shares = {f.name: f.dataType for f in df.schema}, [k / (1 << bits) for k in range(1, 1 << bits)]
    row = df.agg(*(F.percentile_approx(ordinal(k, kinds[k]), shares, 10_000).alias(f"e{i}") for i, k in enumerate(keys))).first()
    return {k: sorted(set(row[f"e{i}"] or [])) for i, k in enumerate(keys)}


def interleaved(ranks: list[Column], bits: int) -> Column:
    """One number of the ranks' bits: the highest of each, then the next of each."""
    n = len(ranks)
    if n * bits > 62:
        raise ValueError(f"{n} keys of {bits} bits don't fit into an address")
    parts = [F.shiftleft(F.shiftright(r.cast("bigint"), b).bitwiseAND(F.lit(1).cast("bigint")), b * n + n - 1 - k) for b in range(bits) for k, r in enumerate(ranks)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def z_address(df: DataFrame, keys: list[str], ends: dict[str, list[float]], bits: int = RANK_BITS) -> Column:
    """Each row's address; a missing key ranks lowest."""
    kinds = {f.name: f.dataType for f in df.schema}
    edges = {k: F.array(*map(F.lit, ends[k])).cast("array<double>") for k in keys}
    return interleaved([F.coalesce(bin_of(ordinal(k, kinds[k]), edges[k]), F.lit(0)) for k in keys], bits)


def boxes(counts: dict[int, int], bits: int, most: float) -> dict[int, int]:
    """A file for each cell, by the cells' row counts: halves, and halves of those, until none of more than one cell has over ``most`` rows.

    Each file is a box that is halved by one key after the other, so it is never wide in all of them because it goes round a corner.
    """
    cells, sums = sorted(counts), [0]
    for c in cells:
        sums.append(sums[-1] + counts[c])
    found: dict[int, int] = {}
    todo, n = [(0, bits)], 0
    while todo:
        first, size = todo.pop()
        a, b = bisect_left(cells, first), bisect_left(cells, first + (1 << size))
        if a == b:
            continue
        if sums[b] - sums[a] > most and size:
            todo += [(first + (1 << size - 1), size - 1), (first, size - 1)]
            continue
        found |= dict.fromkeys(cells[a:b], n)
        n += 1
    return found


def write_zordered(df: DataFrame, path: str, keys: list[str], files: int, bits: int | None = None) -> None:
    """Parquet of about ``files`` files (half as many more at times), and the table of their ends under ``_files``.

    Up to ``BOXED_FILES`` files are boxes in the space of ranks, made from counts of cells; more of them are ranges of addresses, whose ends Spark samples.
    Rows are read for the ranks and for the counts, and shuffled once. Very many rows of one address go to one file, as copies
    can't be told apart by any key. An empty table gives a file without rows.
    """
    bits = bits or min(RANK_BITS, 62 // len(keys))
    ends = rank_ends(df, keys, bits)
    names = iter(n for k in range(len(df.columns) + 3) if (n := f"_z{k}") not in df.columns)
    address, cell, file = next(names), next(names), next(names)
    placed = df.withColumn(address, z_address(df, keys, ends, bits))
    if files <= BOXED_FILES:
        fine = min(len(keys) * bits, max(1, (files - 1).bit_length()) + 4)
        placed = placed.withColumn(cell, F.shiftright(address, len(keys) * bits - fine))
        counts = {r[0]: r[1] for r in placed.groupBy(cell).count().collect()}
        of = boxes(counts, fine, 1.5 * sum(counts.values()) / files)
        table = df.sparkSession.createDataFrame(list(of.items()), f"{cell} bigint, {file} int")
        dealt = placed.join(F.broadcast(table), cell).repartitionById(max([0, *of.values()]) + 1, F.col(file))
    else:
        dealt = placed.repartitionByRange(files, address)
    dealt.sortWithinPartitions(address, *(col(k) for k in keys)).select(*(col(c) for c in df.columns)).write.mode("overwrite").parquet(f"{path}/data")
    spark = df.sparkSession
    written = spark.read.schema(df.schema).parquet(f"{path}/data").select(*(col(k) for k in keys), F.col("_metadata.file_path").alias("file"))
    both = [f(col(k)).alias(f"{name}_{i}") for i, k in enumerate(keys) for name, f in (("low", F.min), ("high", F.max))]
    found = written.groupBy("file").agg(F.count("*").alias("rows"), *both)
    found.coalesce(1).write.mode("overwrite").parquet(f"{path}/_files")
    spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "place int, key string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_keys")


def files_for(spark: SparkSession, path: str, ranges: dict[str, tuple[Any, Any]]) -> list[str]:
    """The files whose rows can lie within all ranges (both ends included, None for an open one)."""
    places = {r.key: r.place for r in spark.read.parquet(f"{path}/_keys").collect()}
    found = spark.read.parquet(f"{path}/_files")
    for key, (low, high) in ranges.items():
        if key in places:
            if low is not None:
                found = found.filter(F.col(f"high_{places[key]}") >= F.lit(low))
            if high is not None:
                found = found.filter(F.col(f"low_{places[key]}") <= F.lit(high))
    return [r.file for r in found.select("file").collect()]


def read_zordered(spark: SparkSession, path: str, ranges: dict[str, tuple[Any, Any]] | None = None) -> DataFrame:
    """The rows within all ranges, from the files that can hold some; the filters reach the row groups too."""
    schema = spark.read.parquet(f"{path}/data").schema
    df = spark.read.schema(schema).parquet(f"{path}/data")
    if not ranges:
        return df
    files = files_for(spark, path, ranges)
    df = spark.read.schema(schema).parquet(*files) if files else df.limit(0)
    for key, (low, high) in ranges.items():
        df = df.filter(col(key) >= F.lit(low)) if low is not None else df
        df = df.filter(col(key) <= F.lit(high)) if high is not None else df
    return df


def share_read(spark: SparkSession, path: str, ranges: dict[str, tuple[Any, Any]]) -> float:
    """The share of files that a read of these ranges opens."""
    return len(files_for(spark, path, ranges)) / max(1, spark.read.parquet(f"{path}/_files").count())
