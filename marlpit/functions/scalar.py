"""Column expressions used by several operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """A column by its plain name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(name: str) -> Column:
    """The column as a double; NaN counts as missing."""
    return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))


def filled(name: str) -> Column:
    """The column as a double, 0 where it is missing."""
    return F.coalesce(number(name), F.lit(0.0))


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0; unknown is 0.0."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def parsed_time(name: str, dtype: T.DataType) -> Column:
    """The column as a timestamp; strings that aren't one become null."""
    return F.try_to_timestamp(col(name)) if isinstance(dtype, T.StringType) else col(name).cast("timestamp")


def bin_of(value: Column, edges: Column, most: int = 1023) -> Column:
    """How many of the sorted edges are at or below the value: bins are closed on the left. Null for a missing value.

    A step is taken if the edge that it leads to is not above the value, the longest ones first, so as many comparisons as ``most`` has bits find one of up to
    ``most`` edges; more of them are counted one by one.
    """
    steps = F.array(*(F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)))
    reached = lambda at, step: F.coalesce(F.get(edges, at + step - 1) <= value, F.lit(False))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(at, step), at + step).otherwise(at))
    few = F.size(edges) < 1 << most.bit_length()
    return F.when(value.isNotNull() & edges.isNotNull(), F.when(few, found).otherwise(F.size(F.filter(edges, lambda e: e <= value))))


def hex_hash(*keys: Column | str, seed: int = 42) -> Column:
    """32 hexadecimal digits of the keys and a seed, the same in every session, engine and order of rows."""
    return F.md5(F.concat_ws("|", *(F.coalesce(k.cast("string"), F.lit("")) for k in (col(k) if isinstance(k, str) else k for k in keys)), F.lit(str(seed))))


def uniform(*keys: Column | str, seed: int = 42) -> Column:
    """A number from 0 to below 1 that hangs on the keys and the seed alone, so that a retried task draws the same."""
    return F.conv(F.substring(hex_hash(*keys, seed=seed), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def normal(*keys: Column | str, seed: int = 42) -> Column:
    """A standard normal number, from two uniform ones."""
    radius = F.sqrt(-2 * F.ln(1 - uniform(*keys, seed=seed)))
    return radius * F.cos(2 * F.pi() * uniform(*keys, seed=seed + 1))


def picked(values: Column, index: Column) -> Column:
    """The element at a computed place, counted on from the beginning again behind the end; null for an empty array."""
    return F.when(F.size(values) > 0, F.get(values, F.pmod(index, F.size(values)).cast("int")))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Columns of a numeric type, in their order."""
    left_out = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in left_out]


def common_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    """Columns of both tables, in the reference's order."""
    other = set(current.columns)
    return [c for c in reference.columns if c in other]


def long_form(df: DataFrame, columns: list[str], keep: Iterable[str] = (), name: str = "feature", value: str = "value") -> DataFrame:
    """One row for each row and column, the values as doubles; NaN counts as missing. ``keep`` columns go along."""
    pairs = F.array(*(F.struct(F.lit(c).alias(name), number(c).alias(value)) for c in columns))
    return df.select(*(col(k) for k in keep), F.explode(pairs).alias("_pair")).select(*(col(k) for k in keep), f"_pair.{name}", f"_pair.{value}")
