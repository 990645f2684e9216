"""Profiles of bounded size that can be put together: kept for each part of a table, they give drift and quality without the rows.

A profile of a feature has counts, sums, ends, a quantile sketch and a sketch of distinct values. A reference is read once, when its parts are
written; a new part adds its own profile to those that are there.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions.scalar import bin_of, col, number
from marlpit.sources.tables import replace_partitions

#: Size of quantile sketches, shares at which they are compared, and by how much a rank from them may be wrong, nearly always.
SIZE, GRID, RANK_ERROR = 800, 1000, 0.01
SUMS, LEAST, GREATEST = ("n", "nulls", "total", "squares"), "low", "high"


def sketch(df: DataFrame, columns: list[str], by: Iterable[str] = ()) -> DataFrame:
    """(by, feature, n, nulls, total, squares, low, high, quantiles, values) of numeric columns for each part; NaN counts as missing.

    All columns come from one aggregate. A table without rows has no profiles.
    """
    by, out = list(by), []
    for k, c in enumerate(columns):
        x = number(c)
        values = {"n": F.count(x), "nulls": F.count_if(x.isNull()), "total": F.coalesce(F.sum(x), F.lit(0.0)), "squares": F.coalesce(F.sum(x * x), F.lit(0.0)), "low": F.min(x), "high": F.max(x), "quantiles": F.kll_sketch_agg_double(x, F.lit(SIZE)), "values": F.hll_sketch_agg(x.cast("string"), F.lit(12))}
        out += [v.alias(f"{name}_{k}") for name, v in values.items()]
    names = (*SUMS, LEAST, GREATEST, "quantiles", "values")
    row = df.groupBy(*(col(b) for b in by)).agg(F.count("*").alias("_rows"), *out).filter("_rows > 0")
    each = F.array(*(F.struct(F.lit(c).alias("feature"), *(F.col(f"{n}_{k}").alias(n) for n in names)) for k, c in enumerate(columns)))
    return row.select(*(col(b) for b in by), F.inline(each))


def merge(sketches: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Profiles of larger parts, or of the whole, from those of their parts."""
    added = [F.sum(c).alias(c) for c in SUMS]
    return sketches.groupBy(*(col(b) for b in by), "feature").agg(*added, F.min(LEAST).alias(LEAST), F.max(GREATEST).alias(GREATEST), F.kll_merge_agg_double("quantiles", F.lit(SIZE)).alias("quantiles"), F.hll_union_agg("values").alias("values"))


def save(sketches: DataFrame, path: str, version: str) -> None:
    """Keeps the profiles of a table's version; written again, they replace themselves."""
    replace_partitions(sketches.withColumn("version", F.lit(version)), path, ["version"])


def load(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("version") == version).drop("version")


def _grid() -> Column:
    return F.kll_sketch_get_quantile_double("quantiles", F.array(*(F.lit(k / GRID) for k in range(1, GRID))))


def describe(sketches: DataFrame) -> DataFrame:
    """(feature, n, null_rate, mean, std, low, high, median, distinct_values) as the profiles have them."""
    held = sketches.filter("n > 0")
    mean = F.col("total") / F.col("n")
    spread = F.greatest(F.lit(0.0), F.try_divide(F.col("squares") - F.col("total") * mean, F.col("n") - 1))
    rate = F.col("nulls") / (F.col("n") + F.col("nulls"))
    return held.select("feature", "n", rate.alias("null_rate"), mean.alias("mean"), F.sqrt(spread).alias("std"), "low", "high", F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5)).alias("median"), F.hll_sketch_estimate("values").alias("distinct_values"))


def drift(reference: DataFrame, current: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, ref_n, cur_n, ref_mean, cur_mean, psi, ks_statistic, distinct_before, distinct_after) from two tables of profiles.

    Shares are read off both sketches at ``GRID`` ranks, so each is wrong by ``RANK_ERROR`` at most, nearly always, and the KS statistic by twice that. The
    stability index takes the reference's quantiles, and one added to each bin's count. Features without values on either side are left out.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        mean = F.col("total") / F.col("n")
        return df.filter("n > 0").select("feature", F.col("n").alias(f"{name}_n"), mean.alias(f"{name}_mean"), _grid().alias(f"{name}_grid"), F.hll_sketch_estimate("values").alias(f"{name}_distinct"))

    both = side(reference, "ref").join(side(current, "cur"), "feature")
    inner = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: F.element_at("ref_grid", (k * GRID / bins).cast("int")))
    both = both.withColumn("edges", F.array_sort(F.array_distinct(inner)))
    # shares below each edge, from 0 to 1, and what lies between one and the next
    below = lambda grid: F.concat(F.array(F.lit(0.0)), F.transform("edges", lambda e: F.size(F.filter(grid, lambda g: g < e)) / F.lit(float(GRID))), F.array(F.lit(1.0)))
    held = both.withColumns({"ref_below": below("ref_grid"), "cur_below": below("cur_grid")})
    cells = F.sequence(F.lit(1), F.size("edges") + 1)
    part = lambda name, k: (F.element_at(f"{name}_below", k + 1) - F.element_at(f"{name}_below", k)) * F.col(f"{name}_n")
    smooth = lambda name, k: (part(name, k) + 1) / (F.col(f"{name}_n") + F.size("edges") + 1)
    terms = F.transform(cells, lambda k: (smooth("cur", k) - smooth("ref", k)) * F.ln(smooth("cur", k) / smooth("ref", k)))
    psi = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)
    apart = F.transform(F.array_union("ref_grid", "cur_grid"), lambda v: F.abs(bin_of(v, F.col("ref_grid")) - bin_of(v, F.col("cur_grid"))) / F.lit(float(GRID)))
    return held.select("feature", "ref_n", "cur_n", "ref_mean", "cur_mean", psi.alias("psi"), F.array_max(apart).alias("ks_statistic"), F.col("ref_distinct").alias("distinct_before"), F.col("cur_distinct").alias("distinct_after"))
