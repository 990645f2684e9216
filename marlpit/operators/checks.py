"""Data-quality expectations and column profiles: one aggregate over the table, whatever their number."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlpit.functions.scalar import col, number, numeric_columns


@dataclass(frozen=True)
class Rule:
    """A check by name. ``failures`` counts what is wrong, as an aggregate; ``bad`` says which rows are, where rows can be."""

    name: str
    failures: Column
    bad: Column | None = None


def unique(key: str) -> Rule:
    """Each key is there once; repeated and missing ones count as failures."""
    return Rule(f"unique({key})", F.count("*") - F.count_distinct(col(key)))


def not_null(name: str) -> Rule:
    bad = col(name).isNull()
    return Rule(f"not_null({name})", F.count_if(bad), bad)


def in_set(name: str, values: Iterable) -> Rule:
    """The value is one of these; a missing value passes."""
    values = list(values)
    bad = F.coalesce(~col(name).isin(values), F.lit(False))
    return Rule(f"in_set({name})", F.count_if(bad), bad)


def between(name: str, low: float, high: float) -> Rule:
    """The value is in the range; a missing value passes."""
    bad = F.coalesce((col(name) < low) | (col(name) > high), F.lit(False))
    return Rule(f"between({name})", F.count_if(bad), bad)


def null_rate(name: str, most: float = 0.1) -> Rule:
    """One failure if more than this share of values is missing."""
    return Rule(f"null_rate({name})", F.when(F.avg(col(name).isNull().cast("double")) > most, 1).otherwise(0))


def not_constant(name: str) -> Rule:
    """One failure if there are not two different values."""
    return Rule(f"not_constant({name})", F.when(F.coalesce(F.min(col(name)) < F.max(col(name)), F.lit(False)), 0).otherwise(1))


def not_empty() -> Rule:
    return Rule("not_empty", F.when(F.count("*") > 0, 0).otherwise(1))


def standard_rules(df: DataFrame, key: str) -> list[Rule]:
    """Key unique and present, few missing values, no constant numeric column, rows at all."""
    return [not_empty(), unique(key), not_null(key), *(null_rate(c) for c in df.columns), *(not_constant(c) for c in numeric_columns(df, [key]))]


def evaluate(df: DataFrame, rules: list[Rule], dataset: str = "dataset") -> DataFrame:
    """(dataset, check, passed, failed_count) of each rule, from one aggregate."""
    row = df.agg(*(r.failures.cast("bigint").alias(f"f{k}") for k, r in enumerate(rules)))
    pairs = F.array(*(F.struct(F.lit(r.name).alias("check"), F.coalesce(F.col(f"f{k}"), F.lit(0)).alias("failed_count")) for k, r in enumerate(rules)))
    found = row.select(F.explode(pairs).alias("p"))
    return found.select(F.lit(dataset).alias("dataset"), "p.check", (F.col("p.failed_count") == 0).alias("passed"), "p.failed_count")


def tally(results: DataFrame) -> DataFrame:
    """(dataset, passed, failed) counts of checks."""
    return results.groupBy("dataset").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def scorecard(results: DataFrame, good: float = 0.95, fair: float = 0.8) -> DataFrame:
    """(dataset, checks, score, grade): the share of checks passed, in percent, and whether that is good, fair or poor."""
    found = results.groupBy("dataset").agg(F.count("*").alias("checks"), F.avg(F.col("passed").cast("double")).alias("share"))
    grade = F.when(F.col("share") >= good, "good").when(F.col("share") >= fair, "fair").otherwise("poor")
    return found.select("dataset", "checks", (100 * F.col("share")).alias("score"), grade.alias("grade"))


class ExpectationFailed(ValueError):
    """Raised by the action ``fail``."""


def expect(df: DataFrame, rules: list[Rule], action: str = "keep") -> DataFrame:
    """``keep`` gives the table as it is, ``drop`` without bad rows, ``fail`` raises if a rule fails.

    Rules on rows can drop; a rule on the whole table, such as uniqueness, can only fail.
    """
    if action == "keep":
        return df
    if action == "drop":
        for r in rules:
            if r.bad is None:
                raise ValueError(f"{r.name} is about the whole table and can't drop rows")
            df = df.filter(~r.bad)
        return df
    if action != "fail":
        raise ValueError(f"unknown action {action}")
    failed = evaluate(df, rules).filter(~F.col("passed")).collect()
    if failed:
        raise ExpectationFailed(", ".join(f"{r.check}: {r.failed_count}" for r in failed))
    return df


# ---------------------------------------------------------------- profiles


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, unique_count): how many different values each column has; missing ones, NaN among them, don't count.

    Tasks make the pairs of column and value distinct before the one exchange that they take, so that a column of few values costs next to nothing
    and one of many is spread over all tasks. Maps and variants, which can't be compared, give null.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    none = {"l": F.lit(None).cast("bigint"), "d": F.lit(None).cast("double"), "s": F.lit(None).cast("string")}

    def slot(k: int, c: str) -> Column:
        kind, x = kinds[c], col(c)
        if isinstance(kind, (T.IntegralType, T.BooleanType)):
            own = {"l": x.cast("bigint")}
        elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            own = {"d": number(c)}
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            own = {"l": F.unix_micros(x.cast("timestamp"))}
        elif isinstance(kind, T.BinaryType):
            own = {"s": F.hex(x)}
        else:
            own = {"s": F.to_json(F.struct(x.alias("v"))) if isinstance(kind, (T.ArrayType, T.StructType)) else x.cast("string")}
        if isinstance(kind, (T.ArrayType, T.StructType)):
            own = {"s": F.when(x.isNotNull(), own["s"])}
        return F.struct(F.lit(k).alias("k"), *((none | own)[n].alias(n) for n in "lds"))

    comparable = [k for k, c in enumerate(columns) if not isinstance(kinds[c], (T.MapType, T.VariantType))]
    pairs = df.select(F.inline(F.array(*(slot(k, columns[k]) for k in comparable)))).distinct() if comparable else None
    names = F.array(*map(F.lit, columns))
    counted = pairs.groupBy("k").agg(F.count_if(F.coalesce(F.col("l").cast("string"), F.col("d").cast("string"), "s").isNotNull()).alias("u")) if pairs is not None else df.sparkSession.createDataFrame([], "k int, u bigint")
    every = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("k"))
    out = every.join(F.broadcast(counted), "k", "left")  # a row for each column
    return out.select(F.get(names, "k").alias("feature"), F.when(F.col("k").isin(comparable), F.coalesce("u", F.lit(0))).alias("unique_count"))


PROFILE = ("n", "nulls", "unique_count", "mean", "std", "min", "max", "zeros", "inf_count")


def profile(df: DataFrame, columns: list[str] | None = None, most_nulls: float = 0.1, exact: bool = True) -> DataFrame:
    """A row for each column: rates, distinct values, moments, zeros, infinities and issues.

    Numbers' deviation is that of the sample, and a missing value isn't a zero. All columns come from one aggregate, and their distinct values from
    :func:`distinct_counts`; ``exact=False`` estimates those within the aggregate.
    """
    columns = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema}
    out = []
    for k, c in enumerate(columns):
        numeric = isinstance(kinds[c], T.NumericType)
        # NaN counts as missing
        x = number(c) if numeric else col(c)
        none = F.lit(None).cast("double")
        values = {
            "n": F.count("*"),
            "nulls": F.count_if(x.isNull()),
            "unique_count": F.lit(None).cast("bigint") if exact or isinstance(kinds[c], (T.MapType, T.VariantType)) else F.approx_count_distinct(x),
            "mean": F.avg(x) if numeric else none,
            "std": F.stddev_samp(x) if numeric else none,
            "min": F.min(x) if numeric else none,
            "max": F.max(x) if numeric else none,
            "zeros": F.count_if(x == 0) if numeric else F.lit(None).cast("bigint"),
            "inf_count": F.count_if(F.abs(x) == float("inf")) if numeric else F.lit(None).cast("bigint"),
        }
        out += [v.alias(f"{name}_{k}") for name, v in values.items()]
    row = df.agg(*out)
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), *(F.col(f"{n}_{k}").alias(n) for n in PROFILE)) for k, c in enumerate(columns)))
    p = row.select(F.explode(rows).alias("p")).select("p.*")
    if exact:
        p = p.drop("unique_count").join(F.broadcast(distinct_counts(df, columns)), "feature")  # a row for each column
    rate = lambda x: F.try_divide(F.col(x), F.col("n"))
    p = p.select("feature", rate("nulls").alias("null_rate"), "unique_count", rate("unique_count").alias("unique_rate"), "mean", "std", "min", "max", rate("zeros").alias("zero_rate"), "inf_count")
    issues = F.array_compact(
        F.array(
            F.when(F.col("null_rate") > most_nulls, F.format_string("high_null_rate (%.2f%%)", 100 * F.col("null_rate"))),
            F.when(F.col("unique_count") <= 1, F.lit("constant_column")),
            F.when(F.col("inf_count") > 0, F.concat(F.lit("contains_inf ("), F.col("inf_count").cast("string"), F.lit(")"))),
        )
    )
    return p.withColumn("issues", issues).withColumn("has_issue", F.size("issues") > 0)


def describe(df: DataFrame, column: str) -> DataFrame:
    """(summary, value): count, mean, stddev, min and max of a column."""
    names = ["count", "mean", "stddev", "min", "max"]
    return df.select(number(column).alias("v")).summary(*names).select("summary", F.col("v").cast("double").alias("value"))


def range_violations(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, violations, rate): values of the current table outside the reference's range."""
    ends = reference.agg(*(F.min(number(c)).alias(f"a{k}") for k, c in enumerate(columns)), *(F.max(number(c)).alias(f"b{k}") for k, c in enumerate(columns))).first()
    bad = [F.coalesce((number(c) < ends[f"a{k}"]) | (number(c) > ends[f"b{k}"]), F.lit(False)) for k, c in enumerate(columns)]
    row = current.agg(F.count("*").alias("n"), *(F.count_if(b).alias(f"v{k}") for k, b in enumerate(bad)))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"v{k}").alias("violations")) for k, c in enumerate(columns)))
    return row.select("n", F.explode(rows).alias("p")).select("p.feature", "p.violations", F.try_divide(F.col("p.violations"), F.col("n")).alias("rate"))


def cardinality_change(reference: DataFrame, current: DataFrame, columns: list[str], most: float = 0.2) -> DataFrame:
    """(feature, before, after, change, flagged): how the number of distinct values has moved."""
    sides = []
    for name, df in (("before", reference), ("after", current)):
        sides.append(distinct_counts(df, columns).withColumnRenamed("unique_count", name))
    both = sides[0].join(sides[1], "feature")
    change = F.try_divide(F.abs(F.col("after") - F.col("before")), F.col("before"))
    return both.select("feature", "before", "after", change.alias("change"), F.coalesce(change > most, F.lit(True)).alias("flagged"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """(rows, orphans): child rows, and those whose key the parent lacks. Missing keys are orphans."""
    rows = child.agg(F.count("*").alias("rows"))
    lost = child.join(parent.select(col(parent_key).alias("_k")), col(child_key) == F.col("_k"), "left_anti").agg(F.count("*").alias("orphans"))
    return rows.crossJoin(lost)


def newest(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """(keys, newest, rows): the last time of each entity."""
    return df.groupBy(*(col(k) for k in keys)).agg(F.max(col(time).cast("timestamp")).alias("newest"), F.count("*").alias("rows"))


def retained(df: DataFrame, time: str, now: Column, days: int) -> DataFrame:
    """Rows not older than so many days."""
    return df.filter(col(time).cast("timestamp") >= now - F.make_interval(days=F.lit(days)))


def volume(df: DataFrame, segment: str, time: str, unit: str = "hour") -> DataFrame:
    """(segment, period, rows, newest) for freshness and volume watches."""
    t = col(time).cast("timestamp")
    return df.groupBy(col(segment).alias("segment"), F.date_trunc(unit, t).alias("period")).agg(F.count("*").alias("rows"), F.max(t).alias("newest"))
