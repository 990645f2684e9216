"""Feature transforms: fitted once, then applied alike to any table with the same columns.

Fitted state is small: a row for each numeric column in one wide aggregate, and a table of categories. Every transform
is one ``select`` of expressions, so that Catalyst prunes the scan to the columns that are used.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlpit.functions.scalar import bin_of, col, filled, flag, hex_hash, long_form, number, numeric_columns, parsed_time
from marlpit.operators.quantiles import exact_quantiles
from marlpit.sources.scratch import kept

#: The category that stands for all unseen ones, and the day from which days are counted.
UNKNOWN, REFERENCE_DAY = "__unknown__", "2024-01-01"
#: Categories that may be sent to every executor.
BROADCAST_CATEGORIES = 1_000_000
#: Text bytes whose words are counted together inside a task.
TEXT_BYTES = 4 << 20


# ---------------------------------------------------------------- roles


@dataclass(frozen=True)
class ColumnRoles:
    """Which columns are what. By default the names' beginnings say so."""

    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    temporal: tuple[str, ...] = ()
    key: str = "record_id"

    @classmethod
    def of(cls, df: DataFrame, key: str = "record_id") -> ColumnRoles:
        starts = lambda *p: tuple(c for c in df.columns if c.startswith(p))
        return cls(starts("num_", "text_len", "text_words"), starts("cat_"), starts("date_"), key)


# ---------------------------------------------------------------- numeric


def numeric_expressions(name: str, mean: float | None = None, std: float | None = None) -> list[Column]:
    """Filled value, missing flag, logarithm and square; with a fitted mean and deviation also the standard score."""
    x = filled(name)
    out = [x.alias(f"{name}_orig"), flag(number(name).isNull()).alias(f"{name}_is_null")]
    if mean is not None:
        out.append(((x - mean) / (std or 1.0)).alias(f"{name}_scaled"))
    return [*out, F.log1p(F.abs(x)).alias(f"{name}_log1p"), (x * x).alias(f"{name}_squared")]


def numeric_features(df: DataFrame, columns: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """The unfitted numeric transforms of the columns, beside the kept ones."""
    return df.select(*(col(k) for k in keep), *(e for c in columns for e in numeric_expressions(c)))


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column's filled values, in one pass; a deviation of 0 acts as 1."""
    if not columns:
        return {}
    row = df.agg(*(F.avg(filled(c)).alias(f"m{k}") for k, c in enumerate(columns)), *(F.stddev_pop(filled(c)).alias(f"s{k}") for k, c in enumerate(columns))).first()
    return {c: (row[f"m{k}"] or 0.0, row[f"s{k}"] or 1.0) for k, c in enumerate(columns)}


def standard_scale(df: DataFrame, columns: list[str], fitted: dict[str, tuple[float, float]] | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """Standard scores by a fitted scaler, or by the table's own."""
    fitted = fitted or fit_scaler(df, columns)
    return df.select(*(col(k) for k in keep), *(((filled(c) - fitted[c][0]) / fitted[c][1]).alias(f"{c}_scaled") for c in columns))


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, variance): the sample variance of each column's values that aren't missing, in one pass."""
    row = df.agg(*(F.var_samp(number(c)).alias(f"v{k}") for k, c in enumerate(columns)))
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"v{k}").alias("variance")) for k, c in enumerate(columns)))
    return row.select(F.explode(pairs).alias("p")).select("p.feature", "p.variance")


def top_variances(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The k columns of most variance; ties go by name."""
    return variances(df, columns).orderBy(F.desc_nulls_last("variance"), "feature").limit(k)


def interaction_columns(df: DataFrame, columns: list[str], top_k: int = 10, most: int = 5) -> list[str]:
    """Which columns are multiplied: of the first ``top_k``, the ``most`` of most variance, in that order."""
    first = columns[:top_k]
    return [r.feature for r in top_variances(df, first, min(top_k, most)).collect()] if first else []


def interactions(df: DataFrame, chosen: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """The product of each pair of the chosen columns."""
    return df.select(*(col(k) for k in keep), *interaction_expressions(chosen))


def interaction_expressions(chosen: list[str]) -> list[Column]:
    return [(filled(a) * filled(b)).alias(f"interact_{a}_{b}") for i, a in enumerate(chosen) for b in chosen[i + 1 :]]


# ---------------------------------------------------------------- categories


def _category(name: str) -> Column:
    """The value as a string; missing is a category of its own."""
    return F.coalesce(col(name).cast("string"), F.lit("nan"))


def fit_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code, frequency) of all columns, from one pass.

    Codes are ranks of the sorted distinct values together with the one for unseen values, from 0; the frequency
    is the value's share of the rows.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, code int, frequency double")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), _category(c).alias("value")) for c in columns))).alias("p")
    counts = df.select(pairs).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    rows = df.sparkSession.createDataFrame([(c, UNKNOWN, 0) for c in columns], "column string, value string, n bigint")
    every = counts.unionByName(rows).groupBy("column", "value").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("column")  # as many rows as categories
    return every.select("column", "value", (F.dense_rank().over(own.orderBy("value")) - 1).alias("code"), (F.col("n") / F.sum("n").over(own)).alias("frequency"))


def _settled(fitted: DataFrame) -> DataFrame:
    """The fitted table written once, as each column looks it up; one that is cached already, as it is."""
    return fitted if fitted.is_cached else kept(fitted)


def _looked_up(df: DataFrame, fitted: DataFrame, columns: list[str], field_: str, name: str, small: bool) -> DataFrame:
    """``df`` with ``field_`` of each column's category; null where there is none."""
    for c in columns:
        own = fitted.filter(F.col("column") == c).select(F.col("value").alias("_value"), F.col(field_).alias(name.format(c)))
        df = df.join(F.broadcast(own) if small else own, _category(c) == F.col("_value"), "left").drop("_value")
    return df


def label_encode(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``{column}_encoded``; a value that the fit didn't see gets the code of the unseen."""
    fitted = _settled(fitted)
    unseen = {r.column: r.code for r in fitted.filter(F.col("value") == UNKNOWN).collect()}
    found = _looked_up(df, fitted, columns, "code", "{}_encoded", fitted.count() <= BROADCAST_CATEGORIES)
    return found.withColumns({f"{c}_encoded": F.coalesce(f"{c}_encoded", F.lit(unseen[c])) for c in columns})


def frequency_encode(df: DataFrame, columns: list[str], fitted: DataFrame | None = None) -> DataFrame:
    """``df`` with ``{column}_freq``: the category's share in the fitted table, 0 if unseen; without one, in ``df`` itself."""
    fitted = _settled(fit_categories(df, columns) if fitted is None else fitted)
    found = _looked_up(df, fitted, columns, "frequency", "{}_freq", fitted.count() <= BROADCAST_CATEGORIES)
    return found.withColumns({f"{c}_freq": F.coalesce(f"{c}_freq", F.lit(0.0)) for c in columns})


def index_by_frequency(df: DataFrame, columns: list[str]):
    """A fitted MLlib indexer by falling frequency, which keeps unseen values as the last index."""
    from pyspark.ml.feature import StringIndexer

    return StringIndexer(inputCols=columns, outputCols=[f"{c}_indexed" for c in columns], handleInvalid="keep").fit(df)


# ---------------------------------------------------------------- dates


def temporal_expressions(name: str, dtype: T.DataType) -> list[Column]:
    """Ten features of a date column; a missing or unreadable date gives parts 0 and month 1."""
    t = parsed_time(name, dtype)
    part = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    month, day = F.coalesce(F.month(t).cast("double"), F.lit(1.0)), part(F.weekday(t))
    turn = 2 * F.pi()
    return [
        part(F.year(t)).alias(f"{name}_year"),
        part(F.month(t)).alias(f"{name}_month"),
        day.alias(f"{name}_dayofweek"),
        part(F.dayofyear(t)).alias(f"{name}_dayofyear"),
        F.sin(turn * month / 12).alias(f"{name}_month_sin"),
        F.cos(turn * month / 12).alias(f"{name}_month_cos"),
        F.sin(turn * day / 7).alias(f"{name}_dow_sin"),
        F.cos(turn * day / 7).alias(f"{name}_dow_cos"),
        part(F.datediff(F.to_date(t), F.lit(REFERENCE_DAY).cast("date"))).alias(f"{name}_days_since_ref"),
        flag(F.weekday(t) >= 5).alias(f"{name}_is_weekend"),
    ]


def temporal_features(df: DataFrame, columns: list[str], keep: Iterable[str] = ()) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*(col(k) for k in keep), *(e for c in columns for e in temporal_expressions(c, kinds[c])))


# ---------------------------------------------------------------- the fitted whole


@dataclass
class FeatureModel:
    """Fitted transforms. ``transform`` keeps the key and gives features only, always the same columns."""

    roles: ColumnRoles
    scaler: dict[str, tuple[float, float]]
    multiplied: list[str]
    categories: DataFrame | None
    options: dict = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, roles: ColumnRoles | None = None, interaction_top_k: int = 10) -> FeatureModel:
        roles = roles or ColumnRoles.of(df)
        numeric, categories = list(roles.numeric), list(roles.categorical)
        fitted = fit_categories(df, categories).cache() if categories else None
        return cls(roles, fit_scaler(df, numeric), interaction_columns(df, numeric, interaction_top_k), fitted)

    def transform(self, df: DataFrame, frozen: bool = True) -> DataFrame:
        """``frozen``: frequencies as fitted; otherwise those of ``df``."""
        own = list(self.roles.categorical)
        if own:
            df = label_encode(df, self.categories, own)
            df = frequency_encode(df, own, self.categories if frozen else None)
        kinds = {f.name: f.dataType for f in df.schema}
        key = [col(self.roles.key)] if self.roles.key in df.columns else []
        return df.select(
            *key,
            *(e for c in self.roles.numeric for e in numeric_expressions(c, *self.scaler[c])),
            *interaction_expressions(self.multiplied),
            *(col(f"{c}_{x}") for c in own for x in ("encoded", "freq")),
            *(e for c in self.roles.temporal for e in temporal_expressions(c, kinds[c])),
        )

    def save(self, path: str, spark: SparkSession) -> None:
        """The state as tables, for a later session."""
        state = {"numeric": self.roles.numeric, "categorical": self.roles.categorical, "temporal": self.roles.temporal, "key": self.roles.key, "scaler": self.scaler, "multiplied": self.multiplied}
        spark.createDataFrame([(json.dumps(state),)], "state string").write.mode("overwrite").parquet(f"{path}/state")
        if self.categories is not None:
            self.categories.write.mode("overwrite").parquet(f"{path}/categories")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> FeatureModel:
        s = json.loads(spark.read.parquet(f"{path}/state").first().state)
        roles = ColumnRoles(tuple(s["numeric"]), tuple(s["categorical"]), tuple(s["temporal"]), s["key"])
        categories = spark.read.parquet(f"{path}/categories") if roles.categorical else None
        return cls(roles, {k: tuple(v) for k, v in s["scaler"].items()}, s["multiplied"], categories)


def fit_transform(train: DataFrame, other: DataFrame, roles: ColumnRoles | None = None) -> tuple[DataFrame, DataFrame, FeatureModel]:
    """Both tables' features by a model fitted on the first."""
    model = FeatureModel.fit(train, roles)
    return model.transform(train), model.transform(other), model


# ---------------------------------------------------------------- selection


def anova_scores(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, score): the F statistic of each column between the classes of the target.

    From counts, means and variances of each class, so that large means cost no digits; rows without target are left out,
    missing values are 0.
    """
    rows = long_form(df.filter(col(target).isNotNull()), columns, [target]).withColumn("value", F.coalesce("value", F.lit(0.0)))
    by_class = rows.groupBy("feature", col(target).alias("class")).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    # a row for each class
    own = Window.partitionBy("feature")
    held = by_class.withColumn("centre", F.sum(F.col("n") * F.col("m")).over(own) / F.sum("n").over(own))
    whole = held.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col("m") - F.col("centre")) ** 2).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    score = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    # classes that are told apart wholly
    return whole.select("feature", F.when((F.col("within") <= 0) & (F.col("between") > 0), float("inf")).otherwise(score).alias("score"))


def regression_scores(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, score): the F statistic of each column's linear fit to the target."""
    rows = df.filter(number(target).isNotNull())
    row = rows.agg(F.count("*").alias("n"), *(F.corr(filled(c), number(target)).alias(f"r{k}") for k, c in enumerate(columns)))
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"r{k}").alias("r")) for k, c in enumerate(columns)))
    found = row.select("n", F.explode(pairs).alias("p")).select("n", "p.feature", (F.col("p.r") * F.col("p.r")).alias("r2"))
    score = F.try_divide(F.col("r2"), 1 - F.col("r2")) * (F.col("n") - 2)
    return found.select("feature", F.when(F.col("r2") >= 1, float("inf")).otherwise(score).alias("score"))


def top_scores(scores: DataFrame, k: int) -> DataFrame:
    """The k best features; ties go by name."""
    return scores.orderBy(F.desc_nulls_last("score"), "feature").limit(k)


def select_features(df: DataFrame, columns: list[str], k: int, target: str | None = None, kind: str = "clusterer") -> tuple[DataFrame, list[str]]:
    """The k best columns and the table cut to them, other columns kept.

    Classifiers go by ANOVA F and regressors by regression F, both in the order of the input; without a target, by variance,
    in falling order.
    """
    k = min(k, len(columns))
    if target is None or kind == "clusterer":
        chosen = [r.feature for r in top_variances(df, columns, k).collect()]
    else:
        best = {r.feature for r in top_scores((anova_scores if kind == "classifier" else regression_scores)(df, columns, target), k).collect()}
        chosen = [c for c in columns if c in best]
    return df.select(*(col(c) for c in df.columns if c not in columns), *(col(c) for c in chosen)), chosen


# ---------------------------------------------------------------- further transforms


def min_max_scale(df: DataFrame, columns: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """Values from 0 to 1 by the table's least and greatest; a constant column gives 0."""
    row = df.agg(*(F.min(filled(c)).alias(f"a{k}") for k, c in enumerate(columns)), *(F.max(filled(c)).alias(f"b{k}") for k, c in enumerate(columns))).first()
    ends = {c: (row[f"a{k}"] or 0.0, row[f"b{k}"] or 0.0) for k, c in enumerate(columns)}
    return df.select(*(col(k) for k in keep), *(((filled(c) - ends[c][0]) / ((ends[c][1] - ends[c][0]) or 1.0)).alias(f"{c}_minmax") for c in columns))


def quantile_edges(df: DataFrame, columns: list[str], shares: list[float], exact: bool = True, accuracy: int = 10_000) -> dict[str, list[float]]:
    """Quantiles of each column: exact ones in ranges of its values, approximate ones in one pass."""
    if exact:
        found = {r.feature: r.quantiles for r in exact_quantiles(long_form(df.select(*(col(c) for c in columns)), columns), ["feature"], shares).collect()}
        return {c: list(found.get(c, [])) for c in columns}
    row = df.agg(*(F.percentile_approx(number(c), shares, accuracy).alias(f"q{k}") for k, c in enumerate(columns))).first()
    return {c: list(row[f"q{k}"] or []) for k, c in enumerate(columns)}


def robust_scale(df: DataFrame, columns: list[str], keep: Iterable[str] = (), exact: bool = True) -> DataFrame:
    """(value - median) / (third quartile - first), with a spread of 0 acting as 1."""
    q = quantile_edges(df, columns, [0.25, 0.5, 0.75], exact)
    return df.select(*(col(k) for k in keep), *(((filled(c) - q[c][1]) / ((q[c][2] - q[c][0]) or 1.0)).alias(f"{c}_robust") for c in columns))


def quantile_bins(df: DataFrame, columns: list[str], bins: int = 10, keep: Iterable[str] = (), exact: bool = True) -> DataFrame:
    """The bin of each value, from 0, by the table's inner quantiles; null stays null."""
    q = quantile_edges(df, columns, [k / bins for k in range(1, bins)], exact)
    edges = {c: F.array(*(F.lit(e) for e in sorted(set(q[c])))) for c in columns}
    return df.select(*(col(k) for k in keep), *(F.when(number(c).isNotNull(), bin_of(number(c), edges[c])).alias(f"{c}_bin") for c in columns))


def polynomial(df: DataFrame, columns: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """Degree two: each column, and each product of two, itself included."""
    out = [filled(c).alias(c) for c in columns if c not in keep]
    out += [(filled(a) * filled(b)).alias(f"{a}_x_{b}") for i, a in enumerate(columns) for b in columns[i:]]
    return df.select(*(col(k) for k in keep), *out)


#: Rows from which a key is dealt into ranges, and ranges of such a key.
HOT_ROWS, HOT_RANGES = 1_000_000, 64
#: Rows from which a key's rolling windows aren't left to frames, each of which is added up anew; and microseconds of a day.
ROLLED_ROWS, DAY = 2_000, 86_400_000_000


def _split_hot(df: DataFrame, key: str, most_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """(rows of other keys, rows of keys of more than ``most_rows``); None if there are no such keys. Those are few by their definition."""
    counts = df.groupBy(col(key).alias("_hot")).agg(F.count("*").alias("_n")).filter(F.col("_n") > most_rows)
    if counts.isEmpty():
        return None
    hot = kept(counts.select("_hot"))
    same = col(key).eqNullSafe(F.col("_hot"))
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def lags(df: DataFrame, key: str, order: list[str], value: str, periods: Iterable[int] = (1, 7, 30), most_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with the key's value so many rows before.

    Keys of more than ``most_rows`` are cut into blocks of as many rows by place in their order; a block gets the last rows of the one before, as many
    as the longest period, so that no task has such a key to itself.
    """
    periods = list(periods)
    split = _split_hot(df, key, most_rows) if periods else None

    def lagged(rows: DataFrame, by: list[Column], at: list[Column]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*at)
        return rows.select("*", *(F.lag(col(value), n).over(w).alias(f"{value}_lag_{n}") for n in periods))

    if split is None:
        return lagged(df, [col(key)], [col(o) for o in order])
    cold, hot = split
    # places: within a range of the order by a window, before it by the counts of earlier ranges of the key, of which each has one at most
    laid = kept(hot.repartitionByRange(HOT_RANGES, col(key), *(col(o) for o in order)).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = laid.groupBy(col(key).alias("_key"), "_part").agg(F.count("*").alias("_n")).select("_key", F.col("_part").alias("_of"), F.sum("_n").over(before).alias("_earlier")).filter("_earlier > 0")
    own = F.row_number().over(Window.partitionBy(col(key), "_part").orderBy(*(col(o) for o in order)))
    placed = laid.withColumn("_own", own).join(F.broadcast(earlier), col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")), "left")
    size = max(most_rows, *periods)
    place = F.col("_own") + F.coalesce("_earlier", F.lit(0)) - 1
    placed = placed.withColumn("_place", place).withColumn("_block", F.expr(f"_place div {size}"))
    halo = F.when(F.col("_place") % size >= size - max(periods), F.array("_block", F.col("_block") + 1)).otherwise(F.array("_block"))
    spread = placed.withColumn("_in", F.explode(halo))
    done = lagged(spread, [col(key), F.col("_in")], [F.col("_place")]).filter("_in = _block")
    columns = [*(col(c) for c in df.columns), *(F.col(f"`{value}_lag_{n}`") for n in periods)]
    return lagged(cold, [col(key)], [col(o) for o in order]).unionByName(done.select(*columns))


def rolling(df: DataFrame, key: str, time: str, value: str, days: Iterable[int] = (7, 30, 90), most_rows: int = ROLLED_ROWS) -> DataFrame:
    """``df`` with the key's mean and number of values in the days up to each row, that instant included.

    A window's frame is added up anew for each row, so keys of more than ``most_rows`` are done by :func:`_rolled_by_cells` instead, whose work doesn't hang on
    how many rows a window holds.
    """
    at, days = F.unix_micros(col(time).cast("timestamp")), list(days)
    split = _split_hot(df, key, most_rows) if days else None

    def rolled(rows: DataFrame) -> DataFrame:
        out = []
        for n in days:
            w = Window.partitionBy(col(key)).orderBy(at).rangeBetween(-n * DAY, 0)
            out += [F.avg(col(value)).over(w).alias(f"{value}_mean_{n}d"), F.count(col(value)).over(w).alias(f"{value}_count_{n}d")]
        return rows.select("*", *out)

    if split is None:
        return rolled(df)
    cold, hot = split
    one = rolled(cold)
    return one.unionByName(_rolled_by_cells(hot, key, at, value, days, one))


def _rolled_by_cells(hot: DataFrame, key: str, at: Column, value: str, days: list[int], like: DataFrame) -> DataFrame:
    """:func:`rolling` of keys of any number of rows, in the types of ``like``.

    Time is cut into cells as long as the window, so that a window is the end of one cell and the beginning of the next: two running sums, one to a row's
    instant and one down to that a window before it. No sum is taken from another, so no digits are lost. Instants are put together first; a cell is cut by
    ranges of the key's instants, whose totals are joined back, and no row is copied but for one that asks at a window's beginning.
    """
    kinds = {f.name: f.dataType for f in like.schema}
    own = col(value) if isinstance(kinds[value], T.DecimalType) else col(value).cast("double")
    instants = kept(hot.groupBy(col(key).alias("_key"), at.alias("_at")).agg(F.count(own).alias("_n"), F.coalesce(F.sum(own), F.lit(0)).alias("_s")))
    shares = [k / HOT_RANGES for k in range(1, HOT_RANGES)]
    ends = instants.groupBy(F.col("_key").alias("_of")).agg(F.array_distinct(F.percentile_approx("_at", shares, 1_000)).alias("_ends"))
    # each window's cells: an instant's own, with its values, and the one before, where it only asks
    asked = lambda n, place, asks: F.struct(F.lit(n).alias("_days"), place.alias("_place"), (place - F.pmod(place, F.lit(n * DAY))).alias("_cell"), F.lit(asks).alias("_asks"))
    spread = instants.join(F.broadcast(ends), F.col("_key").eqNullSafe(F.col("_of"))).select("_key", "_at", "_n", "_s", "_ends", F.inline(F.array(*(x for n in days for x in (asked(n, F.col("_at"), False), asked(n, F.col("_at") - n * DAY, True))))))
    spread = spread.filter("not _asks or _at is not null").withColumn("_in", F.coalesce(bin_of(F.col("_place"), F.col("_ends")), F.lit(0)))
    part = ["_key", "_days", "_cell", "_in"]
    values = (F.when(F.col("_asks"), F.lit(0)).otherwise(F.col(c)).alias(c) for c in ("_n", "_s"))
    held = kept(spread.select(*part, "_at", "_place", "_asks", *values))
    inside = Window.partitionBy(*part)
    up, down = (inside.orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("_place"), F.desc("_place")))
    summed = held.select(*part, "_at", "_asks", *(F.when(F.col("_asks"), F.sum(c).over(down)).otherwise(F.sum(c).over(up)).alias(c) for c in ("_n", "_s")))
    totals = held.groupBy(*part).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    ranges = Window.partitionBy("_key", "_days", "_cell").orderBy("_in")
    below, above = ranges.rowsBetween(Window.unboundedPreceding, -1), ranges.rowsBetween(1, Window.unboundedFollowing)
    others = totals.select(*(F.col(c).alias(f"_o{c}") for c in part), *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_{name}") for c in ("_n", "_s") for name, w in (("below", below), ("above", above))))
    pieces = summed.join(others, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in part)))
    piece = lambda c: F.col(c) + F.when(F.col("_asks"), F.col(f"{c}_above")).otherwise(F.col(f"{c}_below"))
    own_days = lambda c, n: F.sum(F.when(F.col("_days") == n, piece(c))).alias(f"{c}{n}")
    found = pieces.groupBy(F.col("_key").alias("_of"), F.col("_at").alias("_then")).agg(*(own_days(c, n) for n in days for c in ("_n", "_s")))
    columns = [x for n in days for x in (F.try_divide(F.col(f"_s{n}"), F.col(f"_n{n}")).cast(kinds[f"{value}_mean_{n}d"]).alias(f"{value}_mean_{n}d"), F.col(f"_n{n}").cast("bigint").alias(f"{value}_count_{n}d"))]
    return hot.join(found, col(key).eqNullSafe(F.col("_of")) & at.eqNullSafe(F.col("_then"))).select(*(col(c) for c in hot.columns), *columns)


def target_encode(df: DataFrame, column: str, target: str) -> DataFrame:
    """(value, n, target_mean) of each category, to be joined on."""
    return df.groupBy(_category(column).alias("value")).agg(F.count("*").alias("n"), F.avg(number(target)).alias("target_mean"))


def weight_of_evidence(df: DataFrame, column: str, event: Column, smoothing: float = 0.5) -> DataFrame:
    """(value, events, others, woe, iv): log odds of each category against the whole, and its part of the information value."""
    marked = df.select(_category(column).alias("value"), F.coalesce(event, F.lit(False)).alias("event"))
    counts = marked.groupBy("value").agg(F.count_if("event").alias("events"), F.count_if(~F.col("event")).alias("others"))
    whole = counts.agg(F.sum("events").alias("all_events"), F.sum("others").alias("all_others"))
    good = (F.col("events") + smoothing) / (F.col("all_events") + smoothing)
    bad = (F.col("others") + smoothing) / (F.col("all_others") + smoothing)
    woe = F.ln(good / bad)
    return counts.crossJoin(F.broadcast(whole)).select("value", "events", "others", woe.alias("woe"), ((good - bad) * woe).alias("iv"))


def one_hot(df: DataFrame, column: str, categories: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """A 0/1 column for each given category."""
    return df.select(*(col(k) for k in keep), *((flag(_category(column) == v)).alias(f"{column}_is_{v}") for v in categories))


def hash_buckets(df: DataFrame, column: str, buckets: int = 100) -> DataFrame:
    """``df`` with ``{column}_bucket``, for columns of very many categories; the hash is one that any engine has."""
    place = F.conv(F.substring(F.md5(_category(column)), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(f"{column}_bucket", F.pmod(place, F.lit(buckets)).cast("int"))


def hash_if_many(df: DataFrame, column: str, most: int = 50, buckets: int = 100) -> DataFrame:
    """Hash buckets if the column has more than ``most`` categories, else the table as it is."""
    n = df.agg(F.approx_count_distinct(_category(column))).first()[0]
    return hash_buckets(df, column, buckets) if n > most else df


def term_weights(df: DataFrame, text: str, key: str, features: int = 1 << 18) -> DataFrame:
    """(key, buckets, counts, tfidf): the buckets of each text's words in order, how often each comes, and counts times inverse document frequencies.

    A word is a run of ASCII letters, digits and underscores of the lower-cased text; its bucket is the first 32 bits of its MD5 by ``features``. The
    inverse frequency is ``ln((texts + 1) / (texts with the bucket + 1))``. Rows of one key are one text; null and empty texts have no buckets.
    Each task counts the words of its own rows, of a batch's words each once, so that neither words nor texts are shuffled; rows whose key comes again are put
    together after. Two columns of ``features`` rows at most, buckets and their frequencies, go through the driver.
    """
    spark = df.sparkSession
    # lower case as Spark has it
    own = df.select(col(key).alias("_key"), F.coalesce(F.lower(col(text)), F.lit("")).alias("_text"))
    kind = own.schema["_key"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            texts = batch.column(1)
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            while at < len(texts):  # rows of bounded size together
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_BYTES, "right")))
                lists = pc.split_pattern_regex(texts.slice(at, end - at), r"[^a-zA-Z0-9_]+")
                coded = lists.flatten().dictionary_encode()
                of = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % features if w else -1 for w in coded.dictionary.to_pylist()], np.int64)
                bucket = of[coded.indices.to_numpy(zero_copy_only=False)] if len(of) else np.zeros(0, np.int64)
                offsets = lists.offsets.to_numpy()
                row = np.repeat(np.arange(end - at), np.diff(offsets))
                cells, n = np.unique((row * features + bucket)[bucket >= 0], return_counts=True)
                ends = pa.array(np.searchsorted(cells, np.arange(end - at + 1) * features).astype(np.int32))
                held = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((cells % features).astype(np.int32), n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *held], ["_key", "_b", "_n"])
                at = end

    rows = kept(own.mapInArrow(counted, f"_key {kind}, _b array<int>, _n array<bigint>"))
    again = rows.groupBy(F.col("_key").alias("_of")).agg(F.count("*").alias("_c")).filter("_c > 1").select("_of")
    if not again.isEmpty():
        same = F.col("_key").eqNullSafe(F.col("_of"))
        split = rows.join(again, same, "left_semi").select("_key", F.inline_outer(F.arrays_zip("_b", "_n"))).groupBy("_key", "_b").agg(F.sum("_n").alias("_n"))
        whole = split.groupBy("_key").agg(F.array_sort(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_b", "_n")))).alias("_t")).select("_key", F.col("_t._b").alias("_b"), F.col("_t._n").alias("_n"))
        rows = kept(rows.join(again, same, "left_anti").unionByName(whole))
    found = rows.select(F.explode("_b").alias("_b")).groupBy("_b").agg(F.count("*").alias("_in")).toPandas()
    idf = np.zeros(features)
    idf[found["_b"].to_numpy(np.int64)] = np.log((rows.count() + 1) / (found["_in"].to_numpy(np.float64) + 1))
    shared = spark.sparkContext.broadcast(idf)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, n = batch.column(1), batch.column(2)
            w = shared.value[b.flatten().to_numpy(zero_copy_only=False)] * n.flatten().to_numpy(zero_copy_only=False)
            offsets = b.offsets.to_numpy()
            weights = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(w.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), b, n, weights], ["_key", "buckets", "counts", "tfidf"])

    out = rows.select("_key", "_b", "_n").mapInArrow(weighed, f"_key {kind}, buckets array<int>, counts array<bigint>, tfidf array<double>")
    return out.select(F.col("_key").alias(key), "buckets", "counts", "tfidf")


def drop_constant(df: DataFrame, columns: list[str], least: float = 0.01) -> list[str]:
    """Columns whose variance is above ``least``, in order."""
    kept = {r.feature for r in variances(df, columns).filter(F.col("variance") > least).collect()}
    return [c for c in columns if c in kept]


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, correlation) of each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(F.corr(filled(a), filled(b)).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)))
    return row.select(F.explode(rows).alias("p")).select("p.*")


def drop_correlated(df: DataFrame, columns: list[str], most: float = 0.95) -> list[str]:
    """Columns left when, of each pair correlated beyond ``most``, the later one goes."""
    strong = {(r.a, r.b) for r in correlations(df, columns).filter(F.abs("correlation") > most).collect()}
    kept: list[str] = []
    for c in columns:
        if not any((k, c) in strong for k in kept):
            kept.append(c)
    return kept


def mutual_information(df: DataFrame, column: str, target: str, bins: int = 10) -> DataFrame:
    """(feature, mutual_information) in nats, between the column's quantile bins and the target's classes."""
    binned = quantile_bins(df.filter(col(target).isNotNull()), [column], bins, [target])
    joint = binned.groupBy(F.coalesce(col(f"{column}_bin"), F.lit(-1)).alias("x"), col(target).cast("string").alias("y")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(0))  # as many rows as bins times classes
    p = F.col("n") / F.sum("n").over(whole)
    px, py = F.sum("n").over(Window.partitionBy("x")) / F.sum("n").over(whole), F.sum("n").over(Window.partitionBy("y")) / F.sum("n").over(whole)
    parts = joint.select((p * F.ln(p / (px * py))).alias("part"))
    return parts.agg(F.sum("part").alias("mutual_information")).select(F.lit(column).alias("feature"), "mutual_information")


def importance(model, columns: list[str], spark: SparkSession) -> DataFrame:
    """(feature, score) of a fitted MLlib tree model."""
    return spark.createDataFrame([(c, float(model.featureImportances[k])) for k, c in enumerate(columns)], "feature string, score double")


def select_by_importance(scores: DataFrame, share: float = 0.95) -> DataFrame:
    """(feature, score, place): the best features, as few as have ``share`` of all scores together; ties go by name.

    ``scores`` is (feature, score), as from :func:`importance`: a row for each feature, ordered in one task.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "feature")
    ranked = scores.filter("score > 0").withColumn("place", F.row_number().over(order).cast("bigint"))
    summed = ranked.withColumn("before", F.coalesce(F.sum("score").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    whole = summed.withColumn("whole", F.sum("score").over(Window.partitionBy(F.lit(0))))
    return whole.filter(F.col("before") < share * F.col("whole")).select("feature", "score", "place")


def sampled(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """``n`` rows drawn evenly: those of lowest hash of the keys. Each task keeps its own lowest only."""
    return df.orderBy(hex_hash(*keys, seed=seed), *(col(k) for k in keys)).limit(n)


def text_features(df: DataFrame, columns: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """Code points and words of each text column as doubles, 0 where it is missing."""
    words = lambda c: F.regexp_count(col(c), F.lit(r"[^\t\n\x0B\f\r ]+"))
    out = [F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"text_{name}_{c}") for c in columns for name, v in (("len", F.length(col(c))), ("words", words(c)))]
    return df.select(*(col(k) for k in keep), *out)


def feature_columns(df: DataFrame, exclude: Iterable[str] = ("record_id", "target_binary", "target_continuous")) -> list[str]:
    """Numeric columns that are neither ids, targets nor metadata (names beginning with an underscore)."""
    return [c for c in numeric_columns(df, exclude) if not c.startswith("_")]
