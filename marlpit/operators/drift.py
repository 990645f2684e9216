"""Drift between a reference and a current table, all features in one pass each.

Cumulative counts are taken within ranges of values whose totals are joined back, so that a feature with very many
distinct values is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.scalar import bin_of, col, common_columns, long_form, number, numeric_columns
from marlpit.operators.quantiles import exact_quantiles


BANDS = ((0.1, "none"), (0.2, "moderate"), (0.5, "significant"))


def shared_features(reference: DataFrame, current: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns of both tables, in the reference's order."""
    numeric = set(numeric_columns(reference, exclude)) & set(numeric_columns(current, exclude))
    return [c for c in common_columns(reference, current) if c in numeric]


def tagged(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(side, feature, value): side 0 is the reference, 1 the current table; missing values are left out."""
    one = long_form(reference.select(*(col(c) for c in columns)), columns).withColumn("side", F.lit(0))
    two = long_form(current.select(*(col(c) for c in columns)), columns).withColumn("side", F.lit(1))
    return one.unionByName(two).filter("value is not null")


def quantile_table(reference: DataFrame, columns: list[str], bins: int, mode: str, accuracy: int = 10_000) -> DataFrame:
    """(feature, edges): the sorted distinct inner quantiles of the reference; approximate ones are wrong by one in ``accuracy`` ranks at most."""
    shares = [k / bins for k in range(1, bins)]
    if mode == "exact":
        found = exact_quantiles(long_form(reference.select(*(col(c) for c in columns)), columns), ["feature"], shares)
        return found.select("feature", F.array_sort(F.array_distinct("quantiles")).alias("edges"))
    row = reference.agg(*(F.percentile_approx(number(c), shares, accuracy).alias(f"q{k}") for k, c in enumerate(columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.array_sort(F.array_distinct(f"q{k}")).alias("edges")) for k, c in enumerate(columns)))
    return row.select(F.explode(rows).alias("p")).select("p.*")


def histogram(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10, mode: str = "exact", accuracy: int = 10_000) -> DataFrame:
    """(feature, bin, ref_n, cur_n, bins): counts by the reference's quantile bins, those without rows included."""
    edges = quantile_table(reference, columns, bins, mode, accuracy).filter("edges is not null")
    values = tagged(reference, current, columns).join(F.broadcast(edges), "feature")  # a row for each column
    counts = values.groupBy("feature", bin_of(F.col("value"), F.col("edges")).alias("bin")).agg(F.count_if(F.col("side") == 0).alias("ref_n"), F.count_if(F.col("side") == 1).alias("cur_n"))
    every = edges.select("feature", (F.size("edges") + 1).alias("bins"), F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    return every.join(counts, ["feature", "bin"], "left").select("feature", "bin", F.coalesce("ref_n", F.lit(0)).alias("ref_n"), F.coalesce("cur_n", F.lit(0)).alias("cur_n"), "bins")


def psi(reference: DataFrame, current: DataFrame, columns: list[str] | None = None, bins: int = 10, mode: str = "exact", accuracy: int = 10_000) -> DataFrame:
    """(feature, psi): the population stability index. Features without values on either side are left out.

    ``exact``: the reference's quantiles, and one added to each count. ``approx``: approximate quantiles, no
    smoothing, and a share of 0.001 where a bin is empty.
    """
    columns = columns or shared_features(reference, current)
    counts = histogram(reference, current, columns, bins, mode, accuracy)
    own = counts.groupBy("feature").agg(F.sum("ref_n").alias("ref_all"), F.sum("cur_n").alias("cur_all")).filter("ref_all > 0 and cur_all > 0")
    held = counts.join(F.broadcast(own), "feature")
    if mode == "exact":
        r, c = (F.col("ref_n") + 1) / (F.col("ref_all") + F.col("bins")), (F.col("cur_n") + 1) / (F.col("cur_all") + F.col("bins"))
    else:
        share = lambda n, a: F.when(F.col(n) > 0, F.col(n) / F.col(a)).otherwise(0.001)
        r, c = share("ref_n", "ref_all"), share("cur_n", "cur_all")
    return held.groupBy("feature").agg(F.sum((c - r) * F.ln(c / r)).alias("psi"))


def psi_band(value: Column) -> Column:
    """What an index means."""
    out = None
    for most, name in BANDS:
        out = F.when(value < most, name) if out is None else out.when(value < most, name)
    return out.otherwise("severe")


def cumulative(reference: DataFrame, current: DataFrame, columns: list[str], ranges: int = 64) -> DataFrame:
    """(feature, value, next_value, f_ref, f_cur, ref_all, cur_all): both distribution functions at each distinct value.

    Values are dealt into ranges by approximate quantiles of the reference; sums run within a range and take up the
    totals of the ranges below.
    """
    edges = quantile_table(reference, columns, ranges, "approx")
    counts = tagged(reference, current, columns).groupBy("feature", "value").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))
    dealt = counts.join(F.broadcast(edges), "feature", "left").select("feature", "value", "r", "c", F.coalesce(bin_of(F.col("value"), F.col("edges")), F.lit(0)).alias("range"))
    totals = dealt.groupBy("feature", "range").agg(F.sum("r").alias("range_r"), F.sum("c").alias("range_c"), F.min("value").alias("first"))
    below = Window.partitionBy("feature").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    whole = Window.partitionBy("feature")
    offsets = totals.select(
        "feature",
        "range",
        F.coalesce(F.sum("range_r").over(below), F.lit(0)).alias("before_r"),
        F.coalesce(F.sum("range_c").over(below), F.lit(0)).alias("before_c"),
        F.sum("range_r").over(whole).alias("ref_all"),
        F.sum("range_c").over(whole).alias("cur_all"),
        F.lead("first").over(Window.partitionBy("feature").orderBy("range")).alias("next_first"),
    )
    inside = Window.partitionBy("feature", "range").orderBy("value")
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({"sr": F.sum("r").over(up_to), "sc": F.sum("c").over(up_to), "next": F.lead("value").over(inside)})
    held = summed.join(F.broadcast(offsets), ["feature", "range"]).filter("ref_all > 0 and cur_all > 0")
    return held.select(
        "feature",
        "value",
        F.coalesce("next", "next_first").alias("next_value"),
        ((F.col("sr") + F.col("before_r")) / F.col("ref_all")).alias("f_ref"),
        ((F.col("sc") + F.col("before_c")) / F.col("cur_all")).alias("f_cur"),
        "ref_all",
        "cur_all",
    )


def ks(reference: DataFrame, current: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, ks_statistic, ks_pvalue) of the two-sample Kolmogorov-Smirnov test, with the asymptotic p-value."""
    columns = columns or shared_features(reference, current)
    d = cumulative(reference, current, columns).groupBy("feature").agg(F.max(F.abs(F.col("f_ref") - F.col("f_cur"))).alias("ks_statistic"), F.first("ref_all").alias("n"), F.first("cur_all").alias("m"))
    lam = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m"))) * F.col("ks_statistic")
    d = d.withColumn("lam", lam)
    series = F.expr("aggregate(sequence(1, 100), 0.0D, (s, k) -> s + if(k % 2 = 1, 2, -2) * exp(-2.0D * k * k * lam * lam))")
    p = F.when(F.col("lam") < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    return d.select("feature", "ks_statistic", p.alias("ks_pvalue"))


def wasserstein(reference: DataFrame, current: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, wasserstein): the area between the two distribution functions."""
    columns = columns or shared_features(reference, current)
    steps = cumulative(reference, current, columns).filter("next_value is not null")
    return steps.groupBy("feature").agg(F.sum(F.abs(F.col("f_ref") - F.col("f_cur")) * (F.col("next_value") - F.col("value"))).alias("wasserstein"))


def mean_shift(reference: DataFrame, current: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, ref_mean, cur_mean, mean_shift): the means' distance in population deviations of the reference."""
    columns = columns or shared_features(reference, current)
    stats = tagged(reference, current, columns).groupBy("feature").agg(
        F.avg(F.when(F.col("side") == 0, F.col("value"))).alias("ref_mean"),
        F.stddev_pop(F.when(F.col("side") == 0, F.col("value"))).alias("ref_std"),
        F.avg(F.when(F.col("side") == 1, F.col("value"))).alias("cur_mean"),
    )
    shift = F.abs(F.col("cur_mean") - F.col("ref_mean")) / (F.col("ref_std") + 1e-8)
    return stats.filter("ref_mean is not null and cur_mean is not null").select("feature", "ref_mean", "cur_mean", shift.alias("mean_shift"))


def drift_table(reference: DataFrame, current: DataFrame, columns: list[str] | None = None, psi_threshold: float = 0.2, ks_threshold: float = 0.05, mode: str = "exact") -> DataFrame:
    """All measures of each feature. A feature has drifted if its index is above, or its p-value below, the threshold."""
    columns = columns or shared_features(reference, current)
    both = psi(reference, current, columns, mode=mode).join(ks(reference, current, columns), "feature").join(mean_shift(reference, current, columns), "feature")
    flags = both.withColumn("psi_drifted", F.col("psi") > psi_threshold).withColumn("ks_drifted", F.col("ks_pvalue") < ks_threshold)
    return flags.withColumn("is_drifted", F.col("psi_drifted") | F.col("ks_drifted"))


def drifted(table: DataFrame) -> DataFrame:
    """The rows of a drift table whose feature has drifted."""
    return table.filter("is_drifted")


def reference_of(history: DataFrame, run: str, current, choice: str = "training") -> DataFrame:
    """Rows that the run ``current`` is compared with: those of the first run (``training``), of the one before it
    (``previous``), or of the run that ``choice`` names. Runs are in the order of their values."""
    own = col(run)
    runs = history.select(own.alias("run")).distinct()
    if choice == "training":
        wanted = runs.agg(F.min("run").alias("run"))
    elif choice == "previous":
        wanted = runs.filter(F.col("run") < F.lit(current)).agg(F.max("run").alias("run"))
    else:
        wanted = runs.filter(F.col("run").cast("string") == choice)
    return history.join(F.broadcast(wanted.withColumnRenamed("run", "_run")), own == F.col("_run"), "left_semi")  # one row


def drift_summary(table: DataFrame) -> DataFrame:
    """(drifted, total, drift_pct) of a drift table; 0 percent if it is empty."""
    found = table.agg(F.count_if("is_drifted").alias("drifted"), F.count("*").alias("total"))
    return found.withColumn("drift_pct", F.coalesce(F.try_divide(100.0 * F.col("drifted"), F.col("total")), F.lit(0.0)))


def chi_square(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(feature, chi2, degrees): of the table of a category's counts on either side. Missing is a category."""
    one = reference.select(col(column).cast("string").alias("value"), F.lit(0).alias("side"))
    both = one.unionByName(current.select(col(column).cast("string").alias("value"), F.lit(1).alias("side")))
    counts = both.groupBy("value").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))
    whole = counts.agg(F.sum("r").alias("rs"), F.sum("c").alias("cs"))
    row, n = F.col("r") + F.col("c"), F.col("rs") + F.col("cs")
    part = lambda seen, side: (F.col(seen) - row * F.col(side) / n) ** 2 / (row * F.col(side) / n)
    held = counts.crossJoin(F.broadcast(whole)).filter("rs > 0 and cs > 0")
    return held.agg(F.sum(part("r", "rs") + part("c", "cs")).alias("chi2"), (F.count("*") - 1).alias("degrees")).select(F.lit(column).alias("feature"), "chi2", "degrees")
