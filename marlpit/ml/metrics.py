"""Evaluation as aggregates over tables of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.scalar import bin_of, col, hex_hash


def _counted(condition: Column, weight: str | None) -> Column:
    """How many rows meet the condition, each as often as its weight says."""
    return F.count_if(condition) if weight is None else F.coalesce(F.sum(F.when(condition, col(weight))), F.lit(0))


def binary_metrics(scored: DataFrame, label: str, score: str, threshold: float = 0.5, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Confusion counts, precision, recall, F1 and accuracy at a threshold, for each group; a row stands for as many as ``weight`` says."""
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    rows = scored.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    found = rows.groupBy(*(by or [])).agg(*(_counted(c, weight).alias(n) for n, c in (("tp", hit & true), ("fp", hit & ~true), ("fn", ~hit & true), ("tn", ~hit & ~true))))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return found.withColumns({"precision": zero(tp, tp + fp), "recall": zero(tp, tp + fn), "f1": zero(2 * tp, 2 * tp + fp + fn), "accuracy": zero(tp + tn, tp + fp + fn + tn)})


def auc(scored: DataFrame, label: str, score: str, ranges: int = 64, weight: str | None = None) -> DataFrame:
    """(auc): the chance that a positive scores above a negative, ties counting half; null without rows of both kinds. A row stands for as many as ``weight`` says.

    Scores are dealt into ranges, so that no task sees all of them in order.
    """
    rows = scored.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = rows.groupBy(F.col(score).cast("double").alias("s")).agg(_counted(F.col(label) == 1, weight).alias("p"), _counted(F.col(label) != 1, weight).alias("n"))
    edges = rows.agg(F.percentile_approx(F.col(score).cast("double"), [k / ranges for k in range(1, ranges)], 10_000).alias("edges")).select(F.array_distinct("edges").alias("edges"))
    dealt = counts.crossJoin(F.broadcast(edges)).select("s", "p", "n", F.coalesce(bin_of(F.col("s"), F.col("edges")), F.lit(0)).alias("range"))
    below = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = dealt.groupBy("range").agg(F.sum("n").alias("range_n")).select("range", F.coalesce(F.sum("range_n").over(below), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.withColumn("lower", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(offsets), "range")
    wins = F.sum(F.col("p") * (F.col("lower") + F.col("before") + F.col("n") / 2))
    return held.agg(F.try_divide(wins, (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def regression_metrics(scored: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(rmse, mae, r2) for each group."""
    y, d = F.col(label).cast("double"), F.col(label).cast("double") - F.col(score).cast("double")
    found = scored.filter(d.isNotNull()).groupBy(*(by or [])).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.var_pop(y).alias("spread"))
    return found.select(*(by or []), F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide(F.col("mse"), F.col("spread"))).alias("r2"))


def calinski_harabasz(assigned: DataFrame, features: list[str], cluster: str = "prediction") -> DataFrame:
    """(n_clusters, calinski_harabasz): spread between clusters over spread within, from sums of each."""
    sums = [e for k, c in enumerate(features) for e in (F.sum(c).alias(f"s{k}"), F.sum(F.col(c) * F.col(c)).alias(f"q{k}"))]
    own = assigned.groupBy(cluster).agg(F.count("*").alias("n"), *sums)
    total = lambda f: sum((f(k) for k in range(1, len(features))), f(0))
    whole = own.agg(F.count("*").alias("n_clusters"), F.sum("n").alias("rows"), F.sum(total(lambda k: F.col(f"q{k}"))).alias("squares"), F.sum(total(lambda k: F.col(f"s{k}") ** 2) / F.col("n")).alias("centres"), *(F.sum(f"s{k}").alias(f"t{k}") for k in range(len(features))))
    middle = total(lambda k: F.col(f"t{k}") ** 2) / F.col("rows")
    between, within = F.col("centres") - middle, F.col("squares") - F.col("centres")
    value = F.try_divide(between / (F.col("n_clusters") - 1), within / (F.col("rows") - F.col("n_clusters")))
    return whole.select("n_clusters", F.when(F.col("n_clusters") > 1, value).alias("calinski_harabasz"))


def fold_of(key: Column, folds: int, seed: int = 42) -> Column:
    """A fold for each key, stable and even."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def stratified_fold(df: DataFrame, key: str, target: str, folds: int) -> DataFrame:
    """``df`` with ``fold``: each class is dealt evenly over the folds. Classes are dealt in 256 parts by hash of the key, so that no task has a whole class."""
    mark = hex_hash(key)
    part = F.conv(F.substring(mark, 1, 2), 16, 10).cast("int")
    order = Window.partitionBy(col(target), part).orderBy(mark, col(key))
    return df.withColumn("fold", ((F.row_number().over(order) + part) % folds).cast("int"))


def fold_summary(folds: DataFrame) -> DataFrame:
    """(model_id, metric, mean, std) over folds (model_id, fold, metric, value); the deviation is the population's."""
    return folds.groupBy("model_id", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


class UnknownMetric(ValueError):
    """Raised where a threshold names a metric that no model has."""


def champion_gate(metrics: DataFrame, thresholds: DataFrame, enabled: bool = True) -> DataFrame:
    """(model_id, decision, failed_metric): ``rejected`` where a metric is below its minimum, else ``promoted``.

    metrics: (model_id, metric, value); thresholds: (metric, minimum, position). Of several failures the first by
    position is named. A threshold on a metric that no model has is an error; a model that lacks it is rejected.
    """
    models = metrics.select("model_id").distinct()
    if not enabled:
        return models.select("model_id", F.lit("auto_promoted").alias("decision"), F.lit(None).cast("string").alias("failed_metric"))
    unknown = thresholds.join(metrics.select("metric").distinct(), "metric", "left_anti").select("metric").collect()
    if unknown:
        raise UnknownMetric(", ".join(sorted(r.metric for r in unknown)))
    asked = models.crossJoin(F.broadcast(thresholds))  # a row for each model and threshold
    held = asked.join(metrics, ["model_id", "metric"], "left")
    bad = F.col("value").isNull() | (F.col("value") < F.col("minimum"))
    found = held.groupBy("model_id").agg(F.min_by(F.when(bad, F.col("metric")), F.when(bad, F.col("position"))).alias("failed_metric"), F.count_if(bad).alias("failures"))
    return found.select("model_id", F.when(F.col("failures") > 0, "rejected").otherwise("promoted").alias("decision"), F.when(F.col("failures") > 0, F.col("failed_metric")).alias("failed_metric"))


def champion_challenger(champion: DataFrame, challenger: DataFrame, primary: str, most_loss: float = 0.02) -> DataFrame:
    """(model_id, champion, challenger, promoted): the challenger's primary metric is no worse, and no other falls by more than ``most_loss``.

    Both tables are (model_id, metric, value); a model without a champion is promoted.
    """
    both = challenger.select("model_id", "metric", F.col("value").alias("new")).join(champion.select("model_id", "metric", F.col("value").alias("old")), ["model_id", "metric"], "left")
    main = F.col("metric") == primary
    found = both.groupBy("model_id").agg(
        F.max(F.when(main, F.col("old"))).alias("champion"),
        F.max(F.when(main, F.col("new"))).alias("challenger"),
        F.count_if(~main & (F.col("new") < F.col("old") * (1 - most_loss))).alias("losses"),
    )
    better = F.col("champion").isNull() | (F.col("challenger") >= F.col("champion"))
    return found.select("model_id", "champion", "challenger", F.coalesce(better & (F.col("losses") == 0), F.lit(False)).alias("promoted"))
