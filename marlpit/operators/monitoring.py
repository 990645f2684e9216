"""Statistics of predictions, alert rules and the whole monitoring run, over one long table of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.operators import checks, drift, features
from marlpit.operators.quantiles import exact_quantiles
from marlpit.sources.scratch import kept

CONSTANT = 1e-10
PREDICTION_COLUMNS = ("prediction", "probability", "cluster_id", "error")


def _has(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or nulls where the table hasn't got it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _quantiles(predictions: DataFrame, wanted: dict[str, list[tuple[str, float]]], exact: bool) -> DataFrame:
    """(model_id, one column for each name): quantiles of columns by model, given as {column: [(name, share)]}."""
    shares = sorted({s for own in wanted.values() for _, s in own})
    values = predictions.filter("model_id is not null").select("model_id", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in wanted))).alias("p")).select("model_id", "p.*")
    if exact:
        found = exact_quantiles(values, ["model_id", "feature"], shares)
    else:
        found = values.groupBy("model_id", "feature").agg(F.percentile_approx("value", shares, 10_000).alias("quantiles"))
    own = [F.max(F.when(F.col("feature") == c, F.get("quantiles", F.lit(shares.index(s))))).alias(n) for c, names in wanted.items() for n, s in names]
    return found.groupBy("model_id").agg(*own)


def prediction_stats(predictions: DataFrame, exact: bool = True) -> DataFrame:
    """A row for each model: count, mean, std, min, max, 10th, 50th and 90th percentile of its predictions.

    Exact percentiles are found in ranges of values, so that a model's predictions aren't gathered in one task.
    """
    found = predictions.groupBy("model_id").agg(
        F.count("*").alias("record_count"),
        F.avg("prediction").alias("pred_mean"),
        F.stddev_samp("prediction").alias("pred_std"),
        F.min("prediction").alias("pred_min"),
        F.max("prediction").alias("pred_max"),
    )
    q = _quantiles(predictions, {"prediction": [("pred_p10", 0.1), ("pred_median", 0.5), ("pred_p90", 0.9)]}, exact)
    return found.join(q, "model_id", "left")


def prediction_distribution(predictions: DataFrame, exact: bool = True) -> DataFrame:
    """A row for each model: moments and median of predictions, quantiles of probabilities, clusters, errors, and a warning.

    The warning is ``constant_predictions`` below a deviation of 1e-10, else ``single_value`` if there is one value only.
    """
    p = predictions.select("model_id", _has(predictions, "prediction", "double").alias("prediction"), _has(predictions, "probability", "double").alias("probability"), _has(predictions, "cluster_id", "int").alias("cluster_id"), _has(predictions, "error", "string").alias("error"))
    found = p.groupBy("model_id").agg(
        F.count("*").alias("total_records"),
        F.avg("prediction").alias("pred_mean"),
        F.stddev_samp("prediction").alias("pred_std"),
        F.min("prediction").alias("pred_min"),
        F.max("prediction").alias("pred_max"),
        F.avg("probability").alias("prob_mean"),
        F.count("error").alias("error_count"),
    )
    q = _quantiles(p, {"prediction": [("pred_median", 0.5)], "probability": [("prob_p10", 0.1), ("prob_p50", 0.5), ("prob_p90", 0.9)]}, exact)
    found = found.join(q, "model_id", "left")
    single = F.col("pred_min") == F.col("pred_max")
    warning = F.when(F.col("pred_std") < CONSTANT, "constant_predictions").when(single, "single_value")
    found = found.withColumn("error_rate", F.col("error_count") / F.col("total_records")).withColumn("warning", warning)
    if "cluster_id" not in predictions.columns:
        return found
    return found.join(cluster_sizes(predictions), "model_id", "left")


def cluster_sizes(predictions: DataFrame) -> DataFrame:
    """(model_id, n_clusters, cluster_sizes): a map from cluster to its number of records."""
    counts = predictions.filter("cluster_id is not null").groupBy("model_id", "cluster_id").agg(F.count("*").alias("n"))
    return counts.groupBy("model_id").agg(F.count("*").alias("n_clusters"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("cluster_id", "n")))).alias("cluster_sizes"))


def inference_summary(predictions: DataFrame) -> DataFrame:
    """A row for each model: records, moments of predictions and probabilities, number of clusters, errors."""
    return predictions.groupBy("model_id").agg(
        F.count("*").alias("total_records"),
        F.avg(_has(predictions, "prediction", "double")).alias("prediction_mean"),
        F.stddev_samp(_has(predictions, "prediction", "double")).alias("prediction_std"),
        F.min(_has(predictions, "prediction", "double")).alias("prediction_min"),
        F.max(_has(predictions, "prediction", "double")).alias("prediction_max"),
        F.avg(_has(predictions, "probability", "double")).alias("prob_mean"),
        F.stddev_samp(_has(predictions, "probability", "double")).alias("prob_std"),
        F.count_distinct(_has(predictions, "cluster_id", "int")).alias("n_clusters"),
        F.count(_has(predictions, "error", "string")).alias("error_count"),
    )


def alerts(summary: DataFrame, quality: DataFrame, distribution: DataFrame | None = None) -> DataFrame:
    """(severity, type, message): rules over a drift summary, a profile and prediction distributions.

    More than half of the features drifted is P1, else more than a fifth P2; any column with an issue P3; a model
    that predicts one value P1.
    """
    pct = F.col("drift_pct")
    text = F.format_string("%.1f%% of features show drift", pct)
    drifted = summary.filter(pct > 20).select(F.when(pct > 50, "P1").otherwise("P2").alias("severity"), F.lit("feature_drift").alias("type"), text.alias("message"))
    issues = quality.agg(F.count_if("has_issue").alias("n")).filter("n > 0")
    bad = issues.select(F.lit("P3").alias("severity"), F.lit("data_quality").alias("type"), F.format_string("%d features have data quality issues", "n").alias("message"))
    out = drifted.unionByName(bad)
    if distribution is not None:
        flat = distribution.filter(F.col("pred_std") < CONSTANT)
        out = out.unionByName(flat.select(F.lit("P1").alias("severity"), F.lit("constant_predictions").alias("type"), F.concat(F.lit("model "), "model_id", F.lit(" predicts one value")).alias("message")))
    return out


def feature_alerts(table: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(severity, type, message) of each feature whose stability index is above the threshold."""
    bad = table.filter(F.col("psi") > threshold)
    return bad.select(F.when(F.col("psi") > 0.5, "P1").otherwise("P2").alias("severity"), F.lit("feature_psi").alias("type"), F.format_string("%s: %.4f", "feature", "psi").alias("message"))


def metric_drop(before: DataFrame, after: DataFrame, metric: str = "roc_auc", most: float = 0.05) -> DataFrame:
    """(model_id, before, after, drop, flagged) of one metric's tables (model_id, metric, value)."""
    one = before.filter(F.col("metric") == metric).select("model_id", F.col("value").alias("before"))
    two = after.filter(F.col("metric") == metric).select("model_id", F.col("value").alias("after"))
    drop = F.try_divide(F.col("before") - F.col("after"), F.col("before"))
    return one.join(two, "model_id").select("model_id", "before", "after", drop.alias("drop"), F.coalesce(drop > most, F.lit(False)).alias("flagged"))


def run(reference: DataFrame, current: DataFrame, predictions: DataFrame | None = None, psi_threshold: float = 0.2, ks_threshold: float = 0.05, most_nulls: float = 0.1) -> dict[str, DataFrame]:
    """The monitoring run: tables ``drift``, ``quality``, ``predictions`` and ``alerts``."""
    # a row for each feature, written once, as alerts and roll-ups read them again
    table = kept(drift.drift_table(reference, current, psi_threshold=psi_threshold, ks_threshold=ks_threshold))
    quality = kept(checks.profile(current, most_nulls=most_nulls))
    out = {"drift": table, "quality": quality}
    if predictions is not None:
        out["predictions"] = kept(prediction_distribution(predictions))
    out["alerts"] = alerts(drift.drift_summary(table), quality, out.get("predictions"))
    return out


def sampled_report(reference: DataFrame, current: DataFrame, columns: list[str], keys: list[str], rows: int = 10_000, seed: int = 42) -> DataFrame:
    """(feature, ref_mean, cur_mean, mean_shift, null_rate) of at most so many rows of either table, drawn by hash of the keys."""
    one, two = (kept(features.sampled(df.select(*keys, *columns), rows, keys, seed)) for df in (reference, current))
    nulls = checks.profile(two, columns).select("feature", "null_rate")
    return drift.mean_shift(one, two, columns).join(nulls, "feature")


def successful(training: DataFrame) -> DataFrame:
    """The models whose training ended well: (model_id), each once."""
    return training.filter(F.col("status") == "success").select("model_id").distinct()


def save(results: dict[str, DataFrame], path: str) -> None:
    """Each table under the path: alerts as JSON, the others as Parquet."""
    for name, df in results.items():
        writer = df.write.mode("overwrite")
        (writer.json if name == "alerts" else writer.parquet)(f"{path}/{name}")


def roll_up(training: DataFrame, predictions: DataFrame, alert_rows: DataFrame, table: DataFrame, distribution: DataFrame | None = None) -> DataFrame:
    """One row for the whole run: models trained and failed, predictions, drifted features and alerts by severity.

    With the predictions' ``distribution``, which has a row for each model, predictions are counted from it and not read again.
    """
    t = training.agg(F.count_if(F.col("status") == "success").alias("models_ok"), F.count_if(F.col("status") != "success").alias("models_failed"))
    if distribution is None:
        p = predictions.agg(F.count("*").alias("predictions"), F.count_distinct("model_id").alias("models_scored"))
    else:
        p = distribution.agg(F.coalesce(F.sum("total_records"), F.lit(0)).alias("predictions"), F.count("model_id").alias("models_scored"))
    a = alert_rows.agg(*(F.count_if(F.col("severity") == s).alias(f"alerts_{s.lower()}") for s in ("P1", "P2", "P3")))
    return t.crossJoin(p).crossJoin(a).crossJoin(drift.drift_summary(table))
