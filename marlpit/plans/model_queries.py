"""Scoring, evaluation and training over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.ml import metrics, training
from marlpit.plans.base import CUT_DAY, Query, rounded, table
from marlpit.plans.drift_queries import _PREDICTIONS, MODELS, predictions
from marlpit.sources.scratch import new_folder

EMBEDDED = 64


def scored_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models over one scan of the order lines."""
    return rounded(predictions(spark, sf_dir).select("model_id", "record_id", "prediction"))


def scores_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written by model, two models scored again, and all read back."""
    out = new_folder(spark, "scores")
    scored = predictions(spark, sf_dir).select("model_id", "record_id", "prediction")
    training.write_scores(scored, out)
    training.write_scores(scored.filter("model_id <> 'flat_model'"), out)
    return spark.read.parquet(out).groupBy("model_id").agg(F.count("*").alias("records"), F.count_distinct("record_id").alias("distinct_records"), F.round(F.sum("prediction"), 2).alias("total"))


def scored_by_python_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python model in Arrow batches, loaded once a task."""

    def load():
        return lambda frame: 2 * frame["p_size"] + frame["p_retailprice"] / 10

    return rounded(training.score_with(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"], load, "size_model"))


def results_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.results_valid(predictions(spark, sf_dir), len(MODELS))


def records_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.records_scored(predictions(spark, sf_dir))


def _scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a fixed score of their documents."""
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100 + F.col("toxic") * 0.2).alias("score"))


def metrics_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.binary_metrics(_scored_labels(spark, sf_dir), "toxic", "score", by=["quality"]).withColumn("quality", F.col("quality").cast("bigint")))


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc(_scored_labels(spark, sf_dir), "toxic", "score"), 8)


def metrics_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "events").withColumn("guess", F.col("value") * 0.5 + F.col("user_id") % 7)
    return rounded(metrics.regression_metrics(scored, "value", "guess", ["event_type"]))


def calinski_harabasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the labels as clusters, by all dimensions of the embeddings."""
    every = [F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(EMBEDDED)]
    return rounded(metrics.calinski_harabasz(table(spark, sf_dir, "embeddings").select("label", *every), [f"e{k}" for k in range(EMBEDDED)], "label"), 4)


def _order_metrics(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """(model_id, metric, value): order statuses as models."""
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    found = orders.groupBy(F.col("o_orderstatus").alias("model_id")).agg(F.avg("o_totalprice").alias("mean_price"), F.avg((F.col("o_custkey") % 2).cast("double")).alias("odd_share"))
    return found.unpivot("model_id", ["mean_price", "odd_share"], "metric", "value")


def cv_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("model_id"), (F.col("o_orderkey") % 5).alias("fold")).agg(F.avg("o_totalprice").alias("value"))
    return rounded(metrics.fold_summary(folds.withColumn("metric", F.lit("price"))), 3)


def champion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _order_metrics(spark, sf_dir)
    middle = found.groupBy("metric").agg(F.avg("value").alias("minimum"))
    thresholds = middle.withColumn("position", F.when(F.col("metric") == "mean_price", 0).otherwise(1))
    return metrics.champion_gate(found, thresholds)


def champion_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, day = table(spark, sf_dir, "orders"), F.lit(CUT_DAY).cast("timestamp_ntz")
    old, new = (_order_metrics(spark, sf_dir, orders.filter(c)) for c in (F.col("o_orderdate") < day, F.col("o_orderdate") >= day))
    return rounded(metrics.champion_challenger(old, new, "mean_price", 0.02), 3)


def train_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boosted classifier of returned lines, cross-validated."""
    lines = table(spark, sf_dir, "lineitem").withColumn("record_id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    _, folds = training.cross_validate(lines, "xgboost_classifier", ["l_quantity", "l_extendedprice", "l_discount"], "returned", "record_id", {"n_estimators": 10, "max_depth": 3})
    return folds


def train_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the embeddings, by all their dimensions."""
    wide = table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[k].alias(f"e{k}") for k in range(EMBEDDED)))
    features = [f"e{k}" for k in range(EMBEDDED)]
    models, _ = training.train_all(spark, wide, [{"model_id": "clusters", "model_type": "kmeans", "features": features, "parameters": {"n_clusters": 8}}], "vec_id")
    return training.score_models(wide, "vec_id", {"clusters": (models["clusters"], features)}).select("model_id", "record_id", "cluster_id")


def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of four sampled parameter sets for the price of an order."""
    orders = table(spark, sf_dir, "orders").withColumn("month", F.month("o_orderdate"))
    model, best, value = training.search(orders, "xgboost_regressor", ["o_custkey", "month"], "o_totalprice", "o_orderkey", {"max_depth": [3, 5], "n_estimators": [5, 10]}, trials=4)
    return orders.limit(1).select(F.lit(best["max_depth"]).alias("max_depth"), F.lit(best["n_estimators"]).alias("n_estimators"), F.lit(value).alias("r2"), F.lit(model.getNumTrees).alias("trees"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (scored_many, scores_written, scored_by_python_model, results_valid, records_scored, metrics_binary, auc, metrics_regression, calinski_harabasz, cv_mean_std, champion_gate, champion_challenger, train_gbt, train_kmeans, grid_search)
} | {"calinski_harabasz_whole": calinski_harabasz}

_LABELS = "l AS (SELECT quality, toxic, ((doc_id * 37) % 101) / 100 + toxic * 0.2::DOUBLE AS score FROM labels)"


def _metrics(source: str = "orders") -> str:
    return f"""SELECT o_orderstatus AS model_id, 'mean_price' AS metric, avg(o_totalprice) AS value FROM {source} GROUP BY 1 UNION ALL SELECT o_orderstatus, 'odd_share', avg((o_custkey % 2)::DOUBLE) FROM {source} GROUP BY 1"""


def _calinski_harabasz(n: int) -> str:
    sums = ", ".join(f"sum(e{k}) AS s{k}, sum(e{k} * e{k}) AS q{k}" for k in range(n))
    plus = lambda f: " + ".join(f(k) for k in range(n))
    return f"""WITH e AS (SELECT label, {', '.join(f'embedding[{k + 1}]::DOUBLE AS e{k}' for k in range(n))} FROM embeddings), c AS (SELECT label, count(*) AS n, {sums} FROM e GROUP BY 1),
        w AS (SELECT count(*) AS k, sum(n) AS n, sum({plus(lambda k: f'q{k}')}) AS q, sum(({plus(lambda k: f's{k} * s{k}')}) / n) AS c, {plus(lambda k: f'sum(s{k}) ** 2')} AS t FROM c)
        SELECT k AS n_clusters, round(((c - t / n) / (k - 1)) / ((q - c) / (n - k)), 4) AS calinski_harabasz FROM w"""


ORACLES: dict[str, str] = {
    "calinski_harabasz_whole": _calinski_harabasz(EMBEDDED),
    "scored_many": """SELECT 'price_model' AS model_id, l_orderkey * 10 + l_linenumber AS record_id, round(1.0 + l_extendedprice * 0.001 + l_discount * -5.0, 6) + 0.0 AS prediction FROM lineitem
        UNION ALL SELECT 'quantity_model', l_orderkey * 10 + l_linenumber, round(l_quantity * 0.5 + l_tax * 2.0, 6) FROM lineitem UNION ALL SELECT 'flat_model', l_orderkey * 10 + l_linenumber, 3.0::DOUBLE FROM lineitem""",
    "scores_written": "SELECT model_id, count(*) AS records, count(DISTINCT record_id) AS distinct_records, round(sum(prediction), 2) AS total FROM (SELECT 'price_model' AS model_id, l_orderkey * 10 + l_linenumber AS record_id, 1.0 + l_extendedprice * 0.001 + l_discount * -5.0 AS prediction FROM lineitem UNION ALL SELECT 'quantity_model', l_orderkey * 10 + l_linenumber, l_quantity * 0.5 + l_tax * 2.0 FROM lineitem UNION ALL SELECT 'flat_model', l_orderkey * 10 + l_linenumber, 3.0 FROM lineitem) GROUP BY 1",
    "scored_by_python_model": "SELECT 'size_model' AS model_id, p_partkey AS record_id, round(2 * p_size + p_retailprice / 10, 6) AS prediction FROM part",
    "results_valid": f"WITH {_PREDICTIONS} SELECT count(*) AS rows, count(DISTINCT model_id) AS models, count(*) FILTER (prediction IS NULL) AS null_predictions, count(DISTINCT model_id) = 3 AND count(*) FILTER (prediction IS NULL) = 0 AS valid FROM p",
    "records_scored": f"WITH {_PREDICTIONS} SELECT model_id, count(*) AS records FROM p GROUP BY 1",
    "metrics_binary": f"""WITH {_LABELS}, c AS (SELECT quality::BIGINT AS quality, count(*) FILTER (score >= 0.5 AND toxic = 1) AS tp, count(*) FILTER (score >= 0.5 AND toxic <> 1) AS fp, count(*) FILTER (score < 0.5 AND toxic = 1) AS fn, count(*) FILTER (score < 0.5 AND toxic <> 1) AS tn FROM l GROUP BY 1)
        SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""",
    "auc": f"""WITH {_LABELS}, s AS (SELECT score, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic <> 1) AS n FROM l GROUP BY 1), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM s)
        SELECT round(sum(p * (lower + n / 2)) / (sum(p) * sum(n)), 8) AS auc FROM c""",
    "metrics_regression": """WITH e AS (SELECT event_type, value, value * 0.5 + user_id % 7 AS guess FROM events WHERE value IS NOT NULL)
        SELECT event_type, round(sqrt(avg((value - guess) ** 2)), 6) AS rmse, round(avg(abs(value - guess)), 6) AS mae, round(1 - avg((value - guess) ** 2) / var_pop(value), 6) AS r2 FROM e GROUP BY 1""",
    "calinski_harabasz": _calinski_harabasz(EMBEDDED),
    "cv_mean_std": "WITH f AS (SELECT o_orderstatus AS model_id, o_orderkey % 5 AS fold, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2) SELECT model_id, 'price' AS metric, round(avg(value), 3) AS mean, round(stddev_pop(value), 3) AS std FROM f GROUP BY 1",
    "champion_gate": f"""WITH m AS ({_metrics()}), t AS (SELECT metric, avg(value) AS minimum FROM m GROUP BY 1), j AS (SELECT model_id, metric, value < minimum AS bad, (metric = 'odd_share')::INT AS position FROM m JOIN t USING (metric))
        SELECT model_id, CASE WHEN bool_or(bad) THEN 'rejected' ELSE 'promoted' END AS decision, arg_min(metric, position) FILTER (bad) AS failed_metric FROM j GROUP BY 1""",
    "champion_challenger": f"""WITH o AS ({_metrics(f"(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{CUT_DAY}')")}), n AS ({_metrics(f"(SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT_DAY}')")}),
        b AS (SELECT n.model_id, n.metric, n.value AS new, o.value AS old FROM n LEFT JOIN o USING (model_id, metric)),
        g AS (SELECT model_id, max(old) FILTER (metric = 'mean_price') AS champion, max(new) FILTER (metric = 'mean_price') AS challenger, count(*) FILTER (metric <> 'mean_price' AND new < old * 0.98) AS losses FROM b GROUP BY 1)
        SELECT model_id, round(champion, 3) AS champion, round(challenger, 3) AS challenger, (champion IS NULL OR challenger >= champion) AND losses = 0 AS promoted FROM g""",
}
