"""Training by MLlib on the executors, and scoring of many models over one scan."""

from __future__ import annotations

import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions.scalar import col, filled
from marlpit.ml import metrics

#: Model types, and what their parameters are called here.
KINDS = {"xgboost_classifier": "classifier", "lightgbm_classifier": "classifier", "xgboost_regressor": "regressor", "lightgbm_regressor": "regressor", "kmeans": "clusterer"}
NAMES = {"max_depth": "maxDepth", "learning_rate": "stepSize", "n_estimators": "maxIter", "subsample": "subsamplingRate", "n_clusters": "k", "random_state": "seed", "max_iter": "maxIter"}
BEST_BY = {"classifier": "roc_auc", "regressor": "r2", "clusterer": "silhouette_score"}
#: Ranks at which a feature's values are taken to choose its bins, the accuracy of those ranks, and counted rows of a task.
RANKS, ACCURACY, ROWS = 1000, 2000, 50_000
RESULTS = "model_id string, run_id string, metric string, value double, status string, error string"


def category(model_type: str) -> str:
    """Whether a model type classifies, regresses or clusters."""
    found = KINDS.get(model_type) or next((k for k in ("classifier", "regressor") if k in model_type), None)
    if found is None:
        raise ValueError(f"unknown model type {model_type}")
    return found


def create(model_type: str, parameters: dict | None = None, label: str = "label", features: str = "features"):
    """An estimator; parameters that it hasn't got are left out."""
    kind = category(model_type)
    given = {NAMES.get(k, k): v for k, v in (parameters or {}).items()}
    if kind == "clusterer":
        made = KMeans(featuresCol=features, seed=42)
    else:
        made = (GBTClassifier if kind == "classifier" else GBTRegressor)(featuresCol=features, labelCol=label, seed=42, maxIter=20)
    return made.copy({made.getParam(k): v for k, v in given.items() if made.hasParam(k)})


def assemble(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """The kept columns and a vector of the features, missing ones 0."""
    ready = df.select(*(col(k) for k in keep), *(filled(c).alias(f"_f{k}") for k, c in enumerate(features)))
    made = VectorAssembler(inputCols=[f"_f{k}" for k in range(len(features))], outputCol="features").transform(ready)
    return made.select(*(col(k) for k in keep), "features")


def _evaluator(kind: str, label: str):
    if kind == "classifier":
        return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction")
    return RegressionEvaluator(labelCol=label, metricName="r2") if kind == "regressor" else ClusteringEvaluator()


def sampled_grid(space: dict[str, list], trials: int, seed: int = 42) -> list[dict]:
    """At most ``trials`` different parameter sets of a discrete space, in an order that the seed gives."""
    names = sorted(space)
    every = [dict(zip(names, v, strict=True)) for v in product(*(space[n] for n in names))]
    return random.Random(seed).sample(every, min(trials, len(every)))


def search(df: DataFrame, model_type: str, features: list[str], target: str | None, key: str, space: dict[str, list], trials: int = 4, folds: int = 3, parallelism: int = 2) -> tuple[Model, dict, float]:
    """The best model of a sampled grid, refitted on all rows, with its parameters and the metric it was chosen by.

    Folds are stable hashes of the key, for classifiers dealt evenly within each class. Clusterers go by silhouette, -1 where there is one cluster only.
    """
    kind, grid = category(model_type), sampled_grid(space, trials)
    data = _training_rows(df, features, target, key, folds, kind == "classifier").cache()
    try:
        if kind == "clusterer":
            best = None
            for parameters in grid:
                model = create(model_type, parameters).fit(data)
                value = cluster_metrics(model, data)["silhouette_score"]
                if best is None or value > best[2]:
                    best = (model, parameters, value)
            return best
        estimator = create(model_type)
        maps = [{estimator.getParam(NAMES.get(k, k)): v for k, v in p.items() if estimator.hasParam(NAMES.get(k, k))} for p in grid]
        found = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=_evaluator(kind, "label"), numFolds=folds, foldCol="fold", parallelism=parallelism).fit(data)
        k = max(range(len(grid)), key=lambda j: found.avgMetrics[j])
        return found.bestModel, grid[k], found.avgMetrics[k]
    finally:
        data.unpersist()


def _training_rows(df: DataFrame, features: list[str], target: str | None, key: str, folds: int, stratified: bool = False) -> DataFrame:
    if target is None:
        return assemble(df, features, [key]).withColumn("fold", metrics.fold_of(col(key), folds))
    rows = df.filter(col(target).isNotNull()).withColumn("label", col(target).cast("double"))
    ready = assemble(rows, features, [key, "label"])
    return metrics.stratified_fold(ready, key, "label", folds) if stratified else ready.withColumn("fold", metrics.fold_of(col(key), folds))


def silhouette(assigned: DataFrame, cluster: str = "prediction", rows: int | None = None, keys: list[str] | None = None) -> float:
    """Mean silhouette of rows with ``features`` and a cluster, of at most ``rows`` drawn by hash of the keys; -1 with one cluster."""
    from marlpit.operators.features import sampled

    some = sampled(assigned, rows, keys or [cluster]) if rows else assigned
    own = some.select("features", col(cluster).cast("double").alias("prediction"))
    return ClusteringEvaluator().evaluate(own) if own.select("prediction").distinct().count() > 1 else -1.0


def cluster_metrics(model: Model, data: DataFrame, rows: int | None = None, keys: list[str] | None = None) -> dict[str, float]:
    """Clusters, silhouette (of a sample if ``rows`` is given), inertia."""
    assigned = model.transform(data)
    n = assigned.select("prediction").distinct().count()
    value = silhouette(assigned, "prediction", rows, keys)
    return {"n_clusters": float(n), "silhouette_score": value, "inertia": model.summary.trainingCost}


def cross_validate(df: DataFrame, model_type: str, features: list[str], target: str, key: str, parameters: dict | None = None, folds: int = 3) -> tuple[Model, DataFrame]:
    """A model fitted on all rows, and (fold, metric, value) of models that each left one fold out.

    Classifiers are fitted to, and scored on, counted bins of rows (see :func:`_counted`), so their turns don't grow with the table.
    """
    kind = category(model_type)
    if kind == "classifier":
        return _cross_validated_classes(df, model_type, features, target, key, parameters, folds)
    data = _training_rows(df, features, target, key, folds).cache()
    rows = []
    for k in range(folds):
        model = create(model_type, parameters).fit(data.filter(F.col("fold") != k))
        row = metrics.regression_metrics(model.transform(data.filter(F.col("fold") == k)), "label", "prediction").first()
        rows += [(k, m, None if v is None else float(v)) for m, v in {"rmse": row.rmse, "mae": row.mae, "r2": row.r2}.items()]
    model = create(model_type, parameters).fit(data)
    data.unpersist()
    return model, df.sparkSession.createDataFrame(rows, "fold int, metric string, value double")


def _cross_validated_classes(df: DataFrame, model_type: str, features: list[str], target: str, key: str, parameters: dict | None, folds: int) -> tuple[Model, DataFrame]:
    names = [f"_f{k}" for k in range(len(features))]
    given = df.filter(col(target).isNotNull()).select(col(key), col(target).cast("double").alias("label"), *(filled(f).alias(n) for f, n in zip(features, names, strict=True)))
    estimator = create(model_type, parameters).setWeightCol("weight")
    turns = [*range(folds), None]  # at last no fold is left out
    # folds are dealt once, and the columns kept are those that trees look at
    data = metrics.stratified_fold(given, key, "label", folds).select("fold", "label", *names).cache()
    places = _places(data, names, turns, estimator.getMaxBins())
    # one pass over the rows for all turns: between the edges of all of them, rows are alike to each
    alike = _counted(data.withColumn("weight", F.lit(1.0)), [_leaves(sorted({e for own in places for e in _edges(own[j])})) for j in range(len(names))], names).cache()
    parts = 1 + alike.count() // ROWS
    data.unpersist()

    def fitted(k: int | None, own: list[list[float]]) -> tuple[Model, list[tuple]]:
        counted = _counted(alike, [(_edges(p), p) for p in own], names)
        binned = VectorAssembler(inputCols=names, outputCol="features").transform(counted).select("fold", "label", "features", "weight").coalesce(parts).cache()
        model = estimator.fit(binned if k is None else binned.filter(F.col("fold") != k))
        found = []
        if k is not None:
            scored = model.transform(binned.filter(F.col("fold") == k)).withColumn("p", vector_to_array("probability")[1])
            row = metrics.binary_metrics(scored, "label", "p", weight="weight").crossJoin(metrics.auc(scored, "label", "p", weight="weight")).first()
            found = [(k, m, None if v is None else float(v)) for m, v in {"roc_auc": row.auc, "f1": row.f1, "precision": row.precision, "recall": row.recall, "accuracy": row.accuracy}.items()]
        binned.unpersist()
        return model, found

    done = [fitted(k, own) for k, own in zip(turns, places, strict=True)]
    alike.unpersist()
    return done[-1][0], df.sparkSession.createDataFrame([r for _, found in done for r in found], "fold int, metric string, value double")


def _places(data: DataFrame, names: list[str], turns: list[int | None], bins: int) -> list[list[list[float]]]:
    """For each turn and feature the values that stand for its bins, chosen by ranks within each of the turn's training folds."""
    ranks = F.array(*(F.lit((j + 0.5) / RANKS) for j in range(RANKS)))
    found = data.groupBy("fold").agg(F.count("*").alias("n"), *(F.percentile_approx(n, ranks, ACCURACY).alias(n) for n in names), *(F.array(F.min(n), F.max(n)).alias(f"{n}_ends") for n in names)).collect()
    out = []
    for k in turns:
        held = [r for r in found if r.fold != k]
        out.append([_spread([(v, r.n / RANKS) for r in held for v in r[n]] + [(v, 1.0) for r in held for v in r[f"{n}_ends"]], bins) for n in names])
    return out


def _spread(weighted: list[tuple[float, float]], bins: int) -> list[float]:
    """At most ``bins`` of the values, with about the same weight around each; a frequent value has a bin of its own and weighs no more than that."""
    kinds, at = np.unique(np.array([v for v, _ in weighted], float), return_inverse=True)
    if len(kinds) <= bins:
        return kinds.tolist() or [0.0]
    weight = np.bincount(at, [w for _, w in weighted])
    for _ in weighted:
        most = weight.sum() / bins
        if weight.max() <= most * (1 + 1e-9):
            break
        weight = np.minimum(weight, most)
    return kinds[np.unique(np.searchsorted(np.cumsum(weight), (np.arange(bins) + 0.5) * weight.sum() / bins))].tolist()


def _edges(places: list[float]) -> list[float]:
    """Midway between places, where MLlib cuts between values too: so rows score as the places of their bins do."""
    return [(a + b) / 2 for a, b in zip(places, places[1:], strict=False)]


def _leaves(edges: list[float]) -> tuple[list[float], list[float]]:
    """Edges, and a value within each bin."""
    return edges, [*edges, float(np.nextafter(edges[-1], np.inf))] if edges else [0.0]


def _cut(value: Column, edges: list[float], leaves: list[float]) -> Column:
    """The leaf of the bin that a value lies in; what lies on an edge is below it, as in a tree."""
    if not edges:
        return F.lit(leaves[0])
    k = len(edges) // 2
    return F.when(value <= edges[k], _cut(value, edges[:k], leaves[: k + 1])).otherwise(_cut(value, edges[k + 1 :], leaves[k + 1 :]))


def _counted(data: DataFrame, bins: list[tuple[list[float], list[float]]], names: list[str]) -> DataFrame:
    """(fold, label, a column for each feature, weight): rows of like bins as one, with the sum of their weights.

    Trees see no more of a row than its bins, so those fitted to the counts are those of the rows. MLlib finds the same bins again, as there are no more
    values than it makes bins. Every row counts; where few rows are alike, the table stays as large as it is.
    """
    return data.groupBy("fold", "label", *(_cut(F.col(n), *own).alias(n) for n, own in zip(names, bins, strict=True))).agg(F.sum("weight").alias("weight"))


def save_results(results: DataFrame, path: str) -> None:
    """Training results appended by run; a run written again replaces its own rows only."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def train_all(spark: SparkSession, df: DataFrame, registry: list[dict], key: str, run_id: str = "run", parallelism: int = 4) -> tuple[dict[str, Model], DataFrame]:
    """Fits every model of a registry, ``parallelism`` at a time, layer after layer; a failure becomes a row and doesn't stop the others.

    A registry entry has model_id, model_type, features, and optionally target, training_filter, parameters and
    depends_on. Gives the models and the results (model_id, run_id, metric, value, status, error).
    """
    models: dict[str, Model] = {}

    def train(entry: dict) -> list[tuple]:
        name = entry["model_id"]
        try:
            own = df.filter(entry["training_filter"]) if entry.get("training_filter") else df
            if category(entry["model_type"]) == "clusterer":
                data = assemble(own, entry["features"], [key])
                models[name] = create(entry["model_type"], entry.get("parameters")).fit(data)
                found = cluster_metrics(models[name], data)
            else:
                models[name], folds = cross_validate(own, entry["model_type"], entry["features"], entry["target"], key, entry.get("parameters"))
                found = {r.metric: r.v for r in folds.groupBy("metric").agg(F.avg("value").alias("v")).collect()}
            return [(name, run_id, m, v, "success", None) for m, v in found.items()]
        except Exception as e:  # one model's failure is a result
            return [(name, run_id, None, None, "failed", str(e)[:500])]

    rows = []
    with ThreadPoolExecutor(parallelism) as pool:
        for layer in _layers(spark, registry):
            rows += [r for found in pool.map(inheritable_thread_target(spark)(train), layer) for r in found]
    return models, spark.createDataFrame(rows, RESULTS)


def _layers(spark: SparkSession, registry: list[dict]) -> list[list[dict]]:
    """Parents in layers before those that depend on them."""
    pairs = [(e["model_id"], p) for e in registry for p in e.get("depends_on", ())]
    if not pairs:
        return [registry]
    from marlpit.operators.lineage import layers

    layer = {r.item: r.layer for r in layers(spark.createDataFrame(pairs, "child string, parent string")).collect()}
    held: dict[int, list[dict]] = {}
    for e in registry:
        held.setdefault(layer.get(e["model_id"], 0), []).append(e)
    return [held[k] for k in sorted(held)]


# ---------------------------------------------------------------- scoring

SCORES = ("model_id", "record_id", "prediction", "probability", "cluster_id", "error")


def selected(df: DataFrame, features: list[str]) -> list[str]:
    """A model's features that the table has; an error if there are none."""
    found = [f for f in features if f in df.columns]
    if not found:
        raise ValueError("the table has none of the model's features")
    return found


def score_linear(df: DataFrame, key: str, models: dict[str, dict[str, float]]) -> DataFrame:
    """(model_id, record_id, prediction) of linear models, all from one scan; ``intercept`` is a model's constant."""
    scores = []
    for name, weights in models.items():
        total = F.lit(float(weights.get("intercept", 0.0)))
        for f in selected(df, [w for w in weights if w != "intercept"]):
            total = total + filled(f) * weights[f]
        scores.append(F.struct(F.lit(name).alias("model_id"), total.alias("prediction")))
    return df.select(col(key).alias("record_id"), F.explode(F.array(*scores)).alias("s")).select("s.model_id", "record_id", "s.prediction")


def score_models(df: DataFrame, key: str, models: dict[str, tuple[Model, list[str]]]) -> DataFrame:
    """Predictions of MLlib models; a model that can't be applied gives one row with its error.

    Classifiers give the chance of class 1 as probability, clusterers a cluster_id. Boosted trees and centres score the table in one pass for
    all of them; a model of another kind takes a scan of its own.
    """
    from marlpit.ml import flat

    kind = df.schema[key].dataType.simpleString()
    ready, failed, others = {}, [], {}
    for name, (model, features) in models.items():
        try:
            found = selected(df, features)
            if getattr(model, "numFeatures", len(found)) != len(found):
                raise ValueError(f"the table lacks {', '.join(f for f in features if f not in found)}")
            arrays = flat.flat(model)
        except Exception as e:  # the others go on
            failed.append((name, None, None, None, None, str(e)[:500]))
            continue
        (others if arrays is None else ready)[name] = (model if arrays is None else arrays, found)
    out = flat.score_flat(df, key, ready)
    if failed:
        out = out.unionByName(df.sparkSession.createDataFrame(failed, f"model_id string, record_id {kind}, prediction double, probability double, cluster_id int, error string"))
    for name, (model, features) in others.items():
        scored, none = model.transform(assemble(df, features, [key])), F.lit(None)
        chance = vector_to_array("probability")[1] if "probability" in scored.columns else none
        out = out.unionByName(scored.select(F.lit(name).alias("model_id"), col(key).alias("record_id"), F.col("prediction").cast("double").alias("prediction"), chance.cast("double").alias("probability"), none.cast("int").alias("cluster_id"), none.cast("string").alias("error")))
    return out


def score_with(df: DataFrame, key: str, features: list[str], load: Callable[[], Callable], name: str) -> DataFrame:
    """(model_id, record_id, prediction) by a Python model: ``load`` runs once a task and gives a function from a frame of features to predictions."""
    import pandas as pd

    def scored(frames):
        predict = load()
        for frame in frames:
            yield pd.DataFrame({"model_id": name, "record_id": frame["_key"], "prediction": predict(frame.drop(columns="_key"))})

    own = df.select(col(key).cast("bigint").alias("_key"), *(filled(f).alias(f) for f in selected(df, features)))
    return own.mapInPandas(scored, "model_id string, record_id bigint, prediction double")


def write_scores(predictions: DataFrame, path: str, run_date: Column | None = None) -> None:
    """Parquet by model; a second run replaces the partitions of the models that it holds, and no others."""
    out = predictions.withColumn("inference_date", F.current_date() if run_date is None else run_date).withColumn("scored_at", F.current_timestamp())
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id").parquet(path)


def results_valid(predictions: DataFrame, models: int) -> DataFrame:
    """(rows, models, null_predictions, valid) of a table of predictions."""
    found = predictions.agg(F.count("*").alias("rows"), F.count_distinct("model_id").alias("models"), F.count_if(F.col("prediction").isNull()).alias("null_predictions"))
    return found.withColumn("valid", (F.col("rows") > 0) & (F.col("models") == models) & (F.col("null_predictions") == 0))


def records_scored(predictions: DataFrame) -> DataFrame:
    """(model_id, records)."""
    return predictions.groupBy("model_id").agg(F.count("*").alias("records"))
