"""Successive halving, models fitted by group, and flat models, against the plain ways."""

import json

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from marlpit.ml import flat, grouped, halving, metrics, training


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(600, 3))
    y = 3 * x[:, 0] + 2 * x[:, 1] + draw.normal(scale=0.1, size=600)
    rows = [(k, *map(float, v), float(t), int(v[0] + v[1] > 0)) for k, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame([*rows, (600, None, 1.0, None, 2.0, 1)], "id bigint, f0 double, f1 double, f2 double, y double, above int").repartition(3).cache()


FEATURES = ["f0", "f1", "f2"]


@pytest.mark.parametrize(("kind", "target"), [("xgboost_classifier", "above"), ("xgboost_regressor", "y")])
def test_flat_trees_score_as_the_model_does(spark, points, kind, target):
    model = training.create(kind, {"max_depth": 4, "n_estimators": 6, "learning_rate": 0.3}).fit(training.assemble(points.withColumn("label", F.col(target).cast("double")), FEATURES, ["id", "label"]))
    arrays = flat.flat(model)
    assert len(arrays.roots) == 6 and 1 <= arrays.depth <= 4
    expected = model.transform(training.assemble(points, FEATURES, ["id"]))
    chance = vector_to_array("probability")[1] if kind == "xgboost_classifier" else F.lit(None).cast("double")
    expected = {r.id: (r.prediction, r.p) for r in expected.select("id", "prediction", chance.alias("p")).collect()}
    found = training.score_models(points, "id", {"one": (model, FEATURES), "two": (model, FEATURES)})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    rows = found.collect()
    assert len(rows) == 2 * len(expected)
    for r in rows:
        assert r.prediction == expected[r.record_id][0] and (r.probability is None) == (expected[r.record_id][1] is None)
        assert r.probability is None or abs(r.probability - expected[r.record_id][1]) < 1e-12


def test_flat_models_come_in_lots(spark, points):
    model = training.create("xgboost_regressor", {"max_depth": 2, "n_estimators": 2}).fit(training.assemble(points.withColumn("label", F.col("y")), FEATURES, ["id", "label"]))
    arrays = flat.flat(model)
    many = {str(k): (arrays, FEATURES) for k in range(5)}
    size = sum(a.nbytes for a in arrays if isinstance(a, np.ndarray))
    assert [len(c) for c in flat.chunks(many, 2 * size)] == [2, 2, 1] and [len(c) for c in flat.chunks(many, 1)] == [1] * 5
    assert flat.chunks({}) == [] and flat.score_flat(points, "id", {}).collect() == []
    failed = training.score_models(points, "id", {"short": (model, ["f0", "zzz", "f2"]), "none": (model, ["zzz"]), "good": (model, FEATURES)})
    found = {r.model_id: (r.n, r.e) for r in failed.groupBy("model_id").agg(F.count("record_id").alias("n"), F.max("error").alias("e")).collect()}
    assert found["good"] == (601, None) and found["short"] == (0, "the table lacks zzz") and found["none"][0] == 0


def test_halving_finds_what_the_grid_finds(spark, points):
    space = {"max_depth": [1, 4], "learning_rate": [0.01, 0.5], "n_estimators": [8]}
    found = halving.successive_halving(points, "xgboost_regressor", FEATURES, "y", "id", space, trials=4, rungs=3)
    _, best, _ = training.search(points, "xgboost_regressor", FEATURES, "y", "id", space, trials=4, folds=2)
    assert found.parameters == best == {"max_depth": 4, "learning_rate": 0.5, "n_estimators": 8}
    rows = found.trials.collect()
    assert [(r.rung, r.rows_share, r.trees) for r in sorted(rows, key=lambda r: r.rung)] == [(0, 0.25, 2)] * 4 + [(1, 0.5, 4)] * 2 + [(2, 1.0, 8)]
    assert found.cost == pytest.approx(4 / 16 + 2 / 4 + 1) and found.cost < 2
    assert sum(r.promoted for r in rows) == 4 and json.loads(next(r.parameters for r in rows if r.rung == 2)) == best
    # what a round keeps is the better half of it
    for rung in (0, 1):
        own = [r for r in rows if r.rung == rung]
        assert min(r.value for r in own if r.promoted) >= max(r.value for r in own if not r.promoted)


def test_halving_of_clusters(spark):
    df = spark.range(300).select("id", ((F.col("id") % 3) * 100 + F.col("id") / 300).alias("x"))
    found = halving.successive_halving(df, "kmeans", ["x"], None, "id", {"n_clusters": [2, 3, 5]}, trials=3, rungs=2)
    assert found.parameters == {"n_clusters": 3} and found.value > 0.99


def test_a_thousand_lines_in_one_job(spark):
    df = spark.range(20_000).select((F.col("id") % 1000).alias("m"), (F.col("id") / 1000).alias("a"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("b"))
    df = df.withColumn("y", F.col("m") + 2 * F.col("a") - F.col("m") * F.col("b") / 100)
    odd = spark.createDataFrame([(5000, 1.0, 1.0, 7.0), (5001, 1.0, 2.0, 3.0), (5001, 1.0, 2.0, 3.0), (5002, None, 2.0, 3.0)], "m bigint, a double, b double, y double")
    found = {r.m: r for r in grouped.linear_models(df.select("m", "a", F.col("b").cast("double").alias("b"), "y").unionByName(odd), "m", ["a", "b"], "y").collect()}
    assert len(found) == 1002
    for m in range(1000):
        assert found[m].weights == pytest.approx([2, -m / 100], abs=1e-6) and found[m].intercept == pytest.approx(m, abs=1e-6) and found[m].r2 == pytest.approx(1)
    assert (found[5000].intercept, found[5000].weights, found[5000].r2) == (7.0, [0.0, 0.0], None) and found[5001].intercept == 3.0


def brute_tree(rows, features, depth):
    """Greedy tree by trying every value of every feature."""
    n, s = len(rows), sum(r[-1] for r in rows)
    best = None
    if depth:
        for f in range(features):
            for t in sorted({r[f] for r in rows})[1:]:
                left = [r[-1] for r in rows if r[f] < t]
                sl, nl = sum(left), len(left)
                gain = sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, f, t)
    if best is None:
        return s / n
    _, f, t = best
    return f, t, brute_tree([r for r in rows if r[f] < t], features, depth - 1), brute_tree([r for r in rows if r[f] >= t], features, depth - 1)


def test_grouped_trees_are_greedy_trees(spark):
    draw = np.random.default_rng(7)
    rows = [(int(m), int(draw.integers(0, 6)), int(draw.integers(0, 5)), int(draw.integers(0, 50))) for m in draw.integers(0, 40, 3000)]
    rows += [(99, 1, 1, 5)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id bigint, m int, a int, b int, y int")
    trees = grouped.grouped_trees(df, "m", ["a", "b"], "y", depth=3)
    scored = {r.id: r.prediction for r in grouped.score_trees(df, "m", "id", ["a", "b"], trees, 3).collect()}
    own = {m: brute_tree([r[1:] for r in rows if r[0] == m], 2, 3) for m in {r[0] for r in rows}}
    for k, r in enumerate(rows):
        node = own[r[0]]
        while isinstance(node, tuple):
            node = node[2] if r[1 + node[0]] < node[1] else node[3]
        assert scored[k] == pytest.approx(node)
    assert trees.count() == 41 and {len(r["values"]) for r in trees.collect()} == {16}
    assert grouped.grouped_trees(df.limit(0), "m", ["a"], "y", depth=1).count() == 0
    unseen = grouped.score_trees(spark.createDataFrame([(1, 1000, 1, 1)], "id bigint, m int, a int, b int"), "m", "id", ["a", "b"], trees, 3).first()
    assert unseen.prediction is None


def test_classifier_is_fitted_to_counted_bins_and_scores_rows_alike(spark, monkeypatch):
    """Turns of boosting see counts, not rows; where every value has a bin of its own, the model is that of the rows."""
    rows = spark.range(20_000).select("id", (F.col("id") % 7).alias("a"), (F.xxhash64("id") % 5).alias("b"), F.pow(F.rand(3), 4).alias("x"))
    rows = rows.withColumn("y", (((F.col("a") > 3) != (F.col("b") > 0)) | (F.xxhash64("id", F.lit(1)) % 4 == 0)).cast("int"))
    seen, fit = [], training.GBTClassifier.fit
    monkeypatch.setattr(training.GBTClassifier, "fit", lambda self, data, *a: seen.append(data.count()) or fit(self, data, *a))
    model, folds = training.cross_validate(rows, "xgboost_classifier", ["a", "b"], "y", "id", {"n_estimators": 3, "max_depth": 3})
    assert len(seen) == 4 and max(seen) <= 3 * 2 * 7 * 9
    plain = training._training_rows(rows, ["a", "b"], "y", "id", 3, True).cache()
    chances = [m.transform(plain).groupBy("features").agg(F.first(F.col("probability")).alias("p")).collect() for m in (model, training.create("xgboost_classifier", {"n_estimators": 3, "max_depth": 3}).fit(plain))]
    held = [{tuple(r.features): r.p[1] for r in c} for c in chances]
    assert held[0] == pytest.approx(held[1], abs=1e-9) and len(held[0]) > 30
    for k in range(3):
        scored = training.create("xgboost_classifier", {"n_estimators": 3, "max_depth": 3}).fit(plain.filter(f"fold <> {k}")).transform(plain.filter(f"fold = {k}")).withColumn("p", vector_to_array("probability")[1])
        found = {r.metric: r.value for r in folds.filter(f"fold = {k}").collect()}
        assert found["roc_auc"] == pytest.approx(metrics.auc(scored, "label", "p").first().auc, abs=1e-9) and found["accuracy"] == pytest.approx(metrics.binary_metrics(scored, "label", "p").first().accuracy, abs=1e-9)
    # of more values than bins, rows score as the places of their bins do
    given = plain.join(rows.select("id", "x"), "id").select("id", "fold", "label", "x")
    (places,) = training._places(given, ["x"], [None], 32)[0]
    given = given.withColumn("raw", F.col("x")).withColumn("x", training._cut(F.col("raw"), training._edges(places), places)).cache()
    model = training.create("xgboost_classifier", {"n_estimators": 3}).fit(training.assemble(given, ["x"], ["label"]))
    by = [{r.id: r.probability for r in model.transform(training.assemble(given, [c], ["id"])).collect()} for c in ("x", "raw")]
    assert by[0] == by[1] and len(set(by[0].values())) > 5 and len(places) == 32


def test_bins_of_rare_and_frequent_values():
    assert training._spread([(0.0, 900.0), (1.0, 1.0)], 32) == [0.0, 1.0]
    most = training._spread([(0.0, 9000.0), *((float(k), 1.0) for k in range(1, 1000))], 32)
    assert len(most) == 32 and most[0] == 0.0 and most[1] < 40 and most[-1] > 950
    assert training._spread([], 32) == [0.0]
