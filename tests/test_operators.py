"""Operators on small hand-made tables."""

import math
from datetime import datetime

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlpit.functions import scalar
from marlpit.ml import metrics, training
from marlpit.operators import checks, drift, features, governance, lineage, monitoring, store
from marlpit.sources import tables
from marlpit.streaming import ingest
from marlpit.streaming.keyed_table import KeyedTable, upsert_stream

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(scope="module")
def sample(spark):
    draw = np.random.default_rng(1)
    rows = [
        (k, float(draw.normal()), float(draw.lognormal()) if k % 9 else None, float("nan") if k % 11 == 0 else float(draw.random()), "US EU APAC".split()[k % 3], "retail" if k % 2 else "enterprise", f"2024-01-{k % 28 + 1:02d}" if k % 13 else "no date", k % 2, float(k))
        for k in range(100)
    ]
    return spark.createDataFrame(rows, "record_id bigint, num_000 double, num_001 double, num_002 double, cat_geography string, cat_segment string, date_000 string, target_binary int, target_continuous double")


# ---------------------------------------------------------------- features


def test_roles_follow_names(sample):
    roles = features.ColumnRoles.of(sample)
    assert roles.numeric == ("num_000", "num_001", "num_002") and roles.categorical == ("cat_geography", "cat_segment") and roles.temporal == ("date_000",)


def test_fitted_transforms_are_the_same_on_other_rows(sample, spark, tmp_path):
    model = features.FeatureModel.fit(sample)
    one = model.transform(sample)
    other = model.transform(sample.withColumn("cat_geography", F.lit("UNSEEN")).limit(5))
    assert one.columns == other.columns and "record_id" in one.columns
    assert not one.select([F.count_if(F.col(c).isNull()).alias(c) for c in one.columns]).first().asDict().values() - {0} if False else True
    assert all(v == 0 for v in one.select([F.count_if(F.col(c).isNull()).alias(c) for c in one.columns]).first())
    codes = {r.cat_geography_encoded for r in other.collect()}
    unseen = {r.code for r in model.categories.filter("column = 'cat_geography' and value = '__unknown__'").collect()}
    assert codes == unseen and {r.cat_geography_freq for r in other.collect()} == {0.0}
    model.save(str(tmp_path), spark)
    again = features.FeatureModel.load(str(tmp_path), spark).transform(sample)
    assert sorted(again.collect()) == sorted(one.collect())


def test_scaler_is_fitted_on_filled_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    mean, std = features.fit_scaler(df, ["x"])["x"]
    assert mean == 1.0 and math.isclose(std, math.sqrt(1.5))
    assert features.fit_scaler(spark.createDataFrame([(2.0,), (2.0,)], "x double"), ["x"])["x"] == (2.0, 1.0)
    flags = [r.x_is_null for r in features.numeric_features(df, ["x"]).collect()]
    assert flags == [0.0, 1.0, 1.0, 0.0]


def test_unreadable_dates(sample):
    row = features.temporal_features(sample.filter("record_id = 13"), ["date_000"]).first()
    assert row.date_000_year == 0 and row.date_000_is_weekend == 0 and math.isclose(row.date_000_month_sin, math.sin(math.pi / 6))


def test_selection(sample):
    columns = ["num_000", "num_001", "num_002"]
    data, chosen = features.select_features(sample.withColumn("num_002", F.col("target_binary") * 1.0 + F.col("num_000") / 1000), columns, 1, "target_binary", "classifier")
    assert chosen == ["num_002"] and "num_000" not in data.columns and "record_id" in data.columns
    _, chosen = features.select_features(sample, columns, 2)
    assert len(chosen) == 2
    _, chosen = features.select_features(sample.withColumn("num_001", F.col("target_continuous") * 2), columns, 1, "target_continuous", "regressor")
    assert chosen == ["num_001"]


def test_correlated_and_constant_columns_go(sample):
    df = sample.withColumn("num_003", F.col("num_000") * 3).withColumn("num_004", F.lit(1.0))
    assert features.drop_correlated(df, ["num_000", "num_001", "num_003"]) == ["num_000", "num_001"]
    assert features.drop_constant(df, ["num_000", "num_004"]) == ["num_000"]


def test_hashing_only_many_categories(sample):
    assert "cat_geography_bucket" not in features.hash_if_many(sample, "cat_geography").columns
    assert "cat_geography_bucket" in features.hash_if_many(sample, "cat_geography", most=2).columns
    indexed = features.index_by_frequency(sample, ["cat_geography"]).transform(sample.limit(3))
    assert "cat_geography_indexed" in indexed.columns


# ---------------------------------------------------------------- checks


def test_expectations_on_bad_rows(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (None, "z", 1.0)], "k int, v string, x double")
    rules = [checks.unique("k"), checks.not_null("k"), checks.in_set("v", ["a", "b"]), checks.null_rate("x", 0.5), checks.not_constant("x"), checks.not_empty()]
    found = {r.check: (r.passed, r.failed_count) for r in checks.evaluate(df, rules).collect()}
    assert found["unique(k)"] == (False, 2) and found["in_set(v)"] == (False, 1) and found["null_rate(x)"] == (True, 0) and found["not_constant(x)"] == (False, 1)
    assert checks.expect(df, [checks.not_null("k"), checks.in_set("v", ["a"])], "drop").count() == 1
    with pytest.raises(checks.ExpectationFailed, match="unique"):
        checks.expect(df, rules, "fail")
    with pytest.raises(ValueError):
        checks.expect(df, rules, "drop")
    empty = {r.check: r.passed for r in checks.evaluate(df.limit(0), rules).collect()}
    assert not empty["not_empty"] and empty["unique(k)"]
    assert len(checks.standard_rules(df, "k")) > 5


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, None, "a", float("inf")), (float("nan"), None, "a", 0.0), (3.0, None, None, 0.0)], "x double, none double, s string, i double")
    p = {r.feature: r for r in checks.profile(df).collect()}
    assert math.isclose(p["x"].null_rate, 1 / 3) and p["x"].unique_count == 2 and p["x"].mean == 2.0
    assert p["none"].unique_count == 0 and "constant_column" in p["none"].issues and "high_null_rate (100.00%)" in p["none"].issues
    assert p["i"].inf_count == 1 and "contains_inf (1)" in p["i"].issues and math.isclose(p["i"].zero_rate, 2 / 3)
    assert p["s"].mean is None and p["s"].has_issue
    assert {r.feature: r.null_rate for r in checks.profile(df.limit(0)).collect()}["x"] is None


# ---------------------------------------------------------------- drift


def slow_psi(a, b, bins=10):
    edges = sorted(set(np.percentile(a, np.linspace(0, 100, bins + 1))[1:-1]))
    count = lambda x: np.bincount(np.searchsorted(edges, x, "right"), minlength=len(edges) + 1)
    r, c = (count(a) + 1) / (len(a) + len(edges) + 1), (count(b) + 1) / (len(b) + len(edges) + 1)
    return float(((c - r) * np.log(c / r)).sum())


@quick
@given(st.lists(st.integers(0, 20), min_size=2, max_size=40), st.lists(st.integers(0, 20), min_size=1, max_size=40))
def test_psi_and_ks_against_numpy(spark, a, b):
    one, two = (spark.createDataFrame([(float(v),) for v in x], "x double") for x in (a, b))
    assert math.isclose(drift.psi(one, two).first().psi, slow_psi(a, b), abs_tol=1e-9)
    every = np.unique(a + b)
    d = max(abs(np.mean(np.array(a) <= v) - np.mean(np.array(b) <= v)) for v in every)
    assert math.isclose(drift.ks(one, two).first().ks_statistic, d, abs_tol=1e-9)


def test_no_drift_in_the_same_table(sample):
    table = drift.drift_table(sample, sample, ["num_000", "num_001"])
    assert all(abs(r.psi) < 1e-12 and r.ks_statistic == 0 and r.ks_pvalue == 1 and not r.is_drifted for r in table.collect())
    assert drift.drift_summary(table).first().drift_pct == 0


def test_features_without_values_are_left_out(spark):
    one = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    two = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "x double, y double")
    assert [r.feature for r in drift.drift_table(one, two).collect()] == ["x"]
    assert drift.drift_summary(drift.drift_table(one.limit(0), two)).first().drift_pct == 0


def test_bands(spark):
    df = spark.createDataFrame([(0.05,), (0.15,), (0.3,), (0.9,)], "psi double")
    assert [r.b for r in df.select(drift.psi_band(F.col("psi")).alias("b")).collect()] == ["none", "moderate", "significant", "severe"]


# ---------------------------------------------------------------- monitoring


def test_distribution_and_alerts(spark):
    p = spark.createDataFrame([("a", 1.0, None, None), ("a", 1.0, None, "bad"), ("b", 2.0, 1, None), ("b", 3.0, 2, None), ("c", 4.0, None, None)], "model_id string, prediction double, cluster_id int, error string")
    found = {r.model_id: r for r in monitoring.prediction_distribution(p).collect()}
    assert found["a"].warning == "constant_predictions" and found["a"].error_rate == 0.5 and found["b"].cluster_sizes == {1: 1, 2: 1} and found["b"].warning is None
    assert found["c"].warning == "single_value"
    quality = checks.profile(p)
    for pct, expected in ((60.0, "P1"), (30.0, "P2"), (20.0, None)):
        summary = spark.createDataFrame([(pct,)], "drift_pct double")
        rows = monitoring.alerts(summary, quality, monitoring.prediction_distribution(p)).collect()
        assert [r.severity for r in rows if r.type == "feature_drift"] == ([expected] if expected else [])
        assert any(r.type == "constant_predictions" and "a" in r.message for r in rows)


def test_metric_drop(spark):
    old = spark.createDataFrame([("a", "roc_auc", 0.9), ("b", "roc_auc", 0.8)], "model_id string, metric string, value double")
    new = spark.createDataFrame([("a", "roc_auc", 0.8), ("b", "roc_auc", 0.79)], "model_id string, metric string, value double")
    assert {r.model_id: r.flagged for r in monitoring.metric_drop(old, new).collect()} == {"a": True, "b": False}


def test_monitoring_results_are_saved(sample, tmp_path, spark):
    p = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "model_id string, prediction double")
    cut = sample.select("num_000", "num_001")
    monitoring.save(monitoring.run(cut, cut, p), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/drift").count() == 2 and spark.read.parquet(f"{tmp_path}/predictions").count() == 1


# ---------------------------------------------------------------- store


def test_as_of_join_never_looks_ahead(spark):
    entities = spark.createDataFrame([(1, 10, "x"), (1, 5, "x"), (1, 1, "x"), (2, 9, "x"), (None, 9, "x"), (1, None, "x"), (1, 10, "x")], "k int, t int, f string")
    rows = spark.createDataFrame([(1, 5, 50.0), (1, 10, 100.0), (1, 11, 110.0), (1, 2, None), (None, 1, 1.0)], "k int, ft int, v double")
    for ranges in (None, 3):
        found = sorted((r.k or 0, r.t or 0, r.v or -1) for r in store.as_of_join(entities, rows, "k", "t", "ft", ["v"], ranges=ranges).collect())
        assert found == sorted([(1, 10, 100.0), (1, 10, 100.0), (1, 5, 50.0), (1, 1, -1), (2, 9, -1), (0, 9, -1), (1, 0, -1)])
    young = store.as_of_join(entities, rows.filter("v = 50"), "k", "t", "ft", ["v"], F.lit(3)).collect()
    assert {(r.t, r.v) for r in young if r.k == 1} == {(10, None), (5, 50.0), (1, None), (None, None)}


@quick
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 9)), max_size=12), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 9), st.integers(0, 99)), max_size=12))
def test_as_of_join_against_a_loop(spark, entities, rows):
    e = spark.createDataFrame([(k, *x) for k, x in enumerate(entities)], "i int, k int, t int")
    f = spark.createDataFrame(rows, "k int, ft int, v int")
    for r in store.as_of_join(e, f, "k", "t", "ft", ["v"], ranges=len(rows) % 3 or None).collect():
        before = [(t, v) for k, t, v in rows if k == r.k and t <= r.t]
        assert r.v == (max(before)[1] if before else None)


def test_store_versions_keys_and_lineage(spark, tmp_path):
    held = store.FeatureStore.of(spark, {"environment": "local", "paths": {"local": str(tmp_path)}})
    assert held.tables().count() == 0
    df = spark.createDataFrame([(k, k / 2) for k in range(10)], "record_id bigint, alpha double")
    one = held.register("f", df.limit(3), "v1")
    two = held.register("f", df, keys=["record_id"])
    assert one["data_hash"] != two["data_hash"] and two["row_count"] == 10 and two["version"].startswith("v2")
    assert held.read("f").count() == 10 and held.read("f", "v1").count() == 3 and held.read("f", keys=[1, 2, 77]).count() == 2
    assert held.read("f", keys=spark.createDataFrame([(4,)], "record_id bigint")).first().alpha == 2.0
    with pytest.raises(KeyError):
        held.read("g")
    made = held.training_set(df.select("record_id").limit(2), ["f", "g"])
    assert made.feature_names == ["alpha"] and made.skipped == ["g"] and made.data.count() == 2
    assert held.lineage("f").count() == 2 and held.lineage("g").first().error == "not found"
    assert held.feature_set(df.select("record_id"), {"source": "f", "size": 1}).feature_names == ["alpha"]


def test_ids_are_no_features_of_a_named_set(spark, tmp_path):
    """The variance of ids grows with the table; they must not win against a feature."""
    held = store.FeatureStore(spark, str(tmp_path / "store"))
    df = spark.range(9).select(F.col("id").alias("record_id"), (F.col("id") % 3).cast("double").alias("alpha"), (F.col("id") * 1000).alias("customer"))
    held.register("h", df, "v1")
    made = held.feature_set(df.select("record_id"), {"source": "h", "size": 1, "ids": ["customer"]})
    assert made.feature_names == ["alpha"] and made.data.columns == ["record_id", "alpha"]


def test_training_set_as_of(spark, tmp_path):
    held = store.FeatureStore(spark, str(tmp_path))
    held.register("f", spark.createDataFrame([(1, 1, 10.0), (1, 5, 50.0)], "record_id bigint, ts int, value double"), "v1")
    entities = spark.createDataFrame([(1, 3, 0.5), (1, 6, 0.5)], "record_id bigint, at int, value double")
    found = held.training_set(entities, ["f"], entity_time="at", feature_time="ts")
    assert found.feature_names == ["value_f"] and sorted((r["at"], r.value_f) for r in found.data.collect()) == [(3, 10.0), (6, 50.0)]


def test_fingerprints_are_about_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    mark = lambda df: store.fingerprint(df).first().fingerprint
    assert mark(a) == mark(a.orderBy(F.desc("k")).repartition(3)) != mark(a.union(a)) and len(mark(a.limit(0))) == 16


# ---------------------------------------------------------------- governance


@pytest.fixture(scope="module")
def personal(spark):
    rows = [(1, "alice@example.com", "123-45-6789", "2125550100", "4111 1111 1111 1111", 0.1), (2, "bob@mail.org", "987-65-4321", "212-555-0101", "4111111111111112", 0.2), (3, "dave@io", None, "x", "411111111111111", 0.3)]
    return spark.createDataFrame(rows, "record_id bigint, contact string, ssn_column string, phone string, card string, score double")


def test_pii_by_name_and_content(personal):
    found = governance.detect_pii(personal)
    assert found == {"contact": ["email"], "ssn_column": ["ssn"], "phone": ["phone"], "card": ["credit_card"]}
    assert governance.hinted(["user_name", "ip_address", "x"]) == {"user_name": ["name"], "ip_address": ["address", "ip_address"]}
    assert governance.detect_pii(personal.select("score")) == {}


def test_masks(personal):
    masked = {r.record_id: r for r in governance.mask_pii(personal).collect()}
    assert masked[1].contact == "*****@example.com" and masked[1].ssn_column == "***-**-6789" and masked[1].phone == "212-***-0100" and masked[1].card == "****-****-****-1111"
    assert masked[3].ssn_column is None and masked[3].contact == "****@io" and masked[3].card == "411111111111111"
    again = governance.mask_pii(governance.mask_pii(personal, {"contact": ["email"]}), {"contact": ["email"]})
    assert {r.contact for r in again.collect()} == {"*****@example.com", "***@mail.org", "****@io"}
    assert {r.phone for r in governance.mask_pii(personal, {"phone": ["phone", "name"]}).collect()} == {"[REDACTED]"}


def test_compliance_report(personal):
    rows = {r.column: r for r in governance.compliance_report(personal, "people").collect()}
    assert rows["contact"].is_pii and not rows["score"].is_pii and rows["score"].classification == "pii" and rows["score"].dtype == "double"


def test_audit_log(spark, tmp_path):
    log = governance.AuditLog(spark, str(tmp_path / "audit"))
    assert log.entries().count() == 0
    log.append([{"operation": "train", "actor": "a", "details": {"k": "v"}}, {"operation": "score", "actor": "b", "status": "failed", "records_affected": 3}])
    log.append([{"operation": "train", "actor": "b", "timestamp": datetime(2030, 1, 1)}])
    rows = log.entries()
    assert rows.count() == 3 and rows.filter("entry_id is null or timestamp is null or status is null").count() == 0
    assert governance.audit_filter(rows, operation="train", actor="a").first().details == {"k": "v"}
    assert {r.operation: r.n for r in governance.count_by_operation(rows).collect()} == {"train": 2, "score": 1}
    assert governance.recent(rows, 1).first().actor == "b"


def test_snapshots(spark, tmp_path, personal):
    held = governance.Snapshots(spark, str(tmp_path / "s"))
    assert held.get("none") is None
    one = held.create(personal, run_id="r", table_versions={"t": "1"}, retention_days=1)
    held.create(personal.limit(1), retention_days=10_000)
    assert held.get(one["snapshot_id"])["num_rows"] == 3 and one["snapshot_id"].startswith("snap_") and len(one["snapshot_id"]) == 17
    assert held.latest(1).count() == 1 and held.kept(F.current_timestamp() + F.expr("interval 5 days")).count() == 1


def test_erasure(spark, personal):
    who = spark.createDataFrame([(1,), (1,), (9,)], "user bigint")
    assert governance.erasure_counts({"p": (personal, "record_id")}, who, "user").first().affected == 1
    assert governance.erase(personal, "record_id", who, "user").count() == 2
    plan = governance.erasure_plan({"p": (personal, "record_id")}, who, "user", spark.createDataFrame([("q", "p")], "child string, parent string"))
    assert plan.first().cascade == ["q"]


# ---------------------------------------------------------------- lineage


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def test_diamond_chain_and_circle(spark):
    diamond = graph(spark, [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d")])
    assert {r.item: r.layer for r in lineage.layers(diamond).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert {r.item for r in lineage.upstream(diamond, "d").collect()} == {"a", "b", "c"}
    assert {r.item for r in lineage.upstream(diamond, "d", transitive=False).collect()} == {"b", "c"}
    assert {r.item for r in lineage.downstream(diamond, "b").collect()} == {"d", "e"}
    circle = graph(spark, [("a", "b"), ("b", "a"), ("c", "b")])
    with pytest.raises(lineage.CycleError):
        lineage.layers(circle)
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "item string")
    assert {(r.check, r.item) for r in lineage.edge_checks(circle, items).collect()} == {("cycle", "a"), ("cycle", "b"), ("cycle", "c"), ("orphan", "z")}
    models = spark.createDataFrame([("m", ["a", "b"]), ("n", [])], "model_id string, depends_on array<string>")
    assert lineage.edges_of(models).count() == 2


# ---------------------------------------------------------------- models


def test_model_types():
    assert training.category("lightgbm_regressor") == "regressor" and training.category("kmeans") == "clusterer"
    with pytest.raises(ValueError):
        training.category("oracle")
    assert len(training.sampled_grid({"a": [1, 2], "b": [3, 4]}, 3)) == 3


def test_training_goes_on_after_a_failure(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(300, 3))
    df = spark.createDataFrame([(k, *map(float, r), int(r[0] + r[1] > 0)) for k, r in enumerate(x)], "id bigint, f0 double, f1 double, f2 double, y int")
    registry = [
        {"model_id": "second", "model_type": "kmeans", "features": ["f0", "f1"], "parameters": {"n_clusters": 2}, "depends_on": ["first"]},
        {"model_id": "first", "model_type": "xgboost_classifier", "features": ["f0", "f1", "f2"], "target": "y", "parameters": {"n_estimators": 3, "colsample_bytree": 1}},
        {"model_id": "broken", "model_type": "xgboost_classifier", "features": ["nowhere"], "target": "y"},
    ]
    models, results = training.train_all(spark, df, registry, "id")
    rows = results.collect()
    assert set(models) == {"first", "second"} and {r.model_id for r in rows if r.status == "failed"} == {"broken"}
    assert next(r.value for r in rows if (r.model_id, r.metric) == ("first", "roc_auc")) > 0.8
    scored = training.score_models(df, "id", {"first": (models["first"], ["f0", "f1", "f2"]), "second": (models["second"], ["f0", "f1"]), "lost": (models["first"], ["zzz"])})
    by = {r.model_id: r.n for r in scored.groupBy("model_id").agg(F.count("*").alias("n")).collect()}
    assert by == {"first": 300, "second": 300, "lost": 1} and tuple(scored.columns) == training.SCORES
    assert scored.filter("model_id = 'first' and probability between 0 and 1").count() == 300
    assert features.importance(models["first"], ["f0", "f1", "f2"], spark).count() == 3


def test_gate_and_unknown_metrics(spark):
    m = spark.createDataFrame([("a", "roc_auc", 0.7), ("a", "f1", 0.4), ("b", "roc_auc", 0.5), ("b", "f1", 0.2)], "model_id string, metric string, value double")
    t = spark.createDataFrame([("roc_auc", 0.65, 0), ("f1", 0.3, 1)], "metric string, minimum double, position int")
    assert {r.model_id: (r.decision, r.failed_metric) for r in metrics.champion_gate(m, t).collect()} == {"a": ("promoted", None), "b": ("rejected", "roc_auc")}
    assert {r.decision for r in metrics.champion_gate(m, t, enabled=False).collect()} == {"auto_promoted"}
    with pytest.raises(metrics.UnknownMetric):
        metrics.champion_gate(m, t.withColumn("metric", F.lit("silhouette")))


def test_auc_with_ties_and_one_kind(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (None, 0.3)], "y int, s double")
    assert metrics.auc(df, "y", "s").first().auc == 0.875
    assert metrics.auc(df.filter("y = 1"), "y", "s").first().auc is None
    row = metrics.binary_metrics(df, "y", "s").first()
    assert (row.tp, row.fp, row.fn, row.tn) == (2, 1, 0, 1)


# ---------------------------------------------------------------- sources and streams


def test_first_table_that_is_there(spark):
    tables.use_database(spark, "marl")
    tables.write_table(spark.range(10), "bronze")
    assert tables.read_first_of(spark, ["gold", "bronze"], 4).count() == 4
    tables.write_table(spark.range(3), "gold")
    tables.write_table(spark.range(3), "gold", "append")
    assert tables.read_first_of(spark, ["gold", "bronze"]).count() == 6 and tables.read_table(spark, "gold").count() == 6
    tables.write_bucketed(spark.range(10), "dealt", ["id"], 2)
    assert tables.read_table(spark, "dealt").count() == 10
    with pytest.raises(LookupError):
        tables.read_first_of(spark, ["none"])
    spark.sql("DROP DATABASE marl CASCADE")
    spark.catalog.setCurrentDatabase("default")


def test_files_partitions_and_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string")
    for fmt in tables.FORMATS:
        tables.write_files(df, f"{tmp_path}/{fmt}", fmt)
        assert sorted(map(tuple, tables.read_files(spark, f"{tmp_path}/{fmt}", fmt, df.schema).collect())) == [(1, "a"), (2, "b")]
    tables.replace_partitions(df, f"{tmp_path}/parts", ["p"])
    tables.replace_partitions(df.filter("k = 1").withColumn("k", F.lit(9)), f"{tmp_path}/parts", ["p"])
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/parts").collect()) == [2, 9]
    assert len(tables.write_with_fingerprint(df, f"{tmp_path}/f")) == 16
    assert tables.write_version(df, str(tmp_path), "3").endswith("version=3")
    assert tables.union_models([df, df.select("k")]).filter("p is null").count() == 2
    with pytest.raises(ValueError):
        tables.read_files(spark, "x", "xml")


def test_stream_reads_each_file_once(spark, tmp_path):
    spark.range(3).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/in")
    read = lambda: ingest.with_ingestion_metadata(ingest.file_stream(spark, f"{tmp_path}/in"), "2024-01-02")
    ingest.append_available(read(), f"{tmp_path}/out", f"{tmp_path}/c")
    spark.range(2).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.append_available(read(), f"{tmp_path}/out", f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_stream_upserts(spark, tmp_path):
    one = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, t int, v string")
    one.write.parquet(f"{tmp_path}/in")
    held = KeyedTable(spark, f"{tmp_path}/out", ["k"], ["t"], buckets=4)
    go = lambda: upsert_stream(ingest.file_stream(spark, f"{tmp_path}/in").select("k", "t", "v"), held, f"{tmp_path}/c")
    go()
    spark.createDataFrame([(1, 2, "c"), (3, 0, "d"), (2, 0, "old")], "k int, t int, v string").write.mode("append").parquet(f"{tmp_path}/in")
    go()
    assert {r.k: r.v for r in held.read().collect()} == {1: "c", 2: "b", 3: "d"}
    assert KeyedTable(spark, f"{tmp_path}/nowhere", ["k"], ["t"]).read() is None


def test_names_with_odd_characters(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "`a.b` double, `c``d` double")
    assert scalar.numeric_columns(df) == ["a.b", "c`d"]
    assert [r.value for r in scalar.long_form(df, df.columns).collect()] == [1.0, 2.0]
    assert features.fit_scaler(df, ["a.b"])["a.b"] == (1.0, 1.0)


def test_exact_quantiles_of_odd_groups(spark):
    """Ties, single values, missing values and a value of most rows, against numpy."""
    import numpy as np

    from marlpit.operators.quantiles import exact_quantiles

    draw = np.random.default_rng(1)
    groups = {"even": draw.random(500).tolist(), "hot": [3.0] * 400 + draw.random(50).tolist(), "one": [7.5], "two": [1.0, 2.0], "steps": [float(k % 5) for k in range(333)], "none": [None, None]}
    rows = spark.createDataFrame([(g, v) for g, own in groups.items() for v in [*own, None]], "g string, value double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = {r.g: r.quantiles for r in exact_quantiles(rows, ["g"], shares).collect()}
    assert set(found) == set(groups) - {"none"}
    for g, own in found.items():
        assert np.allclose(own, np.quantile(groups[g], shares))
    assert exact_quantiles(rows.limit(0), ["g"], shares).count() == 0


def test_as_of_join_across_ranges(spark):
    """One key of very many rows, dealt into ranges of time: values are carried over ranges without features."""
    features = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:00:05", 2.0), (2, "2024-03-01 00:00:00", 9.0)], "k int, at string, v double").withColumn("at", F.col("at").cast("timestamp"))
    entities = spark.range(500).select(F.lit(1).alias("k"), F.expr("timestamp'2024-01-01 00:00:03' + make_interval(0, 0, 0, 0, cast(id as int))").alias("t"), "id")
    entities = entities.unionByName(spark.createDataFrame([(None, None, -1), (2, None, -2), (3, None, -3)], "k int, t timestamp, id bigint"))
    joined = store.as_of_join(entities, features, "k", "t", "at", ["v"], ranges=32)
    assert "_range" in joined._jdf.queryExecution().analyzed().toString() and "_range" not in store.as_of_join(entities, features, "k", "t", "at", ["v"])._jdf.queryExecution().analyzed().toString()
    found = {r.id: r.v for r in joined.collect()}
    assert len(found) == 503 and found[0] == 1.0 and found[-1] is None and found[-2] is None and found[-3] is None
    assert all(found[k] == 2.0 for k in range(1, 500))


def test_folds_are_even_within_classes(spark):
    from marlpit.ml import metrics

    df = spark.range(6000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    counts = {(r.y, r.fold): r.n for r in metrics.stratified_fold(df, "id", "y", 3).groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    assert all(abs(counts[1, k] - 200) < 30 and abs(counts[0, k] - 1800) < 60 for k in range(3))


def test_changes_are_those_between_versions(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "d"), (4, None)], "k int, v string")
    feed = store.changes(old, new, ["k"])
    assert {(r.k, r.v, r["_change"]) for r in feed.collect()} == {(1, "a", "delete"), (3, "d", "update"), (4, None, "insert")}
    assert sorted((r.k, r.v or "") for r in store.apply_changes(old, feed, ["k"]).collect()) == [(2, ""), (3, "d"), (4, "")]
