"""Samples, selections, sinks, change feeds and checks over the supplied tables, each with its DuckDB counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions import scalar
from marlpit.ml import metrics, training
from marlpit.operators import checks, drift, features, governance, monitoring, store
from marlpit.plans.base import CUT_DAY, Query, orders_sides, rounded, table
from marlpit.plans.drift_queries import COLUMNS, _shifted
from marlpit.sources import tables
from marlpit.sources.scratch import new_folder
from marlpit.streaming import ingest


@contextmanager
def _database(spark: SparkSession) -> Iterator[str]:
    """A new database in the shared folder, current inside the block."""
    before, name = spark.catalog.currentDatabase(), f"d_{uuid.uuid4().hex[:12]}"
    tables.use_database(spark, name, new_folder(spark, "database"))
    try:
        yield name
    finally:
        spark.catalog.setCurrentDatabase(before)


# ---------------------------------------------------------------- columns and samples


def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points and words of all texts."""
    return features.text_features(table(spark, sf_dir, "documents"), ["text"], ["doc_id"])


def picked_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tier for each customer, by place in a list."""
    tiers = F.array(*map(F.lit, ("bronze", "silver", "gold")))
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.picked(tiers, F.col("c_custkey") * 7 + 1).alias("tier"))


def random_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded numbers for each order, even and normal."""
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", scalar.uniform("o_orderkey").alias("even"), scalar.normal("o_orderkey", seed=7).alias("bell")), 9)


def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred orders drawn evenly."""
    return features.sampled(table(spark, sf_dir, "orders"), 500, ["o_orderkey"]).select("o_orderkey", "o_custkey")


def sampled_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift and missing values of samples of either side."""
    return rounded(monitoring.sampled_report(*orders_sides(spark, sf_dir), COLUMNS, ["o_orderkey"], 1_000), 5)


def silhouette_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silhouette of the labels as clusters, of two thousand vectors drawn evenly."""
    wide = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("cluster"), *(F.col("embedding")[k].alias(f"e{k}") for k in range(64)))
    ready = training.assemble(wide, [f"e{k}" for k in range(64)], ["vec_id", "cluster"])
    value = training.silhouette(ready, "cluster", 2_000, ["vec_id"])
    return rounded(table(spark, sf_dir, "embeddings").agg(F.count("*").alias("rows")).withColumn("silhouette", F.lit(value)), 5)


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by class and fold."""
    lines = table(spark, sf_dir, "lineitem").withColumn("record_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    held = metrics.stratified_fold(lines, "record_id", "l_returnflag", 5)
    return held.groupBy("l_returnflag", F.col("fold").cast("bigint").alias("fold")).agg(F.count("*").alias("n"), F.sum("record_id").alias("keys"))


def trained_on_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees, cross-validated, of a class that one column tells apart: nothing is left to be got wrong."""
    orders = table(spark, sf_dir, "orders").withColumn("odd", F.col("o_orderkey") % 2)
    _, folds = training.cross_validate(orders, "xgboost_classifier", ["odd", "o_totalprice"], "odd", "o_orderkey", {"n_estimators": 3, "max_depth": 2}, folds=2)
    return folds.select(F.col("fold").cast("bigint").alias("fold"), "metric", (F.col("value") == 1).alias("good"))


def clusters_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means of three groups that lie far apart: clusters are the groups."""
    given = table(spark, sf_dir, "customer").withColumn("group", F.col("c_custkey") % 3).withColumn("x", F.col("group") * 1_000_000 + F.col("c_acctbal"))
    models, results = training.train_all(spark, given, [{"model_id": "groups", "model_type": "kmeans", "features": ["x"], "parameters": {"n_clusters": 3}}], "c_custkey")
    found = training.score_models(given, "c_custkey", {"groups": (models["groups"], ["x"])})
    held = found.join(given.select(F.col("c_custkey").alias("record_id"), "group"), "record_id")
    good = results.agg(F.min(F.when(F.col("metric") == "silhouette_score", F.col("value") > 0.99)).alias("apart"))
    return held.groupBy("group").agg(F.count("*").alias("n"), F.count_distinct("cluster_id").alias("clusters")).crossJoin(good)  # one row


# ---------------------------------------------------------------- selection


def importance_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest columns that have nine tenths of the regression scores."""
    scores = features.regression_scores(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice")
    return rounded(features.select_by_importance(scores, 0.9), 3)


def columns_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of columns by the beginnings of their names, and sums of the numeric ones."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_size").alias("num_size"), F.col("p_retailprice").alias("num_price"), F.col("p_brand").alias("cat_brand"))
    roles = features.ColumnRoles.of(parts)
    rows = parts.agg(F.count("*").alias("rows"), *(F.sum(scalar.number(c)).alias(f"sum_{c}") for c in roles.numeric), *(F.count_distinct(c).alias(f"values_{c}") for c in roles.categorical))
    return rounded(rows, 2)


def usable_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled sums of the columns that are neither ids nor targets nor metadata."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), "o_custkey", "o_totalprice", (F.col("o_custkey") % 2).alias("target_binary"), F.lit(1).alias("_batch"))
    return rounded(orders.agg(*(F.sum(scalar.filled(c)).alias(c) for c in features.feature_columns(orders))), 2)


def indexed_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments as indices, the most frequent first."""
    customers = table(spark, sf_dir, "customer")
    return features.index_by_frequency(customers, ["c_mktsegment"]).transform(customers).select("c_custkey", "c_mktsegment_indexed")


def approximate_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether approximate quantiles of the prices lie as near to their ranks as they must."""
    orders = table(spark, sf_dir, "orders")
    found = features.quantile_edges(orders, ["o_totalprice"], [0.25, 0.5, 0.75], exact=False, accuracy=1_000)["o_totalprice"]
    below = orders.agg(F.count("*").alias("n"), *(F.count_if(F.col("o_totalprice") <= q).alias(f"b{k}") for k, q in enumerate(found)))
    near = [F.abs(F.col(f"b{k}") / F.col("n") - s) <= 0.002 for k, s in enumerate((0.25, 0.5, 0.75))]
    return below.select("n", *(x.alias(f"near_{k}") for k, x in enumerate(near)))


# ---------------------------------------------------------------- checks and monitoring


def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = checks.evaluate(table(spark, sf_dir, "orders"), [checks.not_empty(), checks.unique("o_orderkey"), checks.unique("o_custkey"), checks.in_set("o_orderstatus", ["F", "O"])], "orders")
    two = checks.evaluate(table(spark, sf_dir, "customer"), [checks.not_empty(), checks.unique("c_custkey"), checks.not_null("c_name")], "customer")
    return rounded(checks.scorecard(one.unionByName(two)))


def expected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without those that break a rule on rows."""
    good = checks.expect(table(spark, sf_dir, "orders"), [checks.in_set("o_orderstatus", ["F", "O"]), checks.between("o_totalprice", 1_000, 200_000)], "drop")
    return rounded(checks.expect(good, [checks.unique("o_orderkey")], "fail").select("o_orderkey", "o_orderstatus", "o_totalprice"))


def newest_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.newest(table(spark, sf_dir, "events"), ["user_id"], "ts")
    return found.select("user_id", F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"), "rows")


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(checks.describe(table(spark, sf_dir, "orders"), "o_totalprice"), 4)


def retained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last ten days before a day."""
    return checks.retained(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp"), 10).select("event_id", "user_id")


def drift_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders of 1997 are held against, by either choice."""
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    out = [drift.reference_of(orders, "year", 1997, choice).select(F.lit(choice).alias("choice"), "year", "o_totalprice") for choice in ("training", "previous", "1996")]
    every = out[0].unionByName(out[1]).unionByName(out[2])
    return rounded(every.groupBy("choice", F.col("year").cast("bigint").alias("year")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")), 4)


def drifted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that have drifted, and their alerts."""
    bad = drift.drifted(drift.drift_table(*_shifted(spark, sf_dir), COLUMNS))
    return rounded(bad.select("feature", "psi", "ks_statistic"), 8)


def _metrics_of(spark: SparkSession, sf_dir: str, even: bool) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter((F.col("o_orderkey") % 2 == 0) if even else (F.col("o_orderkey") % 2 == 1))
    found = orders.groupBy(F.col("o_orderpriority").alias("model_id")).agg(F.avg((F.col("o_custkey") % 3 == 0).cast("double")).alias("value"))
    return found.withColumn("metric", F.lit("roc_auc"))


def metric_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each priority's share of customers, between even and odd orders, as a metric that may fall."""
    return rounded(monitoring.metric_drop(_metrics_of(spark, sf_dir, True), _metrics_of(spark, sf_dir, False), "roc_auc", 0.02))


def successful_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _metrics_of(spark, sf_dir, True).withColumn("status", F.when(F.col("value") > 0.33, "success").otherwise("failed"))
    return monitoring.successful(results)


def monitoring_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's tables written and read back: features, their drift, and columns with issues."""
    before, after = _shifted(spark, sf_dir)
    out = new_folder(spark, "monitoring")
    monitoring.save(monitoring.run(before.select(*COLUMNS), after.select(*COLUMNS)), out)
    held = spark.read.parquet(f"{out}/drift").join(spark.read.parquet(f"{out}/quality"), "feature")
    return rounded(held.select("feature", "is_drifted", "psi", F.col("null_rate"), F.size("issues").cast("bigint").alias("issues")), 8)


# ---------------------------------------------------------------- sources and sinks


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as a table in two parts, read by name, and by the first name that is there."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    with _database(spark) as name:
        tables.write_table(customers.filter("c_nationkey < 10"), "customers")
        tables.write_table(customers.filter("c_nationkey >= 10"), "customers", mode="append")
        one = tables.read_table(spark, f"{name}.customers").groupBy("c_nationkey").agg(F.count("*").alias("n"))
        two = tables.read_first_of(spark, [f"{name}.nowhere", f"{name}.customers"]).groupBy("c_nationkey").agg(F.max("c_custkey").alias("highest"))
    return one.join(two, "c_nationkey")


def versions_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table with different columns, and what both hold by name."""
    out = new_folder(spark, "versions")
    parts = table(spark, sf_dir, "part")
    one = tables.write_version(parts.select("p_partkey", "p_size"), out, "1")
    two = tables.write_version(parts.select("p_partkey", (F.col("p_size") + 1).alias("p_size"), "p_brand"), out, "2")
    both = tables.union_models([tables.read_files(spark, one).withColumn("version", F.lit(1)), tables.read_files(spark, two).withColumn("version", F.lit(2))])
    return both.groupBy(F.col("version").cast("bigint").alias("version")).agg(F.count("*").alias("n"), F.sum("p_size").alias("size"), F.count("p_brand").alias("brands"))


def fingerprints_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of what was written is that of what was given, in any order, and not that of other rows."""
    orders = table(spark, sf_dir, "orders")
    mark = tables.write_with_fingerprint(orders.orderBy(F.desc("o_orderkey")), new_folder(spark, "marked"))
    same = store.fingerprint(orders).select("rows", (F.col("fingerprint") == mark).alias("same"))
    other = store.fingerprint(orders.withColumn("o_custkey", F.col("o_custkey") + F.when(F.col("o_orderkey") == 1, 1).otherwise(0))).select((F.col("fingerprint") == mark).alias("same_if_changed"))
    return same.crossJoin(other)  # one row each


def results_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training results of two runs, the second written twice, read back."""
    out = new_folder(spark, "results")
    made = _metrics_of(spark, sf_dir, True).select("model_id", "metric", "value", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"))
    for run in ("a", "b", "b"):
        training.save_results(made.withColumn("run_id", F.lit(run)), out)
    return rounded(spark.read.parquet(out).groupBy("run_id", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


def opted_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers who aren't on the list."""
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey")
    left = governance.exclude_opted_out(table(spark, sf_dir, "orders"), "o_custkey", gone, "c_custkey")
    return left.select("o_orderkey", "o_custkey")


def snapshot_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of four tables: the one of an id, and its place among the latest."""
    held = governance.Snapshots(spark, new_folder(spark, "snapshots"))
    made = [held.create(table(spark, sf_dir, n), description=n)["snapshot_id"] for n in ("nation", "part", "orders", "customer")]
    row, last = held.get(made[2]), [r.snapshot_id for r in held.latest(2).collect()]
    agree = store.fingerprint(table(spark, sf_dir, "orders")).select("rows", (F.col("fingerprint") == row["dataset_hash"]).alias("same_hash"))
    return agree.select("rows", "same_hash", F.lit(row["num_rows"]).alias("num_rows"), F.lit(row["description"]).alias("description"), F.lit(last.index(made[2]) + 1).cast("bigint").alias("place"), F.lit(held.get("none") is None).alias("none_is_none"))


def stores_by_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table registered in two environments, which don't see each other."""
    base = new_folder(spark, "stores")
    config = {"paths": {"dev": f"{base}/dev", "prod": f"{base}/prod"}}
    suppliers = table(spark, sf_dir, "supplier")
    store.FeatureStore.of(spark, config | {"environment": "dev"}).register("supplier", suppliers, "v1")
    store.FeatureStore.of(spark, config | {"environment": "prod"}).register("supplier", suppliers.filter("s_nationkey < 10"), "v1")
    read = [store.FeatureStore.of(spark, config | {"environment": e}).read("supplier").agg(F.count("*").alias("rows")).select(F.lit(e).alias("environment"), "rows") for e in ("dev", "prod")]
    return read[0].unionByName(read[1])


def named_feature_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set from configuration: the column of most variance that is no id, of all orders."""
    held = store.FeatureStore(spark, new_folder(spark, "store"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), "o_custkey", "o_totalprice", F.month("o_orderdate").alias("o_month"))
    held.register("orders", orders, "v1")
    return rounded(held.feature_set(orders.select("record_id"), {"source": "orders", "selection": "variance", "size": 1, "ids": ["o_custkey"]}).data)


# ---------------------------------------------------------------- changes and streams


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two versions of the parts."""
    return rounded(store.changes(*_part_versions(spark, sf_dir), ["p_partkey"]))


def _part_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    newer = parts.filter("p_partkey % 10 <> 2").withColumn("p_retailprice", F.col("p_retailprice") + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0))
    return parts.filter("p_partkey % 10 <> 1"), newer


def changes_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newer version again, from the older one and the feed."""
    old, new = _part_versions(spark, sf_dir)
    return rounded(store.apply_changes(old, store.changes(old, new, ["p_partkey"]), ["p_partkey"]))


def stream_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in two arrivals, the second with a new column, through one checkpoint."""
    out = new_folder(spark, "evolving")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for arrival, rows in (("1", events.filter("event_id % 2 = 0").drop("value")), ("2", events.filter("event_id % 2 = 1"))):
        rows.write.parquet(f"{out}/landing/arrival={arrival}")
        ingest.append_available(ingest.file_stream(spark, f"{out}/landing").drop("_metadata"), f"{out}/bronze", f"{out}/checkpoint")
    found = spark.read.option("mergeSchema", "true").parquet(f"{out}/bronze")
    return rounded(found.groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("with_value"), F.sum("value").alias("total")), 4)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        text_features, picked_elements, random_columns, sampled_rows, sampled_report, silhouette_sampled, stratified_folds, trained_on_separable, clusters_apart, importance_selection, columns_by_prefix, usable_columns, indexed_by_frequency,
        approximate_quantiles, scorecard, expected_rows, newest_by_user, described, retained_rows, drift_reference, drifted_features, metric_drop, successful_models, monitoring_saved, catalog_tables,
        versions_written, fingerprints_agree, results_saved, opted_out, snapshot_found, stores_by_environment, named_feature_set, change_feed, changes_applied, stream_evolution,
    )
}


def _uniform(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5({key} || '|{seed}'), 1, 12))::BIGINT / {1 << 48})"


def _side(op: str, n: int) -> str:
    return f"(SELECT * FROM orders WHERE o_orderdate {op} TIMESTAMP '{CUT_DAY}' ORDER BY md5(o_orderkey || '|42'), o_orderkey LIMIT {n})"


def _metrics_sql(rest: int) -> str:
    return f"(SELECT o_orderpriority AS model_id, avg((o_custkey % 3 = 0)::INT::DOUBLE) AS value FROM orders WHERE o_orderkey % 2 = {rest} GROUP BY 1)"


def _report(c: str) -> str:
    return f"""SELECT '{c}' AS feature, round((SELECT avg({c}) FROM r), 5) AS ref_mean, round(avg({c}), 5) AS cur_mean, round(abs(avg({c}) - (SELECT avg({c}) FROM r)) / ((SELECT stddev_pop({c}) FROM r) + 1e-8), 5) AS mean_shift,
        avg(({c} IS NULL)::INT)::DOUBLE AS null_rate FROM c"""


_VERSIONS = """o AS (SELECT p_partkey, p_retailprice FROM part WHERE p_partkey % 10 <> 1), n AS (SELECT p_partkey, p_retailprice + (p_partkey % 5 = 0)::INT AS p_retailprice FROM part WHERE p_partkey % 10 <> 2)"""


def _oracles() -> dict[str, str]:
    from marlpit.plans.drift_queries import _KS, _PSI, _long

    drifting = f"WITH {_long('1.5')}, {_PSI}, {_KS}"
    return {
        "text_features": r"SELECT doc_id, coalesce(length(text), 0)::DOUBLE AS text_len_text, coalesce(len(regexp_extract_all(text, '[^\t\n\x0B\f\r ]+')), 0)::DOUBLE AS text_words_text FROM documents",
        "picked_elements": "SELECT c_custkey, ['bronze', 'silver', 'gold'][(c_custkey * 7 + 1) % 3 + 1] AS tier FROM customer",
        "random_columns": f"SELECT o_orderkey, round({_uniform('o_orderkey', 42)}, 9) AS even, round(sqrt(-2 * ln(1 - {_uniform('o_orderkey', 7)})) * cos(2 * pi() * {_uniform('o_orderkey', 8)}), 9) + 0.0 AS bell FROM orders",
        "sampled_rows": "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(o_orderkey || '|42'), o_orderkey LIMIT 500",
        "sampled_report": f"WITH r AS {_side('<', 1000)}, c AS {_side('>=', 1000)} {' UNION ALL '.join(map(_report, COLUMNS))}",
        "stratified_folds": """WITH l AS (SELECT l_returnflag, l_orderkey * 10 + l_linenumber AS k, md5((l_orderkey * 10 + l_linenumber) || '|42') AS h FROM lineitem), p AS (SELECT *, ('0x' || substr(h, 1, 2))::INT AS part FROM l),
            f AS (SELECT l_returnflag, k, (row_number() OVER (PARTITION BY l_returnflag, part ORDER BY h, k) + part) % 5 AS fold FROM p) SELECT l_returnflag, fold, count(*) AS n, sum(k)::BIGINT AS keys FROM f GROUP BY 1, 2""",
        "trained_on_separable": "SELECT f::BIGINT AS fold, m AS metric, true AS good FROM range(2) t(f), unnest(['roc_auc', 'f1', 'precision', 'recall', 'accuracy']) u(m)",
        "clusters_apart": 'SELECT c_custkey % 3 AS "group", count(*) AS n, 1::BIGINT AS clusters, true AS apart FROM customer GROUP BY 1',
        "importance_selection": "WITH s AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) ** 2 / (1 - corr({c}, l_extendedprice) ** 2) * (count(*) - 2) AS score FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber"))
        + "), r AS (SELECT *, row_number() OVER w AS place, coalesce(sum(score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(score) OVER () AS whole FROM s WINDOW w AS (ORDER BY score DESC, feature)) SELECT feature, round(score, 3) AS score, place FROM r WHERE before < 0.9 * whole",
        "columns_by_prefix": "SELECT count(*) AS rows, sum(p_size)::DOUBLE AS sum_num_size, round(sum(p_retailprice), 2) AS sum_num_price, count(DISTINCT p_brand) AS values_cat_brand FROM part",
        "usable_columns": "SELECT sum(o_custkey)::DOUBLE AS o_custkey, round(sum(o_totalprice), 2) AS o_totalprice FROM orders",
        "indexed_by_frequency": "WITH k AS (SELECT c_mktsegment, (row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1)::DOUBLE AS c_mktsegment_indexed FROM customer GROUP BY 1) SELECT c_custkey, c_mktsegment_indexed FROM customer JOIN k USING (c_mktsegment)",
        "approximate_quantiles": "SELECT count(*) AS n, true AS near_0, true AS near_1, true AS near_2 FROM orders",
        "scorecard": """WITH s AS (SELECT 'orders' AS dataset, 4::BIGINT AS checks, ((count(*) > 0)::INT + (count(*) = count(DISTINCT o_orderkey))::INT + (count(*) = count(DISTINCT o_custkey))::INT + (count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) = 0)::INT) / 4 AS share FROM orders
            UNION ALL SELECT 'customer', 3::BIGINT, ((count(*) > 0)::INT + (count(*) = count(DISTINCT c_custkey))::INT + (count(*) = count(c_name))::INT) / 3 FROM customer)
            SELECT dataset, checks, round(100 * share, 6) AS score, CASE WHEN share >= 0.95 THEN 'good' WHEN share >= 0.8 THEN 'fair' ELSE 'poor' END AS grade FROM s""",
        "expected_rows": "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000",
        "newest_by_user": "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest, count(*) AS rows FROM events GROUP BY 1",
        "described": " UNION ALL ".join(f"SELECT '{n}' AS summary, round({f}, 4)::DOUBLE AS value FROM orders" for n, f in (("count", "count(o_totalprice)"), ("mean", "avg(o_totalprice)"), ("stddev", "stddev_samp(o_totalprice)"), ("min", "min(o_totalprice)"), ("max", "max(o_totalprice)"))),
        "retained_rows": "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY",
        "drift_reference": """WITH o AS (SELECT year(o_orderdate) AS year, o_totalprice FROM orders), w AS (SELECT 'training' AS choice, min(year) AS year FROM o UNION ALL SELECT 'previous', max(year) FROM o WHERE year < 1997 UNION ALL SELECT '1996', 1996)
            SELECT choice, year, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM o JOIN w USING (year) GROUP BY 1, 2""",
        "drifted_features": f"{drifting} SELECT feature, round(psi, 8) AS psi, round(ks_statistic, 8) AS ks_statistic FROM psi JOIN ks USING (feature) WHERE psi > 0.2 OR ks_pvalue < 0.05",
        "metric_drop": f"SELECT model_id, round(a.value, 6) AS before, round(b.value, 6) AS after, round((a.value - b.value) / nullif(a.value, 0), 6) + 0.0 AS drop, coalesce((a.value - b.value) / nullif(a.value, 0) > 0.02, false) AS flagged FROM {_metrics_sql(0)} a JOIN {_metrics_sql(1)} b USING (model_id)",
        "successful_models": f"SELECT model_id FROM {_metrics_sql(0)} WHERE value > 0.33",
        "monitoring_saved": f"{drifting} SELECT feature, psi > 0.2 OR ks_pvalue < 0.05 AS is_drifted, round(psi, 8) AS psi, CASE feature WHEN 'o_totalprice' THEN (SELECT avg((o_totalprice IS NULL)::INT) FROM orders) ELSE (SELECT avg((o_custkey IS NULL)::INT) FROM orders) END::DOUBLE AS null_rate, 0::BIGINT AS issues FROM psi JOIN ks USING (feature)",
        "catalog_tables": "SELECT c_nationkey, count(*) AS n, max(c_custkey) AS highest FROM customer GROUP BY 1",
        "versions_written": "SELECT 1::BIGINT AS version, count(*) AS n, sum(p_size)::BIGINT AS size, 0::BIGINT AS brands FROM part UNION ALL SELECT 2, count(*), sum(p_size + 1)::BIGINT, count(p_brand) FROM part",
        "fingerprints_agree": "SELECT count(*) AS rows, true AS same, false AS same_if_changed FROM orders",
        "results_saved": f"SELECT r.run_id, 'roc_auc' AS metric, count(*) AS n, round(avg(value), 6) AS mean FROM {_metrics_sql(0)}, (VALUES ('a'), ('b')) r(run_id) GROUP BY 1",
        "opted_out": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
        "snapshot_found": "SELECT count(*) AS rows, true AS same_hash, count(*) AS num_rows, 'orders' AS description, 2::BIGINT AS place, true AS none_is_none FROM orders",
        "stores_by_environment": "SELECT 'dev' AS environment, count(*) AS rows FROM supplier UNION ALL SELECT 'prod', count(*) FROM supplier WHERE s_nationkey < 10",
        "named_feature_set": "SELECT o_orderkey AS record_id, round(o_totalprice, 6) AS o_totalprice FROM orders",
        "change_feed": f"WITH {_VERSIONS} SELECT p_partkey, round(coalesce(n.p_retailprice, o.p_retailprice), 6) AS p_retailprice, CASE WHEN o.p_retailprice IS NULL THEN 'insert' WHEN n.p_retailprice IS NULL THEN 'delete' ELSE 'update' END AS _change FROM o FULL JOIN n USING (p_partkey) WHERE o.p_retailprice IS DISTINCT FROM n.p_retailprice",
        "changes_applied": f"WITH {_VERSIONS} SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice FROM n",
        "stream_evolution": "SELECT event_type, count(*) AS n, count(value) FILTER (event_id % 2 = 1) AS with_value, round(sum(value) FILTER (event_id % 2 = 1), 4) AS total FROM events GROUP BY 1",
    }


ORACLES: dict[str, str] = _oracles()
