"""Searches, many small models fitted together, and scoring in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.ml import grouped, halving, training
from marlpit.operators import features as transforms
from marlpit.plans.base import Query, rounded, table

#: Columns whose bins are single values, in the order in which splits of one gain are taken.
SPLIT_BY = ["l_discount", "l_linenumber"]


def _either(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose class is that one of two columns holds, but not both: no column tells it alone, and no sum of single splits does."""
    orders = table(spark, sf_dir, "orders").withColumns({"a": (F.col("o_orderkey") % 3 == 0).cast("int"), "b": (F.col("o_custkey") % 4 == 0).cast("int")})
    return orders.select("o_orderkey", "a", "b", "o_totalprice", (F.col("a") != F.col("b")).cast("int").alias("either"))


def halving_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The depth that halving finds for such a class, as the whole grid does for more than twice the cost, and what it gets right."""
    rows, features, space = _either(spark, sf_dir), ["a", "b", "o_totalprice"], {"max_depth": [1, 3], "n_estimators": [4, 8]}
    found = halving.successive_halving(rows, "xgboost_classifier", features, "either", "o_orderkey", space, trials=4, rungs=3)
    _, best, _ = training.search(rows, "xgboost_classifier", features, "either", "o_orderkey", space, trials=4, folds=2)
    scored = training.score_models(rows, "o_orderkey", {"best": (found.model, features)}).select(F.col("record_id").alias("o_orderkey"), "prediction")
    hits = scored.join(rows, "o_orderkey").groupBy("either").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("either")).alias("right"))
    fits = found.trials.count()
    return hits.withColumns({"max_depth": F.lit(found.parameters["max_depth"]).cast("bigint"), "as_grid": F.lit(best["max_depth"] == found.parameters["max_depth"]), "under_half": F.lit(found.cost < 2), "fits": F.lit(fits).cast("bigint")})


def grouped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each part: price by quantity, all parts in one job."""
    found = grouped.linear_models(table(spark, sf_dir, "lineitem"), "l_partkey", ["l_quantity"], "l_extendedprice")
    return rounded(found.select("l_partkey", "n", "intercept", F.get("weights", F.lit(0)).alias("slope"), "r2"), 4)


def grouped_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one split of each supplier's lines that tells most about their quantity."""
    found = grouped.grouped_trees(table(spark, sf_dir, "lineitem"), "l_suppkey", SPLIT_BY, "l_quantity", depth=1)
    names = F.array(*map(F.lit, SPLIT_BY))
    at = lambda c, k: F.get(c, F.lit(k))
    return rounded(found.select("l_suppkey", F.get(names, at("features", 1)).alias("feature"), at("thresholds", 1).alias("threshold"), at("values", 2).alias("below"), at("values", 3).alias("above")))


def grouped_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as each supplier's split has them, summed by order."""
    lines = table(spark, sf_dir, "lineitem").withColumn("record_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    trees = grouped.grouped_trees(lines, "l_suppkey", SPLIT_BY, "l_quantity", depth=1)
    scored = grouped.score_trees(lines, "l_suppkey", "record_id", SPLIT_BY, trees, 1)
    return rounded(scored.groupBy(F.expr("record_id div 10").alias("l_orderkey")).agg(F.count("*").alias("n"), F.sum("prediction").alias("total")), 4)


def flat_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three trained models over one scan, against what is true: a class, its chance, a value that steps, and clusters far apart."""
    rows = _either(spark, sf_dir).withColumns({"step": F.when(F.col("a") == 1, 70.0).otherwise(20.0), "far": F.col("o_orderkey") % 3 * 1_000_000})
    features = ["a", "b", "o_totalprice"]
    registry = [
        {"model_id": "either", "model_type": "xgboost_classifier", "features": features, "target": "either", "parameters": {"max_depth": 3, "n_estimators": 4}},
        {"model_id": "step", "model_type": "xgboost_regressor", "features": ["a"], "target": "step", "training_filter": "o_orderkey % 10 < 8", "parameters": {"max_depth": 1, "n_estimators": 1}},
        {"model_id": "far", "model_type": "kmeans", "features": ["far"], "parameters": {"n_clusters": 3}},
    ]
    models, _ = training.train_all(spark, rows, registry, "o_orderkey")
    scored = training.score_models(rows, "o_orderkey", {e["model_id"]: (models[e["model_id"]], e["features"]) for e in registry})
    held = scored.join(rows.withColumnRenamed("o_orderkey", "record_id"), "record_id")
    truth = F.when(F.col("model_id") == "either", F.col("either")).when(F.col("model_id") == "step", F.col("step")).otherwise(F.col("far") / 1_000_000)
    return held.groupBy("model_id", truth.cast("double").alias("truth")).agg(
        F.count("*").alias("n"), F.count_if(F.abs(F.col("prediction") - truth) < 1e-9).alias("right"), F.count_if((F.col("probability") >= 0.5) == (truth == 1)).alias("likely"), F.count_distinct("cluster_id").alias("clusters"), F.count("error").alias("errors")
    )


def model_importance_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that a fitted model goes by: as few as have nine tenths of its importance."""
    rows, features = _either(spark, sf_dir), ["o_totalprice", "b", "a"]
    model, _ = training.cross_validate(rows, "lightgbm_classifier", features, "either", "o_orderkey", {"max_depth": 2, "n_estimators": 3}, folds=2)
    chosen = transforms.select_by_importance(transforms.importance(model, features, spark), 0.9)
    ones = rows.agg(*(F.sum(f).alias(f) for f in ("a", "b"))).select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("bigint").alias("ones")) for f in ("a", "b")))))
    return chosen.select("feature").join(ones, "feature", "left")


QUERIES: dict[str, Query] = {f.__name__: f for f in (model_importance_selection, halving_search, grouped_lines, grouped_stumps, grouped_tree_scores, flat_scored)}

#: The best split of each supplier: of every value of a feature but the lowest, what lies below it.
_STUMPS = """v AS (SELECT l_suppkey, l_orderkey, l_quantity AS y, l_discount AS x0, l_linenumber::DOUBLE AS x1 FROM lineitem),
    u AS (SELECT l_suppkey, 0 AS f, x0 AS x, y FROM v UNION ALL SELECT l_suppkey, 1, x1, y FROM v),
    c AS (SELECT l_suppkey, f, x, count(*) AS n, sum(y) AS s FROM u GROUP BY ALL),
    r AS (
        SELECT l_suppkey, f, x, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY l_suppkey, f) AS n, sum(s) OVER (PARTITION BY l_suppkey, f) AS s
        FROM c WINDOW w AS (PARTITION BY l_suppkey, f ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    g AS (SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM r WHERE nl > 0),
    b AS (SELECT * FROM g WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY gain DESC, f, x) = 1)"""

ORACLES: dict[str, str] = {
    "model_importance_selection": "SELECT 'a' AS feature, count(*) FILTER (o_orderkey % 3 = 0) AS ones FROM orders UNION ALL SELECT 'b', count(*) FILTER (o_custkey % 4 = 0) FROM orders",
    "halving_search": """WITH o AS (SELECT ((o_orderkey % 3 = 0) <> (o_custkey % 4 = 0))::INT AS either FROM orders)
        SELECT either, count(*) AS n, count(*) AS right, 3::BIGINT AS max_depth, true AS as_grid, true AS under_half, 7::BIGINT AS fits FROM o GROUP BY either""",
    "grouped_lines": """SELECT l_partkey, count(*) AS n, round(CASE WHEN var_pop(l_quantity) > 0 THEN regr_intercept(l_extendedprice, l_quantity) ELSE avg(l_extendedprice) END, 4) + 0.0 AS intercept,
        round(CASE WHEN var_pop(l_quantity) > 0 THEN regr_slope(l_extendedprice, l_quantity) ELSE 0 END, 4) + 0.0 AS slope,
        round(CASE WHEN var_pop(l_extendedprice) = 0 THEN NULL WHEN var_pop(l_quantity) = 0 THEN 0 ELSE regr_r2(l_extendedprice, l_quantity) END, 4) + 0.0 AS r2 FROM lineitem GROUP BY 1""",
    "grouped_stumps": f"""WITH {_STUMPS} SELECT s.l_suppkey, CASE f WHEN 0 THEN 'l_discount' WHEN 1 THEN 'l_linenumber' END AS feature, round(x, 6) + 0.0 AS threshold, round(sl / nl, 6) + 0.0 AS below, round((s.total - sl) / (s.rows - nl), 6) + 0.0 AS above
        FROM (SELECT l_suppkey, count(*) AS rows, sum(l_quantity) AS total FROM lineitem GROUP BY 1) s LEFT JOIN b USING (l_suppkey)""",
    "grouped_tree_scores": f"""WITH {_STUMPS} SELECT l_orderkey, count(*) AS n, round(sum(CASE WHEN CASE f WHEN 0 THEN x0 ELSE x1 END < x THEN sl / nl ELSE (s - sl) / (n - nl) END), 4) + 0.0 AS total FROM v JOIN b USING (l_suppkey) GROUP BY 1""",
    "flat_scored": """WITH o AS (SELECT ((o_orderkey % 3 = 0) <> (o_custkey % 4 = 0))::INT::DOUBLE AS either, CASE WHEN o_orderkey % 3 = 0 THEN 70.0 ELSE 20.0 END::DOUBLE AS step, (o_orderkey % 3)::DOUBLE AS far FROM orders)
        SELECT 'either' AS model_id, either AS truth, count(*) AS n, count(*) AS right, count(*) AS likely, 0 AS clusters, 0 AS errors FROM o GROUP BY 2
        UNION ALL SELECT 'step', step, count(*), count(*), 0, 0, 0 FROM o GROUP BY 2 UNION ALL SELECT 'far', far, count(*), 0, 0, 1, 0 FROM o GROUP BY 2""",
}
