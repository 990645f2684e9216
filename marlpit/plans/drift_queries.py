"""Drift measures and monitoring over the supplied tables: earlier orders against later ones, and fixed models' scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.ml import training
from marlpit.operators import checks, drift, monitoring, sketches
from marlpit.plans.base import CUT_DAY, Query, orders_sides, rounded, table
from marlpit.sources.scratch import new_folder

COLUMNS = ["o_totalprice", "o_custkey"]
#: Fixed linear models of order lines; the last predicts one value.
MODELS = {
    "price_model": {"l_extendedprice": 0.001, "l_discount": -5.0, "intercept": 1.0},
    "quantity_model": {"l_quantity": 0.5, "l_tax": 2.0, "intercept": 0.0},
    "flat_model": {"l_quantity": 0.0, "intercept": 3.0},
}


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id, record_id, prediction, probability) of the fixed models for all order lines."""
    lines = table(spark, sf_dir, "lineitem").withColumn("record_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    scored = training.score_linear(lines, "record_id", MODELS)
    return scored.withColumn("probability", F.col("prediction") / (F.abs("prediction") + 10))


def psi_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.psi(*orders_sides(spark, sf_dir), COLUMNS), 8)


def psi_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.psi(*_shifted(spark, sf_dir), COLUMNS, mode="approx", accuracy=100_000)
    return rounded(found.withColumn("band", drift.psi_band(F.col("psi"))), 8)


def psi_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.histogram(*orders_sides(spark, sf_dir), ["o_totalprice"]).select("feature", F.col("bin").cast("bigint").alias("bin"), "ref_n", "cur_n")


def ks_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.ks(*orders_sides(spark, sf_dir), COLUMNS), 8)


def wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.wasserstein(*orders_sides(spark, sf_dir), COLUMNS), 3)


def mean_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.mean_shift(*orders_sides(spark, sf_dir), COLUMNS), 5)


def _shifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The later orders made dearer, so that there is drift to be found."""
    before, after = orders_sides(spark, sf_dir)
    return before, after.withColumn("o_totalprice", F.col("o_totalprice") * 1.5)


def stored_sketch_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift between years of orders from sketches of each month that were written before, against the exact measures of the rows."""
    before, after = _shifted(spark, sf_dir)
    rows = before.withColumn("side", F.lit(0)).unionByName(after.withColumn("side", F.lit(1))).withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    path = new_folder(spark, "sketches")
    sketches.save(sketches.sketch(rows, COLUMNS, ["side", "month"]), path, "v1")
    held = sketches.load(spark, path, "v1")
    one, two = (sketches.merge(held.filter(F.col("side") == k)) for k in (0, 1))
    found = sketches.drift(one, two)
    exact = drift.psi(before, after, COLUMNS).withColumnRenamed("psi", "exact_psi").join(drift.ks(before, after, COLUMNS).select("feature", F.col("ks_statistic").alias("exact_ks")), "feature")
    near = lambda a, b, most: F.abs(F.col(a) - F.col(b)) < most
    out = found.join(exact, "feature").select("feature", "ref_n", "cur_n", "ref_mean", "cur_mean", near("psi", "exact_psi", 0.05).alias("psi_near"), near("ks_statistic", "exact_ks", 2 * sketches.RANK_ERROR).alias("ks_near"))
    return rounded(out, 4)


def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.drift_summary(drift.drift_table(*_shifted(spark, sf_dir), COLUMNS)))


def drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _shifted(spark, sf_dir)
    table_ = drift.drift_table(before, after, ["o_totalprice"])
    quality = checks.profile(after.withColumn("always", F.lit(1)), ["o_totalprice", "always"])
    return monitoring.alerts(drift.drift_summary(table_), quality, monitoring.prediction_distribution(predictions(spark, sf_dir)))


def chi2_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.chi_square(*orders_sides(spark, sf_dir), "o_orderpriority"), 6)


def cardinality_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(checks.cardinality_change(*orders_sides(spark, sf_dir), ["o_custkey", "o_orderpriority", "o_orderstatus"]))


def prediction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitoring.prediction_stats(predictions(spark, sf_dir)), 5)


def prediction_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitoring.prediction_distribution(predictions(spark, sf_dir)), 5)


def inference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitoring.inference_summary(predictions(spark, sf_dir)), 5)


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("half_"), (F.col("vec_id") % 2).cast("string")).alias("model_id"), F.col("label").alias("cluster_id"))
    found = monitoring.cluster_sizes(assigned)
    as_text = F.transform(F.map_entries("cluster_sizes"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    return found.select("model_id", "n_clusters", F.array_join(as_text, ",").alias("cluster_sizes"))


def monitoring_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for a whole monitoring run."""
    before, after = _shifted(spark, sf_dir)
    made = monitoring.run(before.select(*COLUMNS), after.select(*COLUMNS), predictions(spark, sf_dir))
    trained = made["predictions"].select("model_id", F.when(F.col("warning").isNull(), "success").otherwise("failed").alias("status"))
    return rounded(monitoring.roll_up(trained, predictions(spark, sf_dir), made["alerts"], made["drift"], made["predictions"]))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (stored_sketch_drift, psi_exact, psi_approximate, psi_histogram, ks_drift, wasserstein, mean_shift, drift_summary, drift_alerts, chi2_drift, cardinality_change, prediction_stats, prediction_distribution, inference_summary, cluster_sizes, monitoring_run)
}

_SIDES = f"SELECT *, (o_orderdate >= TIMESTAMP '{CUT_DAY}')::INT AS side FROM orders"


def _long(factor: str = "1") -> str:
    return f"l AS (SELECT 'o_totalprice' AS feature, side, o_totalprice * CASE WHEN side = 1 THEN {factor} ELSE 1 END AS v FROM ({_SIDES}) UNION ALL SELECT 'o_custkey', side, o_custkey::DOUBLE FROM ({_SIDES}))"


_PSI = """q AS (SELECT feature, list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM l WHERE side = 0 GROUP BY feature),
t AS (SELECT feature, count(*) FILTER (side = 0) AS rn, count(*) FILTER (side = 1) AS cn FROM l GROUP BY feature),
h AS (SELECT feature, len(list_filter(e, lambda x: x <= v)) AS bin, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS c FROM l JOIN q USING (feature) GROUP BY 1, 2),
a AS (SELECT feature, bin, coalesce(r, 0) AS r, coalesce(c, 0) AS c, len(e) + 1 AS bins FROM (SELECT feature, e, unnest(range(len(e) + 1)) AS bin FROM q) LEFT JOIN h USING (feature, bin)),
psi AS (SELECT feature, sum(((c + 1) / (cn + bins) - (r + 1) / (rn + bins)) * ln(((c + 1) / (cn + bins)) / ((r + 1) / (rn + bins)))) AS psi FROM a JOIN t USING (feature) GROUP BY feature)"""

_KS = """f AS (SELECT DISTINCT feature, v, count(*) FILTER (side = 0) OVER w / count(*) FILTER (side = 0) OVER (PARTITION BY feature) AS fr, count(*) FILTER (side = 1) OVER w / count(*) FILTER (side = 1) OVER (PARTITION BY feature) AS fc,
count(*) FILTER (side = 0) OVER (PARTITION BY feature) AS n, count(*) FILTER (side = 1) OVER (PARTITION BY feature) AS m FROM l WINDOW w AS (PARTITION BY feature ORDER BY v)),
d AS (SELECT feature, max(abs(fr - fc)) AS d, sqrt(any_value(n) * any_value(m) / (any_value(n) + any_value(m))) * max(abs(fr - fc)) AS lam FROM f GROUP BY feature),
ks AS (SELECT feature, d AS ks_statistic, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, (SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) r(k)))) END AS ks_pvalue FROM d)"""

_PREDICTIONS = """p AS (SELECT *, prediction / (abs(prediction) + 10) AS probability FROM (
SELECT 'price_model' AS model_id, 1.0 + l_extendedprice * 0.001 + l_discount * -5.0 AS prediction FROM lineitem UNION ALL SELECT 'quantity_model', 0.0 + l_quantity * 0.5 + l_tax * 2.0 FROM lineitem UNION ALL SELECT 'flat_model', 3.0::DOUBLE FROM lineitem))"""

_SUMMARY = f"WITH {_long('1.5')}, {_PSI}, {_KS}, s AS (SELECT count(*) FILTER (psi > 0.2 OR ks_pvalue < 0.05) AS drifted, count(*) AS total FROM psi JOIN ks USING (feature))"


_SUMMARY_PRICE = f"WITH {_long('1.5')}, {_PSI}, {_KS}, s AS (SELECT count(*) FILTER (psi > 0.2 OR ks_pvalue < 0.05) AS drifted, count(*) AS total FROM psi JOIN ks USING (feature) WHERE feature = 'o_totalprice')"


def _change(c: str) -> str:
    return f"SELECT '{c}' AS feature, count(DISTINCT {c}) FILTER (side = 0) AS before, count(DISTINCT {c}) FILTER (side = 1) AS after FROM ({_SIDES})"


ORACLES: dict[str, str] = {
    "psi_exact": f"WITH {_long()}, {_PSI} SELECT feature, round(psi, 8) AS psi FROM psi",
    "psi_approximate": f"""WITH {_long('1.5')}, {_PSI.replace('quantile_cont', 'quantile_disc')}, p AS (SELECT feature, CASE WHEN r > 0 THEN r / rn ELSE 0.001 END AS p, CASE WHEN c > 0 THEN c / cn ELSE 0.001 END AS q FROM a JOIN t USING (feature)),
        i AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM p GROUP BY feature)
        SELECT feature, round(psi, 8) + 0.0 AS psi, CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.2 THEN 'moderate' WHEN psi < 0.5 THEN 'significant' ELSE 'severe' END AS band FROM i""",
    "psi_histogram": f"WITH {_long()}, {_PSI} SELECT feature, bin::BIGINT AS bin, r AS ref_n, c AS cur_n FROM a WHERE feature = 'o_totalprice'",
    "stored_sketch_drift": f"""WITH {_long('1.5')} SELECT feature, count(*) FILTER (side = 0) AS ref_n, count(*) FILTER (side = 1) AS cur_n, round(avg(v) FILTER (side = 0), 4) AS ref_mean, round(avg(v) FILTER (side = 1), 4) AS cur_mean,
        true AS psi_near, true AS ks_near FROM l GROUP BY feature""",
    "ks_drift": f"WITH {_long()}, {_KS} SELECT feature, round(ks_statistic, 8) AS ks_statistic, round(ks_pvalue, 8) AS ks_pvalue FROM ks",
    "wasserstein": f"WITH {_long()}, {_KS}, n AS (SELECT feature, abs(fr - fc) * (lead(v) OVER (PARTITION BY feature ORDER BY v) - v) AS part FROM f) SELECT feature, round(sum(part), 3) AS wasserstein FROM n GROUP BY feature",
    "mean_shift": f"WITH {_long()} SELECT feature, round(avg(v) FILTER (side = 0), 5) AS ref_mean, round(avg(v) FILTER (side = 1), 5) AS cur_mean, round(abs(avg(v) FILTER (side = 1) - avg(v) FILTER (side = 0)) / (stddev_pop(v) FILTER (side = 0) + 1e-8), 5) AS mean_shift FROM l GROUP BY feature",
    "drift_summary": f"{_SUMMARY} SELECT drifted, total, round(100.0 * drifted / total, 6) AS drift_pct FROM s",
    "drift_alerts": f"""{_SUMMARY_PRICE}, {_PREDICTIONS}, i AS (SELECT (count(DISTINCT o_totalprice) <= 1)::INT + 1 AS n FROM ({_SIDES}) WHERE side = 1)
        SELECT CASE WHEN drifted / total > 0.5 THEN 'P1' ELSE 'P2' END AS severity, 'feature_drift' AS type, printf('%.1f%% of features show drift', 100.0 * drifted / total) AS message FROM s WHERE drifted / total > 0.2
        UNION ALL SELECT 'P3', 'data_quality', n || ' features have data quality issues' FROM i UNION ALL SELECT 'P1', 'constant_predictions', 'model ' || model_id || ' predicts one value' FROM p GROUP BY model_id HAVING stddev_samp(prediction) < 1e-10""",
    "chi2_drift": f"""WITH k AS (SELECT o_orderpriority AS v, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS c FROM ({_SIDES}) GROUP BY 1), s AS (SELECT *, sum(r) OVER () AS rs, sum(c) OVER () AS cs, r + c AS t FROM k),
        e AS (SELECT *, t * rs / (rs + cs) AS er, t * cs / (rs + cs) AS ec FROM s)
        SELECT 'o_orderpriority' AS feature, round(sum((r - er) ** 2 / er + (c - ec) ** 2 / ec), 6) AS chi2, count(*) - 1 AS degrees FROM e""",
    "cardinality_change": f"SELECT feature, before, after, round(abs(after - before) / before, 6) AS change, abs(after - before) / before > 0.2 AS flagged FROM ({' UNION ALL '.join(map(_change, ('o_custkey', 'o_orderpriority', 'o_orderstatus')))})",
    "prediction_stats": f"""WITH {_PREDICTIONS} SELECT model_id, count(*) AS record_count, round(avg(prediction), 5) AS pred_mean, round(stddev_samp(prediction), 5) AS pred_std, round(min(prediction), 5) AS pred_min, round(max(prediction), 5) AS pred_max,
        round(quantile_cont(prediction, 0.1), 5) AS pred_p10, round(quantile_cont(prediction, 0.5), 5) AS pred_median, round(quantile_cont(prediction, 0.9), 5) AS pred_p90 FROM p GROUP BY 1""",
    "prediction_distribution": f"""WITH {_PREDICTIONS} SELECT model_id, count(*) AS total_records, round(avg(prediction), 5) AS pred_mean, round(stddev_samp(prediction), 5) AS pred_std, round(min(prediction), 5) AS pred_min, round(max(prediction), 5) AS pred_max,
        round(quantile_cont(prediction, 0.5), 5) AS pred_median, round(avg(probability), 5) AS prob_mean, round(quantile_cont(probability, 0.1), 5) AS prob_p10, round(quantile_cont(probability, 0.5), 5) AS prob_p50, round(quantile_cont(probability, 0.9), 5) AS prob_p90,
        0::BIGINT AS error_count, 0.0::DOUBLE AS error_rate, CASE WHEN stddev_samp(prediction) < 1e-10 THEN 'constant_predictions' WHEN min(prediction) = max(prediction) THEN 'single_value' END AS warning FROM p GROUP BY 1""",
    "inference_summary": f"""WITH {_PREDICTIONS} SELECT model_id, count(*) AS total_records, round(avg(prediction), 5) AS prediction_mean, round(stddev_samp(prediction), 5) AS prediction_std, round(min(prediction), 5) AS prediction_min, round(max(prediction), 5) AS prediction_max,
        round(avg(probability), 5) AS prob_mean, round(stddev_samp(probability), 5) AS prob_std, 0::BIGINT AS n_clusters, 0::BIGINT AS error_count FROM p GROUP BY 1""",
    "cluster_sizes": """WITH c AS (SELECT 'half_' || (vec_id % 2) AS model_id, label, count(*) AS n FROM embeddings GROUP BY 1, 2)
        SELECT model_id, count(*) AS n_clusters, string_agg(label || ':' || n, ',' ORDER BY label) AS cluster_sizes FROM c GROUP BY 1""",
    "monitoring_run": f"""{_SUMMARY}, {_PREDICTIONS}, m AS (SELECT model_id, count(*) AS n, coalesce(stddev_samp(prediction), 1) < 1e-10 AS flat, min(prediction) = max(prediction) AS one FROM p GROUP BY 1)
        SELECT (SELECT count(*) FILTER (NOT flat AND NOT one) FROM m) AS models_ok, (SELECT count(*) FILTER (flat OR one) FROM m) AS models_failed, (SELECT sum(n)::BIGINT FROM m) AS predictions, (SELECT count(*) FROM m) AS models_scored,
        (drifted / total > 0.5)::BIGINT + (SELECT count(*) FILTER (flat) FROM m) AS alerts_p1, (drifted / total > 0.2 AND drifted / total <= 0.5)::BIGINT AS alerts_p2, 0::BIGINT AS alerts_p3, drifted, total, round(100.0 * drifted / total, 6) AS drift_pct FROM s""",
}
