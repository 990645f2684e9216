"""Feature transforms, selection, expectations and profiles over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions.scalar import parsed_time
from marlpit.operators import checks, features
from marlpit.plans.base import CUT_DAY, LINE_NUMBERS, Query, orders_sides, rounded, table

LINE_KEY = ["l_orderkey", "l_linenumber"]


def numeric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.numeric_features(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], LINE_KEY)
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c.endswith("_log1p")})


def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.standard_scale(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], keep=LINE_KEY))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    chosen = features.interaction_columns(lines, LINE_NUMBERS, most=3)
    return rounded(features.interactions(lines, chosen, LINE_KEY))


def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = orders_sides(spark, sf_dir)
    columns = ["o_orderpriority", "o_orderstatus"]
    found = features.label_encode(after, features.fit_categories(before, columns), columns)
    return found.select("o_orderkey", *(F.col(f"{c}_encoded").cast("bigint").alias(f"{c}_encoded") for c in columns))


def label_encode_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    fitted = features.fit_categories(orders.filter("o_orderpriority <> '1-URGENT'"), ["o_orderpriority"])
    return features.label_encode(orders, fitted, ["o_orderpriority"]).select("o_orderkey", F.col("o_orderpriority_encoded").cast("bigint").alias("o_orderpriority_encoded"))


def frequency_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.frequency_encode(table(spark, sf_dir, "customer"), ["c_mktsegment"])
    return rounded(found.select("c_custkey", "c_mktsegment_freq"))


def temporal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.temporal_features(table(spark, sf_dir, "orders"), ["o_orderdate"], ["o_orderkey"]))


def variance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.top_variances(table(spark, sf_dir, "lineitem"), LINE_NUMBERS, 3))


def anova_f_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.top_scores(features.anova_scores(table(spark, sf_dir, "lineitem"), LINE_NUMBERS, "l_returnflag"), 3), 4)


def regression_f_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = features.regression_scores(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return rounded(features.top_scores(scores, 2), 3)


def feature_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transforms fitted on earlier orders and applied to later ones."""
    before, after = orders_sides(spark, sf_dir)
    roles = features.ColumnRoles(("o_totalprice",), ("o_orderpriority",), ("o_orderdate",), "o_orderkey")
    made = features.FeatureModel.fit(before, roles).transform(after)
    kept = ["o_orderkey", "o_totalprice_scaled", "o_totalprice_log1p", "o_orderpriority_encoded", "o_orderpriority_freq", "o_orderdate_month_sin", "o_orderdate_is_weekend"]
    return rounded(made.select(*kept).withColumn("o_orderpriority_encoded", F.col("o_orderpriority_encoded").cast("bigint")))


def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rules = [
        checks.not_empty(),
        checks.unique("o_orderkey"),
        checks.unique("o_custkey"),
        checks.not_null("o_orderkey"),
        checks.in_set("o_orderstatus", ["F", "O"]),
        checks.between("o_totalprice", 0, 100_000),
        checks.null_rate("o_orderdate"),
        checks.not_constant("o_totalprice"),
    ]
    return checks.evaluate(orders, rules, "orders")


def expectation_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = checks.evaluate(table(spark, sf_dir, "orders"), [checks.not_empty(), checks.unique("o_orderkey"), checks.in_set("o_orderstatus", ["F", "O"])], "orders")
    two = checks.evaluate(table(spark, sf_dir, "part"), [checks.not_empty(), checks.unique("p_partkey"), checks.not_null("p_name")], "part")
    return checks.tally(one.unionByName(two))


def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.profile(table(spark, sf_dir, "lineitem"), [*LINE_NUMBERS, "l_returnflag"])
    return rounded(found.withColumn("issues", F.array_join("issues", ";")), 5)


def range_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = orders_sides(spark, sf_dir)
    return rounded(checks.range_violations(before.filter("o_totalprice < 200000"), after, ["o_totalprice", "o_custkey"]))


def referential_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.orphans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").filter("c_nationkey < 20"), "o_custkey", "c_custkey")


def volume_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.volume(table(spark, sf_dir, "events"), "event_type", "ts", "day")
    return found.select("segment", F.date_format("period", "yyyy-MM-dd").alias("period"), "rows", F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"))


def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return rounded(features.lags(events, "user_id", ["ts", "event_id"], "value").drop("ts"))


def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return rounded(features.rolling(events, "user_id", "ts", "value").drop("ts"), 9)


def lags_of_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags over all events as one key, in blocks of a thousand rows."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value", F.lit(0).alias("one"))
    return rounded(features.lags(events, "one", ["ts", "event_id"], "value", most_rows=1000).drop("ts", "one"))


def rolling_of_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over all events as one key, in ranges of time; counts of values and of those above ten."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.lit("all").alias("one"), (F.col("value") > 10).cast("int").alias("high"))
    found = features.rolling(events, "one", "ts", "high", days=(1, 7), most_rows=1000)
    return rounded(found.drop("ts", "one"), 9)


def target_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.target_encode(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"), 4)


def woe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.weight_of_evidence(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F"))


def hash_bucket_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.hash_buckets(table(spark, sf_dir, "customer"), "c_name").groupBy(F.col("c_name_bucket").cast("bigint").alias("c_name_bucket")).agg(F.count("*").alias("n"))


def min_max_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.min_max_scale(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], ["p_partkey"]))


def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.robust_scale(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], ["p_partkey"]))


def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.quantile_bins(table(spark, sf_dir, "orders"), ["o_totalprice"], 10, ["o_orderkey"])
    return found.groupBy(F.col("o_totalprice_bin").cast("bigint").alias("bin")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least_key"))


def polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.polynomial(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], ["p_partkey"]), 4)


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.one_hot(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P"], ["o_orderkey"])


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.correlations(table(spark, sf_dir, "lineitem"), LINE_NUMBERS))


def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.mutual_information(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus"))


def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets of each document's terms, in order, with their counts, and the weights: their sum, the greatest, and how many are above 0."""
    found = features.term_weights(table(spark, sf_dir, "documents"), "text", "doc_id")
    total = F.aggregate("tfidf", F.lit(0.0), lambda a, w: a + w)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rounded(found.select("doc_id", joined("buckets").alias("buckets"), joined("counts").alias("counts"), total.alias("total"), F.coalesce(F.array_max("tfidf"), F.lit(0.0)).alias("greatest"), F.size(F.filter("tfidf", lambda w: w > 0)).cast("bigint").alias("terms")), 5)


def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order days from text, of which some isn't a day; counted by month, those that couldn't be read under none."""
    text = F.when(F.col("o_orderkey") % 10 == 3, F.lit("not a day")).when(F.col("o_orderkey") % 10 == 4, F.lit("")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("day"))
    day = parsed_time("day", orders.schema["day"].dataType)
    return orders.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def columns_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that are left of line items when constant ones go, and of two that move together the later one."""
    lines = table(spark, sf_dir, "lineitem").withColumns({"double": F.col("l_quantity") * 2 + 1, "same": F.lit(4.0), "sum": F.col("l_quantity") + F.col("l_linenumber")})
    given = ["l_linenumber", "l_quantity", "double", "same", "sum", "l_discount"]
    varying = features.drop_constant(lines, given, 1e-4)
    left = features.drop_correlated(lines, varying, 0.95)
    names = spark.createDataFrame([(c, k) for k, c in enumerate(left)], "feature string, place bigint")
    return rounded(names.join(features.variances(lines, left), "feature"), 4)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        numeric_features, standard_scale, interactions, label_encode, label_encode_unseen, frequency_encode, temporal_features, variance_topk, anova_f_topk, regression_f_topk, feature_pipeline,
        expectations, expectation_tally, quality_profile, range_violations, referential_integrity, volume_by_segment, lag_features, rolling_features, lags_of_one_key, rolling_of_one_key, parsed_times, columns_pruned, target_encode, woe_encode, hash_bucket_count,
        min_max_scale, robust_scale, quantile_bins, polynomial, one_hot, correlations, mutual_information, term_weights,
    )
}


def _unpivot(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, * FROM {source}" for c in columns)


def _numeric(c: str) -> str:
    return f"{c} AS {c}_orig, ({c} IS NULL)::INT::DOUBLE AS {c}_is_null, round(ln(1 + abs({c})), 6) AS {c}_log1p, {c} * {c} AS {c}_squared"


def _scaled(c: str) -> str:
    return f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}_scaled"


def _codes(c: str, fitted: str, applied: str) -> str:
    return f"""SELECT a.o_orderkey, coalesce(k.code, (SELECT code FROM k_{c} WHERE v = '__unknown__')) AS {c}_encoded FROM {applied} a LEFT JOIN k_{c} k ON a.{c} = k.v"""


def _code_table(c: str, fitted: str) -> str:
    return f"k_{c} AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {c} AS v FROM {fitted} UNION SELECT '__unknown__'))"


_DATES = """round(year(o_orderdate), 6)::DOUBLE AS o_orderdate_year, month(o_orderdate)::DOUBLE AS o_orderdate_month, (isodow(o_orderdate) - 1)::DOUBLE AS o_orderdate_dayofweek,
dayofyear(o_orderdate)::DOUBLE AS o_orderdate_dayofyear, round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS o_orderdate_month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS o_orderdate_month_cos,
round(sin(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) + 0.0 AS o_orderdate_dow_sin, round(cos(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) + 0.0 AS o_orderdate_dow_cos,
date_diff('day', DATE '2024-01-01', o_orderdate::DATE)::DOUBLE AS o_orderdate_days_since_ref, (isodow(o_orderdate) >= 6)::INT::DOUBLE AS o_orderdate_is_weekend"""

_BEFORE, _AFTER = (f"(SELECT * FROM orders WHERE o_orderdate {op} TIMESTAMP '{CUT_DAY}')" for op in ("<", ">="))


def _check(name: str, failures: str) -> str:
    return f"SELECT 'orders' AS dataset, '{name}' AS \"check\", {failures} = 0 AS passed, CAST({failures} AS BIGINT) AS failed_count FROM orders"


def _profile_numeric(c: str) -> str:
    return f"""SELECT '{c}' AS feature, avg(({c} IS NULL)::INT)::DOUBLE AS null_rate, count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) / count(*), 5) AS unique_rate, round(avg({c}), 5) AS mean,
round(stddev_samp({c}), 5) AS std, round(min({c}), 5) AS min, round(max({c}), 5) AS max, round(avg(({c} = 0)::INT), 5) AS zero_rate, count(*) FILTER (isinf({c})) AS inf_count, CASE WHEN count(DISTINCT {c}) <= 1 THEN 'constant_column' ELSE '' END AS issues, count(DISTINCT {c}) <= 1 AS has_issue FROM lineitem"""


ORACLES: dict[str, str] = {
    "numeric_features": f"SELECT l_orderkey, l_linenumber, {_numeric('l_quantity')}, {_numeric('l_extendedprice')} FROM lineitem",
    "standard_scale": f"SELECT l_orderkey, l_linenumber, {_scaled('l_quantity')}, {_scaled('l_extendedprice')}, {_scaled('l_discount')} FROM lineitem",
    "interactions": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_quantity, 6) AS interact_l_extendedprice_l_quantity, round(l_extendedprice * l_discount, 6) AS interact_l_extendedprice_l_discount, round(l_quantity * l_discount, 6) AS interact_l_quantity_l_discount FROM lineitem",
    "label_encode": f"WITH {_code_table('o_orderpriority', _BEFORE)}, {_code_table('o_orderstatus', _BEFORE)} SELECT * FROM ({_codes('o_orderpriority', _BEFORE, _AFTER)}) JOIN ({_codes('o_orderstatus', _BEFORE, _AFTER)}) USING (o_orderkey)",
    "label_encode_unseen": "WITH " + _code_table("o_orderpriority", "(SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT')") + " " + _codes("o_orderpriority", "", "orders"),
    "frequency_encode": "SELECT c_custkey, round(count(*) OVER (PARTITION BY c_mktsegment) / count(*) OVER (), 6) AS c_mktsegment_freq FROM customer",
    "temporal_features": f"SELECT o_orderkey, {_DATES} FROM orders",
    "variance_topk": f"SELECT feature, round(var_samp(v), 6) AS variance FROM ({_unpivot(LINE_NUMBERS, 'lineitem')}) GROUP BY feature ORDER BY var_samp(v) DESC, feature LIMIT 3",
    "anova_f_topk": f"""WITH c AS (SELECT feature, l_returnflag, count(*) AS n, avg(v) AS m, var_pop(v) AS p FROM ({_unpivot(LINE_NUMBERS, 'lineitem')}) GROUP BY ALL),
        w AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS m FROM c GROUP BY feature),
        f AS (SELECT feature, (sum(c.n * (c.m - w.m) ** 2) / (any_value(w.k) - 1)) / (sum(c.n * c.p) / (any_value(w.n) - any_value(w.k))) AS score FROM c JOIN w USING (feature) GROUP BY feature)
        SELECT feature, round(score, 4) AS score FROM f ORDER BY f.score DESC, feature LIMIT 3""",
    "regression_f_topk": f"""WITH r AS (SELECT feature, corr(v, l_extendedprice) ** 2 AS r2, count(*) AS n FROM ({_unpivot(['l_quantity', 'l_discount', 'l_tax'], 'lineitem')}) GROUP BY feature)
        SELECT feature, round(r2 / (1 - r2) * (n - 2), 3) AS score FROM r ORDER BY r2 / (1 - r2) * (n - 2) DESC, feature LIMIT 2""",
    "feature_pipeline": f"""WITH {_code_table('o_orderpriority', _BEFORE)}, s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d, count(*) AS n FROM {_BEFORE}), q AS (SELECT o_orderpriority AS v, count(*) AS c FROM {_BEFORE} GROUP BY 1)
        SELECT a.o_orderkey, round((a.o_totalprice - s.m) / s.d, 6) + 0.0 AS o_totalprice_scaled, round(ln(1 + abs(a.o_totalprice)), 6) AS o_totalprice_log1p, k.code AS o_orderpriority_encoded, round(q.c / s.n, 6) AS o_orderpriority_freq,
        round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS o_orderdate_month_sin, (isodow(o_orderdate) >= 6)::INT::DOUBLE AS o_orderdate_is_weekend
        FROM {_AFTER} a CROSS JOIN s LEFT JOIN k_o_orderpriority k ON a.o_orderpriority = k.v LEFT JOIN q ON a.o_orderpriority = q.v""",
    "expectations": " UNION ALL ".join(
        _check(n, f)
        for n, f in (
            ("not_empty", "(CASE WHEN count(*) > 0 THEN 0 ELSE 1 END)"),
            ("unique(o_orderkey)", "(count(*) - count(DISTINCT o_orderkey))"),
            ("unique(o_custkey)", "(count(*) - count(DISTINCT o_custkey))"),
            ("not_null(o_orderkey)", "count(*) FILTER (o_orderkey IS NULL)"),
            ("in_set(o_orderstatus)", "count(*) FILTER (o_orderstatus NOT IN ('F', 'O'))"),
            ("between(o_totalprice)", "count(*) FILTER (o_totalprice < 0 OR o_totalprice > 100000)"),
            ("null_rate(o_orderdate)", "(CASE WHEN avg((o_orderdate IS NULL)::INT) > 0.1 THEN 1 ELSE 0 END)"),
            ("not_constant(o_totalprice)", "(CASE WHEN min(o_totalprice) < max(o_totalprice) THEN 0 ELSE 1 END)"),
        )
    ),
    "expectation_tally": """SELECT 'orders' AS dataset, 2 + (count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) = 0)::BIGINT AS passed, (count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) > 0)::BIGINT AS failed FROM orders
        UNION ALL SELECT 'part', (count(*) > 0)::BIGINT + (count(*) = count(DISTINCT p_partkey))::BIGINT + (count(*) = count(p_name))::BIGINT, (count(*) = 0)::BIGINT + (count(*) <> count(DISTINCT p_partkey))::BIGINT + (count(*) <> count(p_name))::BIGINT FROM part""",
    "quality_profile": " UNION ALL ".join(map(_profile_numeric, LINE_NUMBERS)) + """ UNION ALL SELECT 'l_returnflag', avg((l_returnflag IS NULL)::INT)::DOUBLE, count(DISTINCT l_returnflag), round(count(DISTINCT l_returnflag) / count(*), 5), NULL, NULL, NULL, NULL, NULL, NULL, '', false FROM lineitem""",
    "range_violations": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER ({c} < r.a OR {c} > r.b) AS violations, round(count(*) FILTER ({c} < r.a OR {c} > r.b) / count(*), 6) AS rate FROM {_AFTER} o CROSS JOIN (SELECT min({c}) AS a, max({c}) AS b FROM {_BEFORE} WHERE o_totalprice < 200000) r"
        for c in ("o_totalprice", "o_custkey")
    ),
    "referential_integrity": "SELECT count(*) AS rows, count(*) FILTER (c.c_custkey IS NULL) AS orphans FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) c ON o_custkey = c_custkey",
    "volume_by_segment": "SELECT event_type AS segment, strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, count(*) AS rows, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events GROUP BY 1, 2",
    "lag_features": "SELECT event_id, user_id, round(value, 6) AS value, " + ", ".join(f"round(lag(value, {n}) OVER w, 6) AS value_lag_{n}" for n in (1, 7, 30)) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "hash_bucket_count": "SELECT ('0x' || substr(md5(c_name), 1, 8))::BIGINT % 100 AS c_name_bucket, count(*) AS n FROM customer GROUP BY 1",
    "rolling_features": "SELECT event_id, user_id, round(value, 9) AS value, "
    + ", ".join(f"round(avg(value) OVER w{n}, 9) AS value_mean_{n}d, count(value) OVER w{n} AS value_count_{n}d" for n in (7, 30, 90))
    + " FROM events WINDOW "
    + ", ".join(f"w{n} AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND CURRENT ROW)" for n in (7, 30, 90)),
    "term_weights": r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '\W+')) AS word FROM documents),
        c AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 262144 AS b, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL),
        i AS (SELECT b, ln(((SELECT count(DISTINCT doc_id) FROM documents) + 1) / (count(*) + 1)) AS idf FROM c GROUP BY b),
        t AS (SELECT doc_id, string_agg(b::VARCHAR, ',' ORDER BY b) AS buckets, string_agg(n::VARCHAR, ',' ORDER BY b) AS counts, sum(n * idf) AS total, max(n * idf) AS greatest, count(*) FILTER (n * idf > 0) AS terms FROM c JOIN i USING (b) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(buckets, '') AS buckets, coalesce(counts, '') AS counts, round(coalesce(total, 0), 5) + 0.0 AS total, round(coalesce(greatest, 0), 5) + 0.0 AS greatest, coalesce(terms, 0) AS terms FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN t USING (doc_id)""",
    "parsed_times": """SELECT CASE WHEN o_orderkey % 10 NOT IN (3, 4) THEN strftime(o_orderdate, '%Y-%m') END AS month, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1""",
    "columns_pruned": """WITH s AS (SELECT var_samp(l_linenumber) AS v0, var_samp(l_quantity) AS v1, var_samp(l_quantity * 2 + 1) AS v2, var_samp(l_quantity + l_linenumber) AS v3, var_samp(l_discount) AS v4, corr(l_linenumber, l_quantity) AS c01, corr(l_quantity, l_quantity + l_linenumber) AS c13 FROM lineitem),
        k AS (SELECT 'l_linenumber' AS feature, v0 AS variance, true AS stays FROM s UNION ALL SELECT 'l_quantity', v1, abs(c01) <= 0.95 FROM s UNION ALL SELECT 'double', v2, false FROM s UNION ALL SELECT 'sum', v3, abs(c13) <= 0.95 FROM s UNION ALL SELECT 'l_discount', v4, v4 > 1e-4 FROM s)
        SELECT feature, row_number() OVER (ORDER BY CASE feature WHEN 'l_linenumber' THEN 0 WHEN 'l_quantity' THEN 1 WHEN 'sum' THEN 3 ELSE 4 END) - 1 AS place, round(variance, 4) AS variance FROM k WHERE stays""",
    "lags_of_one_key": "SELECT event_id, round(value, 6) AS value, " + ", ".join(f"round(lag(value, {n}) OVER w, 6) AS value_lag_{n}" for n in (1, 7, 30)) + " FROM events WINDOW w AS (ORDER BY ts, event_id)",
    "rolling_of_one_key": "SELECT event_id, (value > 10)::INT AS high, "
    + ", ".join(f"round(avg((value > 10)::INT) OVER w{n}, 9) AS high_mean_{n}d, count((value > 10)::INT) OVER w{n} AS high_count_{n}d" for n in (1, 7))
    + " FROM events WINDOW "
    + ", ".join(f"w{n} AS (ORDER BY ts RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND CURRENT ROW)" for n in (1, 7)),
    "target_encode": "SELECT o_orderpriority AS value, count(*) AS n, round(avg(o_totalprice), 4) AS target_mean FROM orders GROUP BY 1",
    "woe_encode": """WITH c AS (SELECT o_orderpriority AS value, count(*) FILTER (o_orderstatus = 'F') AS events, count(*) FILTER (o_orderstatus <> 'F') AS others FROM orders GROUP BY 1),
        s AS (SELECT *, (events + 0.5) / (sum(events) OVER () + 0.5) AS g, (others + 0.5) / (sum(others) OVER () + 0.5) AS b FROM c)
        SELECT value, events, others, round(ln(g / b), 6) + 0.0 AS woe, round((g - b) * ln(g / b), 6) + 0.0 AS iv FROM s""",
    "min_max_scale": "SELECT p_partkey, " + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}_minmax" for c in ("p_size", "p_retailprice")) + " FROM part",
    "robust_scale": "WITH q AS (SELECT "
    + ", ".join(f"quantile_cont({c}, 0.25) AS {c}1, quantile_cont({c}, 0.5) AS {c}2, quantile_cont({c}, 0.75) AS {c}3" for c in ("p_size", "p_retailprice"))
    + " FROM part) SELECT p_partkey, "
    + ", ".join(f"round(({c} - {c}2) / ({c}3 - {c}1), 6) + 0.0 AS {c}_robust" for c in ("p_size", "p_retailprice"))
    + " FROM part CROSS JOIN q",
    "quantile_bins": """WITH q AS (SELECT quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM orders)
        SELECT len(list_filter(e, lambda x: x <= o_totalprice))::BIGINT AS bin, count(*) AS n, min(o_orderkey) AS least_key FROM orders CROSS JOIN q GROUP BY 1""",
    "polynomial": "SELECT p_partkey, p_size::DOUBLE AS p_size, round(p_retailprice, 4) AS p_retailprice, (p_size * p_size)::DOUBLE AS p_size_x_p_size, round(p_size * p_retailprice, 4) AS p_size_x_p_retailprice, round(p_retailprice * p_retailprice, 4) AS p_retailprice_x_p_retailprice FROM part",
    "one_hot": "SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{s}')::INT::DOUBLE AS o_orderstatus_is_{s}" for s in "FOP") + " FROM orders",
    "correlations": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS correlation FROM lineitem" for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1 :]),
    "mutual_information": """WITH q AS (SELECT quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM orders),
        j AS (SELECT len(list_filter(e, lambda x: x <= o_totalprice)) AS x, o_orderstatus AS y, count(*) AS n FROM orders CROSS JOIN q GROUP BY 1, 2),
        p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY x) / sum(n) OVER () AS px, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS py FROM j)
        SELECT 'o_totalprice' AS feature, round(sum(p * ln(p / (px * py))), 6) + 0.0 AS mutual_information FROM p""",
}
