"""Feature store, joins, personal data, erasure, audit and dependency queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.operators import governance, lineage, store
from marlpit.plans.base import Query, rounded, table
from marlpit.sources import tables
from marlpit.sources.scratch import new_folder
from marlpit.streaming import ingest
from marlpit.streaming.keyed_table import KeyedTable, upsert_stream


# ---------------------------------------------------------------- joins and store


def training_set_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("record_id"), F.lit("order").alias("c_name"))
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "record_id").filter("c_acctbal > 0")
    return rounded(store.left_join(orders, customers.select("record_id", "c_name", "c_acctbal"), "record_id", "customer"))


def training_set_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of two registered tables and an unknown one, by key."""
    held = store.FeatureStore(spark, new_folder(spark, "store"))
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "record_id")
    held.register("balance", customers.select("record_id", "c_acctbal"), "v1", keys=["record_id"])
    held.register("segment", customers.filter("c_nationkey < 12").select("record_id", "c_mktsegment", (F.col("c_acctbal") / 2).alias("c_acctbal")), "v1")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("record_id"))
    return rounded(held.training_set(orders, ["balance", "nowhere", "segment"]).data)


def asof_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last error of the user before each purchase."""
    events = table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    errors = events.filter("event_type = 'error'").select("user_id", F.col("ts").alias("error_ts"), F.col("value").alias("error_value"))
    found = store.as_of_join(bought, errors, "user_id", "ts", "error_ts", ["error_value"])
    return rounded(found.select("event_id", "user_id", "error_value", F.date_format("error_ts_used", "yyyy-MM-dd HH:mm:ss").alias("error_ts")))


def asof_recent_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`asof_features`, but nothing older than a day."""
    events = table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    errors = events.filter("event_type = 'error'").select("user_id", F.col("ts").alias("error_ts"), F.col("value").alias("error_value"))
    return rounded(store.as_of_join(bought, errors, "user_id", "ts", "error_ts", ["error_value"], F.expr("interval 1 day")).select("event_id", "error_value"))


def features_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return rounded(tables.by_keys(table(spark, sf_dir, "orders"), "o_custkey", wanted).select("o_orderkey", "o_custkey", "o_totalprice"))


def features_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered table up to a day, read from its second version."""
    held = store.FeatureStore(spark, new_folder(spark, "store"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    held.register("events", events.limit(1), "v1")
    held.register("events", events, "v2", keys=["user_id"])
    return rounded(held.read("events", time="ts", as_of="2024-01-10 00:00:00").select("event_id", "user_id", "value"))


def feature_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog says of two tables, one in two versions."""
    held = store.FeatureStore(spark, new_folder(spark, "store"))
    customers = table(spark, sf_dir, "customer")
    held.register("customer", customers.limit(3), "v1")
    held.register("customer", customers, "v2")
    held.register("nation", table(spark, sf_dir, "nation"), "v1")
    return held.tables().select("name", "version", "row_count", F.col("column_count").cast("bigint").alias("column_count"), F.array_join("columns", ",").alias("columns"))


def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.fingerprint(table(spark, sf_dir, "orders"))


def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    return rounded(store.latest(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts"))


def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newer prices of a third of the parts laid over the old ones."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").withColumn("version", F.lit(1))
    newer = parts.filter("p_partkey % 3 = 0").select("p_partkey", (F.col("p_retailprice") + 1).alias("p_retailprice"), F.lit(2).alias("version"))
    return rounded(store.upsert(parts, newer, ["p_partkey"], ["version"]).withColumn("version", F.col("version").cast("bigint")), 4)


# ---------------------------------------------------------------- files and streams


def _events(sf_dir: str) -> str:
    """As a pattern: a stream takes a folder or a pattern, and the table may be one file."""
    return f"{sf_dir}/event[s].parquet"


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a file stream with ingestion metadata, appended and read back."""
    out = new_folder(spark, "stream")
    stream = ingest.with_ingestion_metadata(ingest.file_stream(spark, _events(sf_dir)), "2024-02-01")
    ingest.append_available(stream, f"{out}/bronze", f"{out}/checkpoint")
    bronze = spark.read.parquet(f"{out}/bronze")
    good = F.col("_source_file").endswith(".parquet") & F.col("_ingestion_timestamp").isNotNull()
    return rounded(bronze.filter(good).select("event_id", "user_id", "event_type", "value", F.date_format("_run_date", "yyyy-MM-dd").alias("run_date")))


def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a stream that drops repeated ids behind a watermark."""
    out = new_folder(spark, "stream")
    stream = ingest.deduplicated(ingest.file_stream(spark, _events(sf_dir)).drop("_metadata"), ["event_id"], "ts", "60 days")
    ingest.append_available(stream, f"{out}/silver", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/silver").groupBy("event_type").agg(F.count("*").alias("n"))


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type, merged batch by batch."""
    out = new_folder(spark, "stream")
    stream = ingest.file_stream(spark, _events(sf_dir)).select("event_id", "user_id", "event_type", "ts", "value")
    held = KeyedTable(spark, f"{out}/silver", ["user_id", "event_type"], ["ts", "event_id"], buckets=8)
    upsert_stream(stream, held, f"{out}/checkpoint")
    return rounded(held.read().drop("ts"))


def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written by status, one status written again: its rows are replaced, not doubled."""
    out = new_folder(spark, "partitions")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    tables.replace_partitions(orders, out, ["o_orderstatus"])
    tables.replace_partitions(orders.filter("o_orderstatus = 'F'"), out, ["o_orderstatus"])
    return rounded(spark.read.parquet(out).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "csv")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    tables.write_files(parts, out, "csv")
    return tables.read_files(spark, out, "csv", parts.schema).select("p_partkey", "p_name", F.col("p_size").cast("bigint").alias("p_size"))


# ---------------------------------------------------------------- personal data and erasure


def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = governance.pii_rates(table(spark, sf_dir, "documents"), ["text", "source"])
    pages = governance.pii_rates(table(spark, sf_dir, "pages"), ["html"])
    return rounded(docs.unionByName(pages))


def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with e-mails, cards and telephone numbers hidden."""
    return governance.mask_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), {"text": ["email", "credit_card", "phone"]})


def pii_mask_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with numbers hidden, category after category; the source, being of another kind, is redacted."""
    return governance.mask_pii(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), {"text": ["ssn", "credit_card", "phone"], "source": ["address"]})


def compliance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = governance.compliance_report(table(spark, sf_dir, "customer"), "customer")
    return rounded(found.withColumn("categories", F.array_join("categories", ",")))


def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers as a dataset, with the last operations of the events' log."""
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("entry_id"), F.col("event_type").alias("operation"))
    return rounded(governance.dataset_summary(table(spark, sf_dir, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), "customer", audit=log))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_nationkey = 7").select("c_custkey")


def erasure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = {"orders": (table(spark, sf_dir, "orders"), "o_custkey"), "customer": (table(spark, sf_dir, "customer"), "c_custkey")}
    return governance.erasure_counts(held, _subjects(spark, sf_dir), "c_custkey")


def erasure_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, and what is made from the affected tables."""
    held = {"orders": (table(spark, sf_dir, "orders"), "o_custkey"), "customer": (table(spark, sf_dir, "customer"), "c_custkey")}
    links = spark.createDataFrame([("gold", "orders"), ("scores", "gold"), ("gold", "customer")], "child string, parent string")
    return governance.erasure_plan(held, _subjects(spark, sf_dir), "c_custkey", links).withColumn("cascade", F.array_join("cascade", ","))


def erasure_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = governance.erase(table(spark, sf_dir, "orders"), "o_custkey", _subjects(spark, sf_dir), "c_custkey")
    return rounded(left.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


# ---------------------------------------------------------------- audit


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit entries."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("entry_id"), F.col("event_type").alias("operation"), F.col("user_id").cast("string").alias("actor"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("ts").alias("timestamp")
    )


def audit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.audit_filter(_audit(spark, sf_dir), operation="purchase", actor="5", status="success").select("entry_id", "operation", "actor")


def audit_by_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.count_by_operation(_audit(spark, sf_dir))


def audit_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.recent(_audit(spark, sf_dir), 50).select("entry_id", "operation", "actor")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries appended as JSON lines and read back."""
    log = governance.AuditLog(spark, new_folder(spark, "audit"))
    log.append(_audit(spark, sf_dir).withColumn("entry_id", F.col("entry_id").cast("string")))
    return log.entries().groupBy("operation", "status").agg(F.count("*").alias("n"), F.count_distinct("actor").alias("actors"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of two tables, the second read back by its id."""
    held = governance.Snapshots(spark, new_folder(spark, "snapshots"))
    held.create(table(spark, sf_dir, "nation"))
    second = held.create(table(spark, sf_dir, "orders"), table_versions={"orders": "1"})
    found = held.all().filter(F.col("snapshot_id") == second["snapshot_id"])
    return found.select("num_rows", F.col("num_features").cast("bigint").alias("num_features"), F.length("snapshot_id").cast("bigint").alias("id_length"), F.length("dataset_hash").cast("bigint").alias("hash_length"))


# ---------------------------------------------------------------- dependencies


def _part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a tree: the parent of k is half of k."""
    return table(spark, sf_dir, "part").filter("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))


def upstream_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.closure(_part_edges(spark, sf_dir))


def downstream_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.downstream(_part_edges(spark, sf_dir), 5)


def dependency_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.layers(_part_edges(spark, sf_dir)).withColumn("layer", F.col("layer").cast("bigint"))


def edge_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts and all edges of their tree, where every 7th child has lost its edge, every 11th part is missing and
    every 101st is in a circle with its first child."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    edges = _part_edges(spark, sf_dir).filter("child % 7 <> 0")
    first = parts.select((F.col("p_partkey") * 2).alias("p_partkey")).join(parts, "p_partkey", "left_semi")
    circles = first.select(F.expr("p_partkey div 2").alias("child"), F.col("p_partkey").alias("parent")).filter("child % 101 = 2")
    return lineage.edge_checks(edges.unionByName(circles), parts.filter("p_partkey % 11 <> 3"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        training_set_left, training_set_multi, asof_features, asof_recent_features, features_by_key, features_as_of, feature_tables, dataset_fingerprint, dedup_latest, upsert_rows,
        stream_ingest, stream_deduplicated, stream_upsert, partition_overwrite, csv_round_trip, pii_scan, pii_mask, pii_mask_numbers, compliance_report, dataset_summary, erasure_counts, erasure_plan, erasure_apply,
        audit_filter, audit_by_operation, audit_recent, audit_log, snapshots, upstream_closure, downstream_items, dependency_layers, edge_checks,
    )
} | {"edge_checks_whole": edge_checks}


def _hits(column: str, source: str, category: str) -> str:
    test = " OR ".join(f"regexp_matches({column}, '{p}')" for p in governance.PATTERNS[category])
    return f"SELECT '{column}' AS \"column\", '{category}' AS category, count(*) FILTER ({test}) AS hits, count({column}) AS present, round(coalesce(count(*) FILTER ({test}) / nullif(count({column}), 0), 0), 6) AS rate FROM {source}"


def _reported(column: str, dtype: str, pii: str) -> str:
    return f"SELECT 'customer' AS dataset, '{column}' AS \"column\", '{dtype}' AS dtype, avg(({column} IS NULL)::INT)::DOUBLE AS null_rate, round(count(DISTINCT {column}) / count(*), 6) AS unique_ratio, {bool(pii)} AS is_pii, '{pii}' AS categories, 'pii' AS classification FROM customer"


_TREE = """e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1), c AS (SELECT child AS item, parent AS ancestor FROM e UNION SELECT c.item, e.parent FROM c JOIN e ON e.child = c.ancestor)"""
_LAST = "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"
_SUBJECTS = "(SELECT c_custkey FROM customer WHERE c_nationkey = 7)"

_EDGE_CHECKS = """WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1 AND p_partkey % 7 <> 0
        UNION ALL SELECT k.p_partkey, 2 * k.p_partkey FROM part k JOIN part v ON v.p_partkey = 2 * k.p_partkey WHERE k.p_partkey % 101 = 2), i AS (SELECT p_partkey AS item FROM part WHERE p_partkey % 11 <> 3),
        c AS (SELECT child AS item, parent AS ancestor FROM e UNION SELECT c.item, e.parent FROM c JOIN e ON e.child = c.ancestor)
        SELECT DISTINCT 'unknown_parent' AS "check", parent AS item FROM e WHERE parent NOT IN (SELECT item FROM i)
        UNION ALL SELECT 'orphan', item FROM i WHERE item NOT IN (SELECT child FROM e) AND item NOT IN (SELECT parent FROM e)
        UNION ALL SELECT DISTINCT 'cycle', item FROM c WHERE item = ancestor OR ancestor IN (SELECT item FROM c WHERE item = ancestor)"""

ORACLES: dict[str, str] = {
    "training_set_left": "SELECT o_custkey AS record_id, o_orderkey, 'order' AS c_name, c.c_name AS c_name_customer, round(c.c_acctbal, 6) AS c_acctbal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey",
    "training_set_multi": """SELECT o_custkey AS record_id, o_orderkey, round(a.c_acctbal, 6) AS c_acctbal, b.c_mktsegment, round(b.c_acctbal / 2, 6) AS c_acctbal_segment FROM orders LEFT JOIN customer a ON o_custkey = a.c_custkey
        LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 12) b ON o_custkey = b.c_custkey""",
    "asof_features": """SELECT p.event_id, p.user_id, round(e.value, 6) AS error_value, strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS error_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e ON p.user_id = e.user_id AND p.ts >= e.ts""",
    "asof_recent_features": """SELECT p.event_id, CASE WHEN e.ts >= p.ts - INTERVAL 1 DAY THEN round(e.value, 6) END AS error_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e ON p.user_id = e.user_id AND p.ts >= e.ts""",
    "features_by_key": "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "features_as_of": "SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00'",
    "feature_tables": """SELECT 'customer' AS name, 'v2' AS version, count(*) AS row_count, 5::BIGINT AS column_count, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns FROM customer
        UNION ALL SELECT 'nation', 'v1', count(*), 3::BIGINT, 'n_nationkey,n_name,n_regionkey' FROM nation""",
    "dedup_latest": _LAST,
    "upsert_rows": "SELECT p_partkey, round(p_retailprice + (p_partkey % 3 = 0)::INT, 4) AS p_retailprice, 1 + (p_partkey % 3 = 0)::BIGINT AS version FROM part",
    "stream_ingest": "SELECT event_id, user_id, event_type, round(value, 6) AS value, '2024-02-01' AS run_date FROM events",
    "stream_deduplicated": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "stream_upsert": _LAST,
    "partition_overwrite": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "csv_round_trip": "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part",
    "pii_scan": " UNION ALL ".join(_hits(c, s, k) for c, s in (("text", "documents"), ("source", "documents"), ("html", "pages")) for k in governance.PATTERNS),
    "pii_mask_numbers": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\d{3}-\d{2}-(\d{4})', '***-**-\1', 'g'), '\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?(\d{4})', '****-****-****-\1', 'g'), '(\d{3})[-.\s]?\d{3}[-.\s]?(\d{4})', '\1-***-\2', 'g') AS text, '[REDACTED]' AS source FROM documents""",
    "dataset_summary": """SELECT 'customer' AS dataset, count(*) AS rows, 5 AS columns, round(count(*) FILTER (c_acctbal <= 0) / (5 * count(*)), 6) + 0.0 AS missing_rate, count(DISTINCT c_custkey) AS different_rows, 'c_name' AS pii_columns, 'pii' AS classification,
        (SELECT string_agg(event_type, ',' ORDER BY event_id DESC) FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 10)) AS last_operations FROM customer""",
    "pii_mask": r"""WITH p AS (SELECT doc_id, text, string_split(text, '@') AS parts FROM documents),
        m AS (SELECT doc_id, array_to_string(list_transform(parts, lambda x, i: CASE WHEN i = len(parts) THEN x ELSE left(x, length(x) - length(regexp_extract(x, '[a-zA-Z0-9._%+-]*$'))) || repeat('*', length(regexp_extract(x, '[a-zA-Z0-9._%+-]*$'))) END), '@') AS text FROM p)
        SELECT doc_id, regexp_replace(regexp_replace(text, '\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?(\d{4})', '****-****-****-\1', 'g'), '(\d{3})[-.\s]?\d{3}[-.\s]?(\d{4})', '\1-***-\2', 'g') AS text FROM m""",
    "compliance_report": " UNION ALL ".join(_reported(c, t, p) for c, t, p in (("c_custkey", "bigint", ""), ("c_name", "string", "name"), ("c_nationkey", "int", ""), ("c_acctbal", "double", ""), ("c_mktsegment", "string", ""))),
    "erasure_counts": f"SELECT 'orders' AS \"table\", 'o_custkey' AS key_column, count(*) AS affected FROM orders WHERE o_custkey IN {_SUBJECTS} UNION ALL SELECT 'customer', 'c_custkey', count(*) FROM customer WHERE c_nationkey = 7",
    "erasure_plan": f"SELECT 'orders' AS \"table\", 'o_custkey' AS key_column, count(*) AS affected, 'gold,scores' AS cascade FROM orders WHERE o_custkey IN {_SUBJECTS} UNION ALL SELECT 'customer', 'c_custkey', count(*), 'gold,scores' FROM customer WHERE c_nationkey = 7",
    "erasure_apply": f"SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey NOT IN {_SUBJECTS} GROUP BY 1",
    "audit_filter": "SELECT event_id AS entry_id, event_type AS operation, user_id::VARCHAR AS actor FROM events WHERE event_type = 'purchase' AND user_id = 5",
    "audit_by_operation": "SELECT event_type AS operation, count(*) AS n FROM events GROUP BY 1",
    "audit_recent": "SELECT event_id AS entry_id, event_type AS operation, user_id::VARCHAR AS actor FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "audit_log": "SELECT event_type AS operation, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, count(*) AS n, count(DISTINCT user_id) AS actors FROM events GROUP BY 1, 2",
    "snapshots": "SELECT count(*) AS num_rows, 6::BIGINT AS num_features, 17::BIGINT AS id_length, 16::BIGINT AS hash_length FROM orders",
    "upstream_closure": f"WITH RECURSIVE {_TREE} SELECT item, ancestor FROM c",
    "downstream_items": f"WITH RECURSIVE {_TREE} SELECT item FROM c WHERE ancestor = 5",
    "dependency_layers": f"WITH RECURSIVE {_TREE} SELECT item, count(*) AS layer FROM c GROUP BY 1 UNION ALL SELECT DISTINCT parent, 0::BIGINT FROM e WHERE parent NOT IN (SELECT child FROM e)",
    "edge_checks": _EDGE_CHECKS,
    "edge_checks_whole": _EDGE_CHECKS,
}
