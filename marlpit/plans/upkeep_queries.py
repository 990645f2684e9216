"""Tables that are laid out, kept up to date and evolve: each query writes the supplied tables in parts and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.operators import layout
from marlpit.operators.incremental import IncrementalFeatures
from marlpit.plans.base import Query, rounded, table
from marlpit.sources.scratch import new_folder
from marlpit.streaming import evolving, ingest
from marlpit.streaming.keyed_table import KeyedTable, upsert_stream


def zordered_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items laid out by part and supplier: what a narrow range of either key holds, read from under a quarter of the files."""
    out = new_folder(spark, "zordered")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    layout.write_zordered(lines, out, ["l_partkey", "l_suppkey"], files=256)
    parts = []
    for key, last in (("l_partkey", "p_partkey"), ("l_suppkey", "s_suppkey")):
        most = table(spark, sf_dir, "part" if key == "l_partkey" else "supplier").agg(F.max(last)).first()[0]
        wanted = {key: (most // 2, most // 2 + most // 100)}
        few = layout.share_read(spark, out, wanted) < 0.25
        found = layout.read_zordered(spark, out, wanted).groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
        parts.append(found.select(F.lit(key).alias("key"), "value", "n", "quantity", F.lit(few).alias("few_files")))
    return parts[0].unionByName(parts[1])


def _event_changes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Events as four batches of changes that come out of order: new rows, changed ones, older changes that come late, deletions, and rows deleted before."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce("value", F.lit(0.0)).alias("value"))
    put = lambda rows, seq, value="value", gone=False: rows.select("user_id", "event_id", F.expr(value).alias("value"), F.lit(seq).alias("seq"), F.lit(gone).alias("gone"))
    one = put(events.filter("event_id % 3 = 0"), 1)
    two = put(events.filter("event_id % 3 = 1"), 1).unionByName(put(events.filter("event_id % 30 = 0"), 3, "value + 10"))
    late = put(events.filter("event_id % 60 = 0"), 2, "value - 5")
    three = put(events.filter("event_id % 3 = 2"), 1).unionByName(late).unionByName(put(events.filter("event_id % 9 = 0 OR user_id % 50 = 7"), 4, gone=True))
    four = put(events.filter("event_id % 18 = 0"), 2).unionByName(put(events.filter("event_id % 90 = 0"), 5, "value + 1"))
    return [one, two, three, four]


def incremental_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each user after four batches of changes, one of them applied twice."""
    held = IncrementalFeatures(spark, new_folder(spark, "incremental"), "user_id", "event_id", "value", "seq", buckets=8)
    for number, changes in enumerate(_event_changes(spark, sf_dir)):
        held.apply(changes, number, "gone")
        if number == 2:
            held.apply(changes, number, "gone")
            held.compact(2)
    return rounded(held.features().drop("distinct_values"), 9)


def merged_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that are left after the same batches, from a table of change logs that is compacted in between."""
    held = KeyedTable(spark, new_folder(spark, "keyed"), ["event_id"], ["seq"], buckets=8)
    for number, changes in enumerate(_event_changes(spark, sf_dir)):
        held.write(changes, number, "gone")
        held.compact(2)
    return rounded(held.read().select("event_id", "user_id", "value", F.col("seq").cast("bigint").alias("seq")), 6)


def stream_merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type, from a stream that comes in three files and writes change logs alone."""
    out = new_folder(spark, "stream")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for rest in (2, 0, 1):
        events.filter(F.col("event_id") % 3 == rest).coalesce(1).write.mode("append").parquet(f"{out}/landing")
    held = KeyedTable(spark, f"{out}/silver", ["user_id", "event_type"], ["ts", "event_id"], buckets=8)
    stream = ingest.file_stream(spark, f"{out}/landing", files_per_trigger=1).drop("_metadata", "props")
    upsert_stream(stream, held, f"{out}/checkpoint", compact_over=2)
    return rounded(held.read().drop("ts"))


def stream_new_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines in three files: the second brings a column, the third values of a wrong type; through one checkpoint, no row lost."""
    out = new_folder(spark, "evolving")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.coalesce("value", F.lit(0.0)).alias("value"))
    wrong = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    for rest, rows in enumerate((events.drop("event_type"), events, events.withColumn("value", wrong))):
        rows.filter(F.col("event_id") % 3 == rest).coalesce(1).write.mode("append").json(f"{out}/landing")
    restarts = evolving.append_evolving(spark, f"{out}/landing", f"{out}/bronze", f"{out}/checkpoint", files_per_trigger=1)
    found = evolving.read_evolved(spark, f"{out}/bronze").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.sum("value").alias("total"), F.count("_rescued").alias("rescued"))
    return rounded(found.withColumn("restarts", F.lit(restarts).cast("bigint")), 4)


QUERIES: dict[str, Query] = {f.__name__: f for f in (zordered_reads, stream_new_columns, incremental_features, merged_on_read, stream_merge_on_read)}


def _narrow(key: str, parent: str, last: str) -> str:
    return f"""SELECT '{key}' AS key, {key} AS value, count(*) AS n, sum(l_quantity) AS quantity, true AS few_files FROM lineitem, (SELECT max({last}) AS m FROM {parent})
        WHERE {key} BETWEEN m // 2 AND m // 2 + m // 100 GROUP BY {key}"""


#: Events after all changes: the last change of each by its number, unless it is a deletion.
_LEFT = """e AS (SELECT user_id, event_id, coalesce(value, 0) AS value FROM events),
    c AS (
        SELECT *, 1 AS seq, false AS gone FROM e
        UNION ALL SELECT user_id, event_id, value + 10, 3, false FROM e WHERE event_id % 30 = 0
        UNION ALL SELECT user_id, event_id, value - 5, 2, false FROM e WHERE event_id % 60 = 0
        UNION ALL SELECT user_id, event_id, value, 4, true FROM e WHERE event_id % 9 = 0 OR user_id % 50 = 7
        UNION ALL SELECT user_id, event_id, value, 2, false FROM e WHERE event_id % 18 = 0
        UNION ALL SELECT user_id, event_id, value + 1, 5, false FROM e WHERE event_id % 90 = 0
    ),
    l AS (SELECT event_id, user_id, value, seq FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) = 1 AND NOT gone)"""

ORACLES: dict[str, str] = {
    "zordered_reads": f"{_narrow('l_partkey', 'part', 'p_partkey')} UNION ALL {_narrow('l_suppkey', 'supplier', 's_suppkey')}",
    "incremental_features": f"""WITH {_LEFT} SELECT user_id, count(value) AS n, round(sum(value), 9) + 0.0 AS total, round(avg(value), 9) + 0.0 AS mean, round(min(value), 9) + 0.0 AS low, round(max(value), 9) + 0.0 AS high FROM l GROUP BY user_id""",
    "merged_on_read": f"WITH {_LEFT} SELECT event_id, user_id, round(value, 6) + 0.0 AS value, seq::BIGINT AS seq FROM l",
    "stream_new_columns": """SELECT CASE WHEN event_id % 3 > 0 THEN event_type END AS event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, round(sum(coalesce(value, 0)) FILTER (NOT (event_id % 3 = 2 AND event_id % 7 = 0)), 4) + 0.0 AS total,
        count(*) FILTER (event_id % 3 = 2 AND event_id % 7 = 0) AS rescued, 2::BIGINT AS restarts FROM events GROUP BY 1""",
    "stream_merge_on_read": "SELECT event_id, user_id, event_type, round(value, 6) + 0.0 AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
}
