"""Personal data, erasure, audit and snapshot tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlpit.functions.scalar import col
from marlpit.operators import checks
from marlpit.operators.store import fingerprint, new_id

#: Categories, the patterns that find them in texts, and names of columns that hint at them.
PATTERNS: dict[str, tuple[str, ...]] = {
    "email": (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",),
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b",),
    "credit_card": (r"\b(?:\d{4}[-\s]?){3}\d{4}\b", r"\b\d{16}\b"),
    "phone": (r"\b\+?1?\d{10}\b", r"\b\(\d{3}\)\s*\d{3}-\d{4}\b"),
    "ip_address": (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",),
}
HINTS: dict[str, str] = {"email": "email", "ssn": "ssn", "phone": "phone", "address": "address", "name": "name", "ip_address": "ip_address"}
REDACTED = "[REDACTED]"

AUDIT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("entry_id", "operation", "actor", "model_id", "dataset")]
    + [T.StructField("records_affected", T.LongType()), T.StructField("status", T.StringType()), T.StructField("classification", T.StringType()), T.StructField("timestamp", T.TimestampType()), T.StructField("details", T.MapType(T.StringType(), T.StringType()))]
)
SNAPSHOT = T.StructType(
    [T.StructField("snapshot_id", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("dataset_hash", T.StringType()), T.StructField("num_rows", T.LongType()), T.StructField("num_features", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("run_id", "model_id", "code_version", "environment", "description")]
    + [T.StructField("table_versions", T.MapType(T.StringType(), T.StringType())), T.StructField("retention_days", T.IntegerType())]
)


# ---------------------------------------------------------------- personal data


def hinted(columns: list[str]) -> dict[str, list[str]]:
    """Categories that the columns' names hint at."""
    found = {c: [k for hint, k in HINTS.items() if hint in c.lower()] for c in columns}
    return {c: k for c, k in found.items() if k}


def matches(value: Column, category: str) -> Column:
    out = F.lit(False)
    for pattern in PATTERNS[category]:
        out = out | value.rlike(pattern)
    return out


def pii_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, category, hits, present, rate) of each string column and category, from one aggregate over all rows."""
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, category string, hits bigint, present bigint, rate double")
    pairs = [(c, k) for c in columns for k in PATTERNS]
    row = df.agg(*(F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)), *(F.count_if(matches(col(c), k)).alias(f"h{i}") for i, (c, k) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).alias("category"), F.col(f"h{i}").alias("hits"), F.col(f"n{columns.index(c)}").alias("present")) for i, (c, k) in enumerate(pairs)))
    found = row.select(F.explode(rows).alias("p")).select("p.*")
    return found.withColumn("rate", F.coalesce(F.try_divide(F.col("hits"), F.col("present")), F.lit(0.0)))


def sampled_pii_rates(df: DataFrame, rows: int) -> DataFrame:
    """As :func:`pii_rates`, of the first ``rows`` values of each string column that aren't missing."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    out = pii_rates(df.select(), [])
    for c in columns:
        out = out.unionByName(pii_rates(df.select(col(c)).filter(col(c).isNotNull()).limit(rows), [c]))
    return out


def detect_pii(df: DataFrame, threshold: float = 0.1, sample_rows: int | None = None) -> dict[str, list[str]]:
    """Categories of each column that has any: by its name first, then those that more than the threshold of its values match.

    All rows are looked at unless ``sample_rows`` asks for so many values of each column; missing ones aren't among them.
    """
    found = hinted(df.columns)
    rows = (sampled_pii_rates(df, sample_rows) if sample_rows else pii_rates(df)).filter(F.col("hits") > threshold * F.col("present")).collect()
    order = list(PATTERNS)
    for r in sorted(rows, key=lambda r: (df.columns.index(r.column), order.index(r.category))):
        if r.category not in found.setdefault(r.column, []):
            found[r.column].append(r.category)
    return {c: found[c] for c in df.columns if c in found}


def mask(value: Column, category: str) -> Column:
    """A value with what is personal hidden: e-mail names, and all of a number but its end; anything else is redacted."""
    if category == "email":  # a star for each character of the name
        return F.regexp_replace(value, r"[a-zA-Z0-9._%+-](?=[a-zA-Z0-9._%+-]*@)", "*")
    if category == "ssn":
        return F.regexp_replace(value, r"\d{3}-\d{2}-(\d{4})", "***-**-$1")
    if category == "credit_card":
        return F.regexp_replace(value, r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?(\d{4})", "****-****-****-$1")
    if category == "phone":
        return F.regexp_replace(value, r"(\d{3})[-.\s]?\d{3}[-.\s]?(\d{4})", "$1-***-$2")
    return F.lit(REDACTED)


def mask_pii(df: DataFrame, found: dict[str, list[str]] | None = None) -> DataFrame:
    """The table with each found column masked, category after category; nulls stay null unless redacted."""
    found = detect_pii(df) if found is None else found
    out = []
    for c in df.columns:
        value = col(c)
        for category in found.get(c, ()):
            value = mask(value.cast("string"), category)
        out.append(value.alias(c))
    return df.select(*out)


def compliance_report(df: DataFrame, dataset: str = "unnamed", threshold: float = 0.1) -> DataFrame:
    """A row for each column: type, missing rate, share of distinct values, categories, and the dataset's class."""
    found = detect_pii(df, threshold)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    made = [(c, kinds[c], found.get(c, [])) for c in df.columns]
    meta = df.sparkSession.createDataFrame(made, "feature string, dtype string, categories array<string>")
    p = checks.profile(df).select("feature", "null_rate", F.col("unique_rate").alias("unique_ratio"))
    return p.join(F.broadcast(meta), "feature").select(
        F.lit(dataset).alias("dataset"), F.col("feature").alias("column"), "dtype", "null_rate", "unique_ratio", (F.size("categories") > 0).alias("is_pii"), "categories", F.lit("pii" if found else "internal").alias("classification")
    )


def dataset_summary(df: DataFrame, dataset: str = "unnamed", threshold: float = 0.1, audit: DataFrame | None = None, last: int = 10) -> DataFrame:
    """One row about a whole table: rows, columns, cells that are missing, different rows, columns that hold personal data and the class that gives it.

    With ``audit`` (entries with ``entry_id`` and ``operation``), also the operations of the ``last`` entries, latest first.
    """
    report = compliance_report(df, dataset, threshold)
    cells = [F.count_if(col(c).isNull()) for c in df.columns]
    missing = cells[0]
    for c in cells[1:]:
        missing = missing + c
    row = df.agg(F.count("*").alias("rows"), F.try_divide(missing, F.count("*") * len(df.columns)).alias("missing_rate"))
    different = df.distinct().agg(F.count("*").alias("different_rows"))
    held = report.agg(F.count("*").alias("columns"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_pii"), F.col("column")))), ",").alias("pii_columns"), F.first("classification").alias("classification"))
    out = row.crossJoin(different).crossJoin(held).withColumn("dataset", F.lit(dataset))  # one row each
    if audit is not None:
        some = audit.orderBy(F.desc("entry_id")).limit(last)
        names = some.agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("entry_id", "operation")))), lambda e: e["operation"]), ",").alias("last_operations"))
        out = out.crossJoin(names)
    return out


# ---------------------------------------------------------------- erasure


def erasure_counts(tables: dict[str, tuple[DataFrame, str]], subjects: DataFrame, subject_key: str) -> DataFrame:
    """(table, key_column, affected): rows of each table that belong to the subjects. Tables are given with their key column."""
    keys = subjects.select(col(subject_key).alias("_subject")).distinct()
    out = None
    for name, (df, key) in tables.items():
        one = df.join(keys, col(key) == F.col("_subject"), "left_semi").agg(F.count("*").alias("affected")).select(F.lit(name).alias("table"), F.lit(key).alias("key_column"), "affected")
        out = one if out is None else out.unionByName(one)
    return out


def erase(df: DataFrame, key: str, subjects: DataFrame, subject_key: str) -> DataFrame:
    """The table without the subjects' rows."""
    return df.join(subjects.select(col(subject_key).alias("_subject")).distinct(), col(key) == F.col("_subject"), "left_anti")


def erasure_plan(tables: dict[str, tuple[DataFrame, str]], subjects: DataFrame, subject_key: str, links: DataFrame | None = None) -> DataFrame:
    """The counts, and with ``links`` (child, parent) of tables also which tables are made from the affected ones."""
    counts = erasure_counts(tables, subjects, subject_key)
    if links is None:
        return counts.withColumn("cascade", F.array().cast("array<string>"))
    from marlpit.operators.lineage import closure

    below = closure(links).groupBy(F.col("ancestor").alias("table")).agg(F.array_sort(F.collect_set("item")).alias("cascade"))
    return counts.join(below, "table", "left").withColumn("cascade", F.coalesce("cascade", F.array().cast("array<string>")))


def exclude_opted_out(df: DataFrame, key: str, opted_out: DataFrame, opted_key: str) -> DataFrame:
    """Rows to score: those whose key isn't on the list."""
    return erase(df, key, opted_out, opted_key)


# ---------------------------------------------------------------- audit and snapshots


class AuditLog:
    """Audit entries as JSON lines under a path; appended in batches, never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, entries: DataFrame | list[dict]) -> None:
        """Entries of the audit columns; missing ones are null, but for a new id, the time and the status ``success``."""
        if not isinstance(entries, DataFrame):
            given = [tuple(e.get(f.name) for f in AUDIT) for e in entries]
            entries = self.spark.createDataFrame(given, AUDIT)
        defaults = {"entry_id": F.uuid(), "timestamp": F.current_timestamp(), "status": F.lit("success")}
        kinds = {f.name: f.dataType for f in AUDIT}
        out = []
        for name, kind in kinds.items():
            value = col(name).cast(kind) if name in entries.columns else F.lit(None).cast(kind)
            out.append((F.coalesce(value, defaults[name]) if name in defaults else value).alias(name))
        entries.select(*out).write.mode("append").json(self.path)

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(AUDIT).json(self.path)
        except Exception as e:  # nothing was logged yet
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], AUDIT)
            raise


def audit_filter(log: DataFrame, operation: str | None = None, model_id: str | None = None, actor: str | None = None, status: str | None = None) -> DataFrame:
    """Entries that fit all conditions given."""
    for name, value in (("operation", operation), ("model_id", model_id), ("actor", actor), ("status", status)):
        if value is not None:
            log = log.filter(F.col(name) == value)
    return log


def count_by_operation(log: DataFrame) -> DataFrame:
    return log.groupBy("operation").agg(F.count("*").alias("n"))


def recent(log: DataFrame, n: int = 50, tie: str = "entry_id") -> DataFrame:
    """The last n entries; ties in time go by ``tie``."""
    return log.orderBy(F.desc("timestamp"), F.desc(tie)).limit(n)


class Snapshots:
    """Records of dataset states, one row each, appended."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def create(self, df: DataFrame, retention_days: int = 365 * 7, table_versions: dict[str, str] | None = None, **known: str) -> dict:
        """Takes the dataset's fingerprint and sizes. ``known``: run_id, model_id, code_version, environment, description."""
        mark = fingerprint(df).first()
        row = {"snapshot_id": new_id("snap"), "created_at": datetime.now(UTC), "dataset_hash": mark.fingerprint, "num_rows": mark.rows, "num_features": len(df.columns), "table_versions": table_versions or {}, "retention_days": retention_days, **known}
        self.spark.createDataFrame([tuple(row.get(f.name) for f in SNAPSHOT)], SNAPSHOT).write.mode("append").parquet(self.path)
        return row

    def all(self) -> DataFrame:
        try:
            return self.spark.read.schema(SNAPSHOT).parquet(self.path)
        except Exception as e:  # none was taken yet
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SNAPSHOT)
            raise

    def get(self, snapshot_id: str) -> dict | None:
        row = self.all().filter(F.col("snapshot_id") == snapshot_id).first()
        return row.asDict() if row else None

    def latest(self, n: int = 20) -> DataFrame:
        return self.all().orderBy(F.desc("created_at"), F.desc("snapshot_id")).limit(n)

    def kept(self, now: Column | None = None) -> DataFrame:
        """Snapshots within their retention."""
        now = F.current_timestamp() if now is None else now
        return self.all().filter(F.col("created_at") + F.make_interval(days=F.col("retention_days")) >= now)
