"""A versioned feature store over Parquet: registration, reads as of a time, point-in-time training sets, lineage."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlpit.functions.scalar import bin_of, col

#: Rows of one range of time in an as-of join, and how many ranges there are at most.
RANGE_ROWS, MOST_RANGES = 1_000_000, 1024

CATALOG = "name string, version string, row_count bigint, column_count int, columns array<string>, created_at timestamp, data_hash string, source string, description string"


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint): 16 hex digits that don't hang on the order of rows, from row hashes' sum and exclusive or."""
    row = F.xxhash64(*(col(c) for c in df.columns)) if df.columns else F.lit(0).cast("bigint")
    found = df.select(row.alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("s"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"))
    return found.select("rows", F.substring(F.sha2(F.concat_ws("|", F.col("rows").cast("string"), F.col("s").cast("string"), F.col("x").cast("string")), 256), 1, 16).alias("fingerprint"))


def write_clustered(df: DataFrame, path: str, keys: list[str], mode: str = "overwrite") -> None:
    """Parquet whose files cover narrow ranges of the keys, so that reads by key skip most of them."""
    df.repartitionByRange(*(col(k) for k in keys)).sortWithinPartitions(*(col(k) for k in keys)).write.mode(mode).parquet(path)


def left_join(entities: DataFrame, features: DataFrame, key: str, suffix: str) -> DataFrame:
    """Entities with the features of their key; a feature whose name is taken gets the suffix."""
    taken = set(entities.columns) - {key}
    renamed = features.select(*(col(c).alias(f"{c}_{suffix}" if c in taken else c) for c in features.columns))
    return entities.join(renamed, key, "left")


def as_of_join(entities: DataFrame, features: DataFrame, key: str, entity_time: str, feature_time: str, values: list[str], max_age: Column | None = None, ranges: int | None = None) -> DataFrame:
    """Entities with the latest features of their key at or before their time; nulls if there are none, or only older ones than ``max_age``.

    Both sides are laid over each other and each entity takes the last features above it, so rows aren't multiplied.
    Features of one instant stand before entities of the same. Of features with one key and time the greatest counts.
    Rows without key or time get nulls. Added: ``values`` and ``{feature_time}_used``.
    """
    used = f"{feature_time}_used"
    payload = F.struct(col(feature_time).alias("_at"), *(col(v).alias(f"_v{k}") for k, v in enumerate(values)))
    one = features.filter(col(key).isNotNull() & col(feature_time).isNotNull()).select(col(key).alias("_key"), col(feature_time).alias("_time"), F.lit(0).alias("_side"), payload.alias("_feature"))
    given = F.struct(*(col(c).alias(f"_e{k}") for k, c in enumerate(entities.columns)))
    two = entities.select(col(key).alias("_key"), col(entity_time).alias("_time"), F.lit(1).alias("_side"), given.alias("_entity"))
    both = one.unionByName(two, allowMissingColumns=True)
    # a key of very many rows is dealt into ranges of time, of which there are more the more rows there are; what a range leaves open
    # comes from the ranges before it
    at = F.unix_micros(F.col("_time").cast("timestamp"))
    seen = both.agg(F.count("*").alias("n"), F.percentile_approx(at, [k / MOST_RANGES for k in range(1, MOST_RANGES)], 10_000).alias("e")).first()
    wanted = min(ranges or -(-seen.n // RANGE_ROWS), MOST_RANGES)
    ends = sorted({seen.e[k * MOST_RANGES // wanted - 1] for k in range(1, wanted)}) if seen.e else []
    last = F.last("_feature", ignorenulls=True)
    order = Window.partitionBy("_key", *(["_range"] if ends else [])).orderBy("_time", "_side", "_feature").rowsBetween(Window.unboundedPreceding, 0)
    if ends:
        both = both.withColumn("_range", bin_of(at, F.array(*map(F.lit, ends)).cast("array<bigint>")))
    found = both.withColumn("_last", last.over(order)).filter("_side = 1")
    if ends:
        tails = both.groupBy("_key", "_range").agg(F.max(F.when(F.col("_side") == 0, F.struct("_time", "_feature"))).alias("_tail"))
        before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
        carried = tails.select("_key", "_range", F.last("_tail", ignorenulls=True).over(before).alias("_carried"))
        found = found.join(carried, ["_key", "_range"], "left").withColumn("_last", F.coalesce("_last", "_carried._feature"))
    good = F.col("_key").isNotNull() & F.col("_time").isNotNull()
    if max_age is not None:
        good = good & (F.col("_last._at") >= F.col("_time") - max_age)
    return found.select(*(F.col(f"_entity._e{k}").alias(c) for k, c in enumerate(entities.columns)), *(F.when(good, F.col(f"_last._v{k}")).alias(v) for k, v in enumerate(values)), F.when(good, F.col("_last._at")).alias(used))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order's columns, nulls lowest; each task first finds the last of its own rows."""
    place = F.struct(*(col(o) for o in order))
    last = df.groupBy(*(col(k) for k in keys)).agg(F.max_by(F.struct(*(col(c) for c in df.columns)), place).alias("_row"))
    return last.select(*(F.col(f"_row.`{c}`") for c in df.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key of both tables."""
    return latest(old.unionByName(new, allowMissingColumns=True), keys, order)


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The change feed from one version to the next: rows of the new one, or the old one's where it lacks the key, with
    ``_change``: insert, update or delete. Rows that are alike aren't in it."""
    values = [c for c in new.columns if c not in keys]
    one = old.select(*(col(k) for k in keys), F.struct(*(col(c) for c in values)).alias("_old"))
    two = new.select(*(col(k) for k in keys), F.struct(*(col(c) for c in values)).alias("_new"))
    both = one.join(two, keys, "full")
    kind = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    found = both.withColumn("_change", kind).filter("_change is not null").withColumn("_row", F.coalesce("_new", "_old"))
    return found.select(*(col(k) for k in keys), *(F.col(f"_row.`{c}`").alias(c) for c in values), "_change")


def apply_changes(old: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """The next version, from a version and its change feed; unchanged rows are taken as they are."""
    untouched = old.join(feed.select(*(col(k) for k in keys)), keys, "left_anti")
    return untouched.unionByName(feed.filter("_change <> 'delete'").drop("_change"))


@dataclass(frozen=True)
class FeatureSet:
    """A training table, not yet run, with what it was made of."""

    data: DataFrame
    feature_names: list[str]
    versions: dict[str, str]
    skipped: list[str] = field(default_factory=list)


class FeatureStore:
    """Feature tables under a path, each version a folder, and one catalog table with a row for each registration."""

    def __init__(self, spark: SparkSession, path: str, environment: str = "local"):
        self.spark, self.path, self.environment = spark, path.rstrip("/"), environment

    @classmethod
    def of(cls, spark: SparkSession, config: dict) -> FeatureStore:
        """The store that a configuration names: environments differ by path alone."""
        environment = config.get("environment", "local")
        return cls(spark, config["paths"][environment] if "paths" in config else config["path"], environment)

    def catalog(self) -> DataFrame:
        try:
            return self.spark.read.schema(CATALOG).parquet(f"{self.path}/_catalog")
        except Exception as e:  # nothing is registered yet
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], CATALOG)
            raise

    def register(self, name: str, df: DataFrame, version: str | None = None, description: str = "", keys: list[str] | None = None) -> dict:
        """Writes a version and its catalog row; gives that row. The hash and the counts are of what was written."""
        created = datetime.now(UTC)
        version = version or created.strftime("v%Y%m%d_%H%M%S_%f")
        source = f"{self.path}/{name}/version={version}"
        if keys:
            write_clustered(df, source, keys)
        else:
            df.write.mode("overwrite").parquet(source)
        data = self.spark.read.parquet(source)
        mark = fingerprint(data).first()
        row = (name, version, mark.rows, len(data.columns), data.columns, created, mark.fingerprint, source, description)
        self.spark.createDataFrame([row], CATALOG).write.mode("append").parquet(f"{self.path}/_catalog")
        return dict(zip([f.split()[0] for f in CATALOG.split(", ")], row, strict=True))

    def meta(self, name: str, version: str | None = None) -> dict:
        found = self.catalog().filter(F.col("name") == name)
        if version:
            found = found.filter(F.col("version") == version)
        row = found.orderBy(F.desc("created_at"), F.desc("version")).first()
        if row is None:
            raise KeyError(f"no feature table {name}" + (f" of version {version}" if version else ""))
        return row.asDict()

    def read(self, name: str, version: str | None = None, keys: DataFrame | list | None = None, key: str = "record_id", time: str | None = None, as_of=None) -> DataFrame:
        """A version's rows, the latest one's by default; of given keys only, and up to a time."""
        df = self.spark.read.parquet(self.meta(name, version)["source"])
        if time is not None and as_of is not None:
            df = df.filter(col(time).cast("timestamp") <= F.lit(as_of).cast("timestamp"))
        if isinstance(keys, DataFrame):
            return df.join(keys.select(col(key)), key, "left_semi")
        return df if keys is None else df.filter(col(key).isin(list(keys)))

    def training_set(self, entities: DataFrame, tables: list[str], key: str = "record_id", entity_time: str | None = None, feature_time: str | None = None, max_age: Column | None = None) -> FeatureSet:
        """Entities with the features of each table, by key, or by key and time if both times are named; unknown tables are skipped."""
        out, versions, skipped = entities, {}, []
        for name in tables:
            try:
                meta = self.meta(name)
            except KeyError:
                skipped.append(name)
                continue
            features = self.spark.read.parquet(meta["source"])
            versions[name] = meta["version"]
            if entity_time and feature_time and feature_time in features.columns:
                taken = set(out.columns)
                names = {c: f"{c}_{name}" if c in taken else c for c in features.columns if c not in (key, feature_time)}
                renamed = features.select(col(key), col(feature_time).alias(f"_{name}_time"), *(col(c).alias(n) for c, n in names.items()))
                out = as_of_join(out, renamed, key, entity_time, f"_{name}_time", list(names.values()), max_age).drop(f"_{name}_time_used")
            else:
                out = left_join(out, features, key, name)
        given = set(entities.columns)
        return FeatureSet(out, [c for c in out.columns if c not in given], versions, skipped)

    def tables(self) -> DataFrame:
        """The latest row of each table."""
        return latest(self.catalog(), ["name"], ["created_at", "version"])

    def lineage(self, name: str) -> DataFrame:
        """(name, version, created_at, source, data_hash, error): the versions of a table, or one row with an error."""
        found = self.catalog().filter(F.col("name") == name).select("name", "version", "created_at", "source", "data_hash", F.lit(None).cast("string").alias("error"))
        none = self.spark.range(1).select(F.lit(name).alias("name")).join(found.select("name"), "name", "left_anti")
        return found.unionByName(none.withColumn("error", F.lit("not found")), allowMissingColumns=True)

    def feature_set(self, entities: DataFrame, spec: dict, key: str = "record_id") -> FeatureSet:
        """A named set from configuration: its source table, how many columns by which selection, and which of its columns are ids.

        Ids (``ids``) aren't features: their variance grows with the table's keys. They are left out.
        """
        from marlpit.operators.features import feature_columns, select_features

        made = self.training_set(entities, [spec["source"]], key)
        ids = [c for c in spec.get("ids", ()) if c in made.feature_names]
        columns = [c for c in feature_columns(made.data, (key, *ids)) if c in made.feature_names]
        kind = {"variance": "clusterer", "anova": "classifier", "regression": "regressor"}[spec.get("selection", "variance")]
        data, chosen = select_features(made.data.drop(*ids), columns, spec.get("size", len(columns)), spec.get("target"), kind)
        return FeatureSet(data, chosen, made.versions, made.skipped)


def new_id(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"
