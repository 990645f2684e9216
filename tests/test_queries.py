"""Every registered query of the library against DuckDB on the same files, and plan checks."""

import re
from collections import Counter

import duckdb
import pytest

from marlpit.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or isinstance(x, bool):
        return x
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return round(float(x), 9) + 0.0
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(value(r[k]) for k in order) for r in data)


@pytest.fixture(scope="module")
def duck(small):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, small, duck, name):
    found = catalogue.QUERIES[name](spark, small)
    expected = duck.sql(catalogue.ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    ours, theirs = rows(found.columns, found.collect()), rows(expected.columns, expected.fetchall())
    assert sum(ours.values()) == sum(theirs.values())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_has_rows(spark, tiny, name):
    found = catalogue.QUERIES[name](spark, tiny)
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_names_are_consistent():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert len(catalogue.QUERIES) > 80


@pytest.mark.parametrize("name", ["numeric_features", "temporal_features", "quality_profile", "psi_exact", "ks_drift", "prediction_distribution", "asof_features", "pii_scan", "auc", "dedup_latest"])
def test_plans_are_native_and_partitioned(spark, tiny, name):
    plan = catalogue.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|CartesianProduct", plan)
    for window in re.findall(r"Window \[.*?\], \[(.*?)\]", plan):
        assert window, "a window without partitions"


def test_scans_are_pruned(spark, tiny):
    plan = catalogue.QUERIES["features_by_key"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan
    assert "PushedFilters: [IsNotNull(c_nationkey), EqualTo(c_nationkey,3)" in plan


def test_entry_and_contract(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
