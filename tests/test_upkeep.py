"""Layouts, change logs and incremental features: files touched, replays, order of arrival."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marlpit.operators import layout
from marlpit.operators.incremental import IncrementalFeatures
from marlpit.streaming.keyed_table import EACH, KeyedTable


def test_zordered_files_are_narrow_in_both_keys(spark, tmp_path):
    """From the footers: a narrow range of either key overlaps under a quarter of the files; sorted by one key, the other one's overlap all."""
    df = spark.range(40_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("a"), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(500)).cast("int")).alias("b"), F.col("id").alias("_z0"))
    layout.write_zordered(df, str(tmp_path / "z"), ["a", "b"], files=64)
    footers = [pq.ParquetFile(tmp_path / "z/data" / f).metadata.row_group(0) for f in os.listdir(tmp_path / "z/data") if f.endswith(".parquet")]
    ends = [{c.path_in_schema: (c.statistics.min, c.statistics.max) for c in (g.column(k) for k in range(2))} for g in footers]
    import datetime

    for key, low, high in (("a", 500, 505), ("a", 700, 705), ("b", datetime.date(2024, 9, 1), datetime.date(2024, 9, 3))):
        overlapping = sum(e[key][0] <= high and e[key][1] >= low for e in ends)
        # a range over the middle touches two of eight columns of boxes, any other narrow one touches one or two
        assert 0 < overlapping <= len(ends) / 4
        assert len(layout.files_for(spark, str(tmp_path / "z"), {key: (low, high)})) == overlapping
        found = layout.read_zordered(spark, str(tmp_path / "z"), {key: (low, high)})
        assert found.columns == df.columns
        assert sorted(r[2] for r in found.collect()) == sorted(r[2] for r in df.filter(F.col(key).between(F.lit(low), F.lit(high))).collect())
    assert layout.share_read(spark, str(tmp_path / "z"), {"a": (500, 505), "b": (datetime.date(2024, 9, 1), None)}) < 0.2


def test_zorder_takes_odd_tables(spark, tmp_path):
    rows = [(None, None), ("a", 1.0), ("a", float("nan")), ("ä", None), ("", 2.0)] * 3
    df = spark.createDataFrame(rows, "s string, x double")
    layout.write_zordered(df, str(tmp_path / "odd"), ["s", "x"], files=4)
    assert layout.read_zordered(spark, str(tmp_path / "odd")).count() == 15
    assert layout.read_zordered(spark, str(tmp_path / "odd"), {"x": (2.0, 2.0)}).count() == 3
    layout.write_zordered(df.limit(0), str(tmp_path / "none"), ["s"], files=4)
    assert layout.read_zordered(spark, str(tmp_path / "none"), {"s": ("a", "b")}).count() == 0
    with pytest.raises(ValueError, match="bits"):
        layout.interleaved([F.lit(1)] * 9, 8)


def test_boxes_are_halved_until_they_are_small():
    even = layout.boxes(dict.fromkeys(range(16), 10), 4, 45)
    assert sorted(even.items()) == [(c, c // 4) for c in range(16)]
    assert layout.boxes({3: 1000, 5: 1, 6: 1}, 3, 10) == {3: 0, 5: 1, 6: 1}
    assert layout.boxes({}, 5, 1) == {}


def test_addresses_interleave_bits(spark):
    row = spark.range(1).select(layout.interleaved([F.lit(0b101), F.lit(0b011)], 3).alias("z")).first()
    assert row.z == 0b100111


def rows_of(table):
    return {tuple(r) for r in table.read().select("k", "v").collect()}


def test_a_batch_writes_its_buckets_alone(spark, tmp_path):
    held = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["seq"], buckets=16)
    first = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("seq"), F.lit("a").alias("v"))
    held.write(first, 0)
    assert len(held.layout()) == 16
    held.write(first.filter("k = 5").withColumns({"seq": F.lit(2), "v": F.lit("b")}), 1)
    one = held.bucket()
    bucket = first.filter("k = 5").select(one).first()[0]
    assert held.layout() == {b: [0] + [EACH] * (b == bucket) for b in range(16)}
    assert rows_of(held) == {(k, "b" if k == 5 else "a") for k in range(1000)}
    # only the fuller bucket is merged, and its old files go
    assert held.compact(1) == [bucket]
    assert held.layout() == {b: [EACH + 1] if b == bucket else [0] for b in range(16)}
    assert held.generations() == [0, EACH + 1]
    assert rows_of(held) == {(k, "b" if k == 5 else "a") for k in range(1000)}
    # a read of few keys opens their buckets
    plan = held.read(spark.createDataFrame([(5,)], "k bigint"))._jdf.queryExecution().executedPlan().toString()
    assert f"_bucket" in plan and "PartitionFilters: [isnotnull(_bucket" in plan


def test_deletions_stay_until_forgotten_and_order_rules(spark, tmp_path):
    held = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["seq"], buckets=2)
    put = lambda batch, *rows: held.write(spark.createDataFrame(rows, "k bigint, seq int, v string, gone boolean"), batch, "gone")
    assert held.read() is None and held.compact() == []
    put(0, (1, 1, "a", False), (2, 1, "b", None), (2, 2, "c", False), (None, 1, "n", False))
    put(1, (1, 5, None, True))
    put(2, (1, 4, "late", False), (3, 1, "d", False))
    assert rows_of(held) == {(2, "c"), (3, "d"), (None, "n")}
    put(2, (1, 4, "late", False), (3, 1, "d", False))
    held.compact(1)
    put(3, (1, 3, "later still", False), (2, 2, "same number, later batch", False))
    assert rows_of(held) == {(2, "same number, later batch"), (3, "d"), (None, "n")}
    held.compact(1)
    held.forget(F.col("seq") < 5)
    put(4, (1, 4, "x", False))
    assert (1, "x") not in rows_of(held)
    held.compact(1)
    held.forget(F.col("seq") <= 5)
    assert held.history().filter("_deleted").count() == 0
    held.write(spark.createDataFrame([(9, 1, "z", 1.5)], "k bigint, seq int, v string, further double"), 5)
    assert {r.k: r.further for r in held.read().collect()}[9] == 1.5


def test_incremental_features_touch_changed_entities_alone(spark, tmp_path):
    held = IncrementalFeatures(spark, str(tmp_path), "e", "r", "v", "seq", buckets=4)
    make = lambda rows: spark.createDataFrame(rows, "e bigint, r bigint, v double, seq int, gone boolean")
    assert held.apply(make([(k, j, float(j), 1, False) for k in range(8) for j in range(3)]), 0, "gone") == {"merged": 8, "computed_again": 0}
    assert held.apply(make([(0, 7, 10.0, 1, False), (1, 0, 5.0, 2, False), (2, 0, None, 9, True), (2, 1, None, 9, True), (2, 2, None, 9, True)]), 1, "gone") == {"merged": 1, "computed_again": 2}
    assert held.held.history().filter("_version = 1").count() == 3
    found = {r.e: (r.n, r.total, r.low, r.high, r.distinct_values) for r in held.features().collect()}
    assert found[0] == (4, 13.0, 0.0, 10.0, 4) and found[1] == (3, 8.0, 1.0, 5.0, 3) and 2 not in found and found[3] == (3, 3.0, 0.0, 2.0, 3)
    # a row of entity 2 that is older than its deletion changes nothing; one that is new makes the entity again
    held.apply(make([(2, 0, 4.0, 3, False)]), 2, "gone")
    assert 2 not in {r.e for r in held.features().collect()}
    held.apply(make([(2, 50, 4.0, 1, False)]), 3, "gone")
    assert [(r.n, r.total) for r in held.features(make([(2, 0, None, 0, None)])).collect()] == [(1, 4.0)]
    before = sorted(map(tuple, held.features().collect()))
    held.apply(make([(2, 50, 4.0, 1, False)]), 3, "gone")
    held.compact(1)
    assert sorted(map(tuple, held.features().collect())) == before


def test_a_batch_of_changes_is_not_read_back(spark, tmp_path, monkeypatch):
    """New rows are known from the batch itself: the last change of each, unless it is a deletion."""
    asked, of_keys = [], KeyedTable.of_keys
    monkeypatch.setattr(KeyedTable, "of_keys", lambda self, keys, before=None: (asked.append(before), of_keys(self, keys, before))[1])
    held = IncrementalFeatures(spark, str(tmp_path), "e", "r", "v", "seq", buckets=2)
    rows = [(1, 1, 5.0, 1, False), (1, 1, 7.0, 2, False), (1, 2, 9.0, 1, False), (1, 2, 9.0, 2, True), (2, 1, 1.0, 1, True), (3, 1, None, 1, False)]
    held.apply(spark.createDataFrame(rows, "e bigint, r bigint, v double, seq int, gone boolean"), 0, "gone")
    assert asked and None not in asked
    assert {r.e: (r.n, r.total) for r in held.features().collect()} == {1: (1, 7.0), 3: (0, 0.0)}
