"""Streams that grow columns, circles, distinct counts, hot keys and sketches: plans, odd tables, plain counterparts."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from marlpit.functions.scalar import bin_of
from marlpit.operators import checks, drift, features, lineage, monitoring, sketches
from marlpit.operators.quantiles import exact_quantiles
from marlpit.sources import scratch
from marlpit.streaming import evolving


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- streams


def test_new_columns_and_wrong_types_in_the_middle(spark, tmp_path):
    landing, arrivals = tmp_path / "in", 0

    def arrive(*lines):
        nonlocal arrivals
        landing.mkdir(exist_ok=True)
        (landing / f"{arrivals}.json").write_text("\n".join(lines) + "\n")
        arrivals += 1

    def run():
        return evolving.append_evolving(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "c"))

    arrive('{"a": 1, "t": "2024-01-02 03:04:05"}', '{"a": 2, "t": null}')
    assert run() == 1
    assert run() == 0
    arrive('{"a": "x", "b": 1.5}', '{"a": 3, "b": 2, "nested": {"k": [1, 2]}}', "not json", "")
    assert run() == 1
    arrive('{"b": true, "flag": true}', '{"a": 4.5}', '{"flag": false, "none": null}')
    assert run() == 1
    log = evolving.ColumnLog(spark, str(tmp_path / "c/columns"))
    assert log.columns() == {"a": "bigint", "t": "timestamp", "b": "double", "nested": "string", "flag": "boolean", "none": "string"} and log.versions() == 3
    rows = evolving.read_evolved(spark, str(tmp_path / "out")).collect()
    found = sorted((r.a, r.b, r.flag, r.nested, r["_rescued"]) for r in rows if r.a is not None and r.b is None and r.flag is None and r.nested is None)
    assert [f[0] for f in found] == [1, 2]
    assert len(rows) == 9
    assert sorted(r["_rescued"] for r in rows if r["_rescued"]) == ['{"":"not json"}', '{"a":"4.5"}', '{"a":"x"}', '{"b":"true"}']
    assert [r.nested for r in rows if r.nested] == ['{"k":[1,2]}']
    assert all(r["_source_file"].endswith(".json") for r in rows)


def test_columns_named_before_and_other_failures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/0.json").write_text('{"a": 1}\n')
    assert evolving.append_evolving(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), {"a": "string", "z": "double"}) == 0
    assert evolving.read_evolved(spark, str(tmp_path / "out")).select("a", "z").collect() == [("1", None)]
    (tmp_path / "in/1.json").write_text('{"a": 1, "A": 2}\n')
    with pytest.raises(StreamingQueryException):
        evolving.append_evolving(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"))


# ---------------------------------------------------------------- circles


def cyclic_by_search(edges):
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)

    def above(x):
        seen, todo = set(), list(up.get(x, ()))
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += up.get(y, ())
        return seen

    inside = {x for x in up if x in above(x)}
    return inside | {x for x in up if above(x) & inside}


def test_circles_are_what_a_search_finds(spark):
    draw = random.Random(5)
    for n, m in ((6, 6), (30, 30), (40, 60), (25, 20)):
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)]
        df = spark.createDataFrame([*edges, (None, 1), (1, None)], "child int, parent int")
        assert {r.item for r in lineage.cyclic(df).collect()} == cyclic_by_search(edges)
    assert lineage.cyclic(df.limit(0)).collect() == []


def test_long_chains_take_few_turns(spark, monkeypatch):
    written = []
    real = lineage.scratch

    def counted(session):
        from contextlib import contextmanager

        @contextmanager
        def block():
            with real(session) as held:
                yield lambda df: (written.append(1), held(df))[1]

        return block()

    monkeypatch.setattr(lineage, "scratch", counted)
    chain = [(k + 1, k) for k in range(400)]
    df = spark.createDataFrame([*chain, (1000, 1001), (1001, 1002), (1002, 1000), (1003, 1002)], "child int, parent int")
    assert {r.item for r in lineage.cyclic(df).collect()} == {1000, 1001, 1002, 1003}
    assert len(written) < 16


# ---------------------------------------------------------------- distinct counts and quantiles


def test_distinct_counts_take_one_exchange(spark):
    rows = [(1, 1.5, "a", True, [1], b"x", {"k": 1}), (1, -0.0, "a", None, [1], b"x", {}), (2, 0.0, None, True, None, b"", {}), (None, float("nan"), "", False, [], None, {})]
    df = spark.createDataFrame(rows, "i int, d double, s string, b boolean, l array<int>, y binary, m map<string,int>").withColumn("at", F.lit("2024-01-01").cast("date")).withColumn("x.y", F.col("i").cast("decimal(9,2)"))
    found = checks.distinct_counts(df, df.columns)
    assert {r.feature: r.unique_count for r in found.collect()} == {"i": 2, "d": 2, "s": 2, "b": 2, "l": 2, "y": 2, "m": None, "at": 1, "x.y": 2}
    plan = plan_of(checks.distinct_counts(df, df.columns))
    assert "Expand" not in plan and plan.count("hashpartitioning(k") <= 2 and "Expand" not in plan_of(checks.profile(df))
    profiled = {r.feature: r.unique_count for r in checks.profile(df).collect()}
    assert profiled == {r.feature: r.unique_count for r in found.collect()}
    assert {r.unique_count for r in checks.distinct_counts(df.limit(0), ["i", "s"]).collect()} == {0}
    assert {r.feature: r.unique_count for r in checks.distinct_counts(df, ["m"]).collect()} == {"m": None}


def test_bins_by_steps_are_bins_by_counting(spark):
    draw = np.random.default_rng(1)
    for n in (0, 1, 9, 255, 1023, 1500):
        edges = sorted(set(draw.normal(size=n).tolist()))
        values = [*draw.normal(size=50).tolist(), *edges[:20], -9.0, 9.0]
        df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", bin_of(F.col("v"), F.array(*map(F.lit, edges)).cast("array<double>")))
        assert all(r.b == sum(e <= r.v for e in edges) for r in df.collect())


def test_quantiles_are_exact_and_leave_only_their_result(spark, tmp_path, monkeypatch):
    folders = []
    real = scratch.new_folder
    monkeypatch.setattr(scratch, "new_folder", lambda session, name="scratch": folders.append(real(session, name)) or folders[-1])
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5000).cast("double").alias("value"))
    found = {r.g: r.quantiles for r in exact_quantiles(df, ["g"], [0.0, 0.25, 0.5, 1.0]).collect()}
    for g in range(3):
        assert found[g] == np.quantile([float(k * 7919 % 5000) for k in range(5000) if k % 3 == g], [0, 0.25, 0.5, 1]).tolist()
    # groups of all sizes that have brackets of their own, with ties, one value, and few distinct ones
    draw, groups = np.random.default_rng(9), {}
    for n in (1, 2, 5, 399, 400, 1000, 30_000):
        for values in (draw.normal(size=n), draw.integers(0, 3, n).astype(float), np.full(n, 2.5), np.sort(draw.gamma(1, 5, n))):
            groups[len(groups)] = values
    some = spark.createDataFrame(pd.DataFrame({"g": np.repeat(list(groups), [len(v) for v in groups.values()]), "value": np.concatenate(list(groups.values()))}))
    large = spark.range(250_000).select(F.lit(-1).cast("bigint").alias("g"), (F.col("id") * 7919 % 250_000).cast("double").alias("value"))
    groups[-1] = np.arange(250_000.0)
    shares = [0.0, 0.001, 0.1, 0.5, 0.75, 0.9995, 1.0]
    for r in exact_quantiles(some.unionByName(large), ["g"], shares).collect():
        assert np.allclose(r.quantiles, np.quantile(groups[r.g], shares), rtol=0, atol=1e-9)
    import os

    left = [f for f in folders if os.path.exists(f)]
    assert sorted(spark.read.parquet(f).count() for f in left) == [3, 29]


# ---------------------------------------------------------------- hot keys


@pytest.fixture(scope="module")
def hot(spark):
    draw = np.random.default_rng(3)
    rows = [(None if k % 11 == 0 else 7 if k % 3 else int(draw.integers(0, 5)), int(t), float(v), k) for k, (t, v) in enumerate(zip(draw.integers(0, 200 * 24, 2000), draw.integers(0, 9, 2000), strict=True))]
    df = spark.createDataFrame(rows, "k int, hour int, v double, id int")
    return df.select("k", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, hour)").alias("t"), F.when(F.col("id") % 13 > 0, F.col("v")).alias("v"), "id").cache()


def test_hot_keys_of_lags_are_spread(spark, hot):
    plain = features.lags(hot, "k", ["t", "id"], "v", (1, 7, 30))
    split = features.lags(hot, "k", ["t", "id"], "v", (1, 7, 30), most_rows=100)
    assert plain.columns == split.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))
    assert "Window [lag" in plan_of(split) and "_in" in plan_of(split)
    # blocks are at least as long as the longest period
    short = features.lags(hot, "k", ["t", "id"], "v", (1, 300), most_rows=50)
    assert sorted(map(str, features.lags(hot, "k", ["t", "id"], "v", (1, 300)).collect())) == sorted(map(str, short.collect()))


def test_hot_keys_of_rolling_windows_are_spread(spark, hot):
    days = (1, 7, 30)
    some = hot.unionByName(hot.limit(40).withColumn("t", F.lit(None).cast("timestamp")))
    plain, split = features.rolling(some, "k", "t", "v", days), features.rolling(some, "k", "t", "v", days, most_rows=100)
    assert plain.columns == split.columns and "_in" in plan_of(split)
    near = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert near(plain) == near(split)
    # no range of the hot key holds more than a part of its rows and what the longest window adds
    assert features.rolling(some.filter("k = 7"), "k", "t", "v", (1,), most_rows=100).count() == some.filter("k = 7").count()


def test_rolling_windows_of_hot_keys_dont_hang_on_frames(spark):
    """No frame that slides, whatever a window holds; small values beside great ones keep their digits, and NaN stays in its windows."""
    rows = [(k // 3, float("nan") if k == 900 else 1e15 if k < 300 else 0.1 * (k % 7)) for k in range(1500)]
    df = spark.createDataFrame(rows, "hour int, v double").select(F.lit("a").alias("k"), F.expr("timestamp'1969-12-30 00:00:00' + make_interval(0, 0, 0, 0, hour)").alias("t"), "v", "hour")
    split = features.rolling(df, "k", "t", "v", (1, 3), most_rows=10)
    hot_side = plan_of(split).split("Union", 1)[1]
    assert hot_side.count("-86400000000") == plan_of(features.rolling(df, "k", "t", "v", (1, 3))).count("-86400000000")
    for r in split.collect():
        for n in (1, 3):
            own = [v for h, v in rows if r.hour - 24 * n <= h <= r.hour]
            assert r[f"v_count_{n}d"] == len(own) and r[f"v_mean_{n}d"] == pytest.approx(float(np.mean(own)), rel=1e-12, nan_ok=True)


# ---------------------------------------------------------------- sketches


def test_sketches_of_parts_are_that_of_the_whole(spark):
    draw = np.random.default_rng(2)
    rows = [(k % 9, float(x), float(k % 5)) for k, x in enumerate(draw.gamma(2, 3, 20_000))]
    df = spark.createDataFrame([*rows, (1, None, float("nan"))], "part int, x double, few double")
    parts = sketches.sketch(df, ["x", "few"], ["part"])
    assert parts.count() == 18
    whole = {r.feature: r for r in sketches.describe(sketches.merge(parts)).collect()}
    values = np.array([r[1] for r in rows])
    assert (whole["x"].n, whole["x"].low, whole["x"].high) == (20_000, values.min(), values.max())
    assert whole["x"].mean == pytest.approx(values.mean()) and whole["x"].std == pytest.approx(values.std(ddof=1))
    assert abs((values <= whole["x"].median).mean() - 0.5) < sketches.RANK_ERROR
    assert whole["few"].distinct_values == 5 and abs(whole["x"].distinct_values - 20_000) < 1_000 and whole["x"].null_rate == pytest.approx(1 / 20_001)
    assert sketches.sketch(df.limit(0), ["x"]).count() == 0


def test_drift_from_sketches_is_near_the_exact_one(spark, tmp_path):
    draw = np.random.default_rng(6)
    one = spark.createDataFrame([(float(a), float(b)) for a, b in zip(draw.normal(size=9000), draw.integers(0, 4, 9000), strict=True)], "x double, few double")
    two = spark.createDataFrame([(float(a), float(b)) for a, b in zip(draw.normal(0.4, 1.2, size=7000), draw.integers(0, 5, 7000), strict=True)], "x double, few double")
    sketches.save(sketches.sketch(one, ["x", "few"]), str(tmp_path / "s"), "v1")
    sketches.save(sketches.sketch(one, ["x", "few"]), str(tmp_path / "s"), "v1")
    held = sketches.load(spark, str(tmp_path / "s"), "v1")
    assert held.count() == 2
    found = {r.feature: r for r in sketches.drift(held, sketches.sketch(two, ["x", "few"])).collect()}
    psi = {r.feature: r.psi for r in drift.psi(one, two, ["x", "few"]).collect()}
    ks = {r.feature: r.ks_statistic for r in drift.ks(one, two, ["x", "few"]).collect()}
    for c in ("x", "few"):
        assert abs(found[c].ks_statistic - ks[c]) < 2 * sketches.RANK_ERROR
        assert abs(found[c].psi - psi[c]) < 0.05
    same = sketches.drift(held, held).collect()
    assert all(r.psi == 0 and r.ks_statistic == 0 for r in same)
    assert (found["few"].distinct_before, found["few"].distinct_after) == (4, 5)
    assert sketches.drift(held, sketches.sketch(two.limit(0), ["x", "few"])).count() == 0


# ---------------------------------------------------------------- what goes through the driver


def test_turns_of_dependencies_are_never_broadcast(spark, monkeypatch):
    """A turn's tables go through the driver if they are broadcast, and there are many turns."""
    plans, cut = [], lineage.cut

    def spied(df):
        made = cut(df)
        plans.append(plan_of(df))
        return made

    monkeypatch.setattr(lineage, "cut", spied)
    edges = spark.range(2, 200).select(F.col("id").alias("child"), F.expr("id div 2").alias("parent"))
    assert {r.item: r.layer for r in lineage.layers(edges).collect()} == {k: k.bit_length() - 1 for k in range(1, 200)}
    assert {r.item for r in lineage.downstream(edges, 5).collect()} == {k for k in range(10, 200) if bin(k).startswith("0b101")}
    assert len(plans) > 10 and not any("BroadcastHashJoin" in p for p in plans)


def test_words_of_weighed_terms_are_not_shuffled(spark):
    """Tasks count their own rows' words; rows of one key are put together all the same, those without text among them."""
    rows = [(1, "Ä cat, the cat"), (2, "the dog"), (1, "The cat again"), (1, None), (3, None), (3, ""), (None, "a"), (None, "b a")]
    df = spark.createDataFrame(rows, "k int, t string")
    joined = spark.createDataFrame([(1, "Ä cat, the cat The cat again"), (2, "the dog"), (3, ""), (None, "a b a")], "k int, t string")
    one, two = (features.term_weights(x, "t", "k") for x in (df, joined))
    assert "Exchange" not in plan_of(one) and "Exchange" not in plan_of(two)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_predictions_are_counted_from_their_distribution(spark):
    """The roll-up doesn't read predictions again, those without a model included in the count."""
    rows = [("a", 1.0), ("a", 2.0), ("b", 3.0), (None, 4.0)]
    predictions = spark.createDataFrame(rows, "model_id string, prediction double").withColumn("probability", F.lit(0.5))
    trained = spark.createDataFrame([("a", "success"), ("b", "failed")], "model_id string, status string")
    none = spark.createDataFrame([], "severity string, type string, message string")
    drifts = spark.createDataFrame([("f", True)], "feature string, is_drifted boolean")
    held = scratch.kept(monitoring.prediction_distribution(predictions))
    plain, counted = monitoring.roll_up(trained, predictions, none, drifts), monitoring.roll_up(trained, predictions, none, drifts, held)
    assert plain.collect() == counted.collect() and counted.first().predictions == 4 and counted.schema.names == plain.schema.names
