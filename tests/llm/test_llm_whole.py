"""What operators for training corpora must cover: all texts and short lines."""

import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlpit.llm import arrow, lines, linking, lm, queries, tables


def test_network_is_fitted_on_a_share_that_grows(spark, monkeypatch):
    """A round goes through every window of its texts, the rounds through all texts of a small corpus and the root of a larger one."""
    words = [f"word{k}" for k in range(40)]
    texts = [" ".join(words[(k * j) % 40] for j in range(30 + k)) for k in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    found = arrow.split_words(arrow.texts_of(pa.array(texts)), lower=True)
    ids, offsets = lm.sequences(found, *lm.subwords(found.words))
    counts = np.bincount(ids, minlength=lm.END + 1).astype(float)
    net = lm.untrained(counts)
    inputs, targets = lm._windows_of(net, arrow.texts_of(pa.array(texts)))
    before = lm.backward(net, inputs, targets)[0]
    n, loss, new = lm.fitted_round(df, net, 1e-2, 3)
    after = lm.backward(new, inputs, targets)[0]
    assert n == len(ids) and after < loss < before
    taken = []
    whole = lm.fitted_round
    monkeypatch.setattr(lm, "fitted_round", lambda *a: (taken.append(a[0].count()), whole(*a))[1])
    assert lm.backward(lm.fitted(df, counts), inputs, targets)[0] < before
    assert sum(taken) == len(texts)
    taken.clear()
    monkeypatch.setattr(lm, "WHOLE", int(counts.sum()) // lm.SCORED // 16)
    lm.fitted(df, counts)
    assert len(texts) / 6 < sum(taken) < len(texts) / 3


def test_short_lines_with_one_edit_are_linked(spark):
    """A letter changed, left out or put in, wherever it is, in lines of 20 to 80 characters."""
    draw = np.random.default_rng(3)
    rows, expected = [], {}
    for n, size in enumerate(range(20, 81)):
        line = "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), size))
        x = int(draw.integers(0, size))
        near = [line[:x] + "X" + line[x + 1 :], line[:x] + "X" + line[x:]] + ([line[:x] + line[x + 1 :]] if size > 22 else [])
        rows.append((n, "\n".join([line, *near])))
        expected |= {(n, k): (n, 0) for k in range(len(near) + 1)}
    rows.append((1000, "a short one, alone\nChapter 3: the first of many"))
    expected |= {(1000, k): (1000, k) for k in range(2)}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in lines.line_groups(df).collect()}
    assert found == expected


def tables_in(folder):
    return sum("_SUCCESS" in names for _, _, names in os.walk(folder))


def test_intermediate_tables_are_deleted(spark, tiny, tmp_path, monkeypatch):
    """What a result still reads is all that is left in the shared folder, also when a step fails."""
    for name, most in (("op1_line_dedup", 1), ("op2_quality_rules", 0), ("op3_lm_scores", 1), ("op4_near_duplicates", 1)):
        folder = tmp_path / name
        monkeypatch.setattr(tables, "shared_folder", lambda _, folder=folder: str(folder))
        found = queries.QUERIES[name](spark, tiny)
        assert found.count() > 0
        assert tables_in(folder) == most and not list(folder.glob("scope-*"))
    folder = tmp_path / "pipeline"
    monkeypatch.setattr(tables, "shared_folder", lambda _: str(folder))
    assert corpus_pipeline.run(spark, tiny).count() > 0
    assert tables_in(folder) == 1
    folder = tmp_path / "failed"
    with pytest.raises(ZeroDivisionError), tables.scope(spark):
        tables.written(spark.range(3))
        raise ZeroDivisionError
    assert tables_in(folder) == 0 and tables._inner.get() is None


def test_large_buckets_are_compared_whole_after_their_blocks(spark, monkeypatch):
    """A bucket of several families whose members are near some of the family alone: the components are those of all its pairs."""
    monkeypatch.setattr(linking, "PART", 4)
    monkeypatch.setattr(linking, "BLOCK", 8)
    draw, sets = np.random.default_rng(7), {}
    for k in range(90):
        start = 1000 * (k % 3) + 3 * int(draw.integers(0, 12))
        sets[k] = sorted({*range(start, start + 30)} - {start + int(draw.integers(0, 30))})
    label = {k: k for k in sets}
    for a in sets:
        for b in sets:
            both = len({*sets[a]} & {*sets[b]})
            if a < b and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    alone = {k for k in label if [*label.values()].count(label[k]) == 1}
    keyed = spark.createDataFrame([(k, key) for k in sets for key in (5, 6)], "id bigint, key bigint")
    items = spark.createDataFrame(list(sets.items()), "id bigint, items array<bigint>")
    found = linking.link(linking.Sketches(keyed), lambda wanted, n: items.join(wanted, "id"))
    assert {tuple(r) for r in found.collect()} == {(k, v) for k, v in label.items() if k not in alone}


def test_shuffle_files_go_when_a_table_is_written(spark):
    """Files of shuffles don't pile up until the driver's memory is swept, which a run of hundreds of small joins may not see."""

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for k in range(found.size()) if (f := found.apply(k).getName()).startswith("shuffle_")}

    before, setting = files(), spark.conf.get(tables.CLEANUP, None)
    with tables.scope(spark):
        held = [tables.written(spark.range(5000).select((F.col("id") % 997).alias("k")).groupBy("k").count()) for _ in range(3)]
        until = time.monotonic() + 20
        while time.monotonic() < until and (new := {f for f in files() - before if f.endswith(".data")}):
            time.sleep(0.2)
        assert not new and spark.conf.get(tables.CLEANUP, None) == setting
        assert [t.count() for t in held] == [997] * 3


def test_keys_that_are_dealt_are_written_first_and_removed(spark, monkeypatch):
    keyed = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "id bigint, key bigint").repartition(2, "id")
    sets = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 3, 4]), (3, [9])], "id bigint, items array<bigint>")
    put, seen = tables._put, []
    monkeypatch.setattr(tables, "_put", lambda df, folder: seen.append(df.columns) or put(df, folder))
    for dealt, most in ((False, 0), (True, 1)):
        seen.clear()
        with tables.scope(spark):
            found = linking.link(linking.Sketches(keyed, dealt=dealt), lambda ids, n: sets.join(ids, "id", "left_semi"))
            assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1)]
        assert seen.count(["id", "key"]) == most
