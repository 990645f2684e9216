"""The prefix trie against a trie of dictionaries."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from marlpit.llm import prefix_trie, queries, tables

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, kind int"


def expected(rows):
    """Set of node tuples of (conv_id, turn, role, text) rows without ties."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = tuple(own.get(base, [])[:h] + v[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
        ends[p].append(c)
    children, leaves, saved = defaultdict(set), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())



def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def talks(seed, n, words=3, length=14):
    """Conversations over few texts, so that many begin alike; copies, gaps in the ids, a long one."""
    draw, rows = np.random.default_rng(seed), []
    for c in draw.choice(4 * n, n, replace=False).tolist():
        size = int(draw.integers(1, length))
        rows += [(c, t, ["user", "assistant"][t % 2], f"é{draw.integers(0, words)}" * int(draw.integers(0, 2) + 1)) for t in range(size)]
    rows += [(c, t, "user", "copy") for c in range(10 * n, 10 * n + 40, 5) for t in range(6)]
    rows += [(c, t, "user", f"long{t}") for c in (50_000, 50_001, 50_005) for t in range(16 + c % 2)]
    return rows


def test_trie_of_conversations(spark, small):
    rows = [tuple(r) for r in queries.table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    result = queries.op12_prefix_trie(spark, small)
    assert result.columns == list(prefix_trie.NODE)
    ours = order(tuple(r) for r in result.collect())
    assert ours == order(expected(rows))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    theirs = db.sql(queries.ORACLES["op12_prefix_trie"])
    assert theirs.columns == list(prefix_trie.NODE)
    assert ours == order(theirs.fetchall())


@pytest.mark.parametrize(("segment", "parts"), [(4096, "1"), (4096, "7"), (5, "4")])
def test_trie_over_segments_and_ranges(spark, segment, parts):
    rows = talks(segment, 60)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert order(tuple(r) for r in prefix_trie.prefix_trie(df, segment=segment).collect()) == order(expected(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_forest_joins_in_descending_depth():
    trees = prefix_trie.Forest([2, 3, 3, 2, 4], [-1, 2, 1, 2, 0])
    # 0: ab, 1: abc, 2: axy, 3: ax: equal depths join, deeper runs hang below
    assert trees.parent[1] == 0 and trees.depth[trees.parent[0]] == 1
    assert sorted(trees.depth[k] for k in trees.alive) == [0, 1, 2, 2, 3, 3, 4]


def test_trie_of_odd_rows(spark):
    rows = [(1, None, None, "first"), (1, 0, "user", None), (6, None, None, "first"), (5, 3, "user", ""), (None, 1, "user", "nobody"), (-3, 1, "user", "x" * 100_000), (-5, 1, "system", "a"), (2, 1, "user", "only")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert order(tuple(r) for r in prefix_trie.prefix_trie(df).collect()) == order(expected(rows))
    assert prefix_trie.prefix_trie(df.limit(0)).collect() == []
    assert prefix_trie.prefix_trie(df.filter("conv_id IS NULL")).collect() == []
    # repeated rows are further turns, whatever the order in which they come
    twice = spark.createDataFrame([(7, 1, "user", "a", "x", 1)] * 8 + [(7, 0, "b", "c", "x", 1)], SCHEMA)
    assert max(r.depth for r in prefix_trie.prefix_trie(twice).collect()) == max(0, 9 - zlib.crc32(b"7") % 9)


def test_trie_leaves_only_its_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "named_folder", lambda spark: str(tmp_path))
    df = spark.createDataFrame([(*r, "clash", 1) for r in talks(0, 20)], SCHEMA)
    result = prefix_trie.prefix_trie(df)
    assert len(list(tmp_path.iterdir())) == 1 and result.count() > 20
