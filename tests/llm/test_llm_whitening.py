"""Whitening against numpy on whole integers."""

from fractions import Fraction

import numpy as np
import pytest

from marlpit.llm import queries, tables, whitening

SCHEMA = "vec_id bigint, embedding array<double>, whitened string, label int"


def expected(vectors):
    """(x of each usable vector, fit list) by plain Python."""
    usable = {k: v for k, v in vectors.items() if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    dims = max(map(len, usable.values()), default=0)
    xs = {k: tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) + (1_000_000,) * (dims - len(v)) for k, v in usable.items()}
    return xs, sorted(set(xs.values()))


def exact_covariance(fit):
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    return sums, [[float(Fraction(sum((n * x[d] - sums[d]) * (n * x[e] - sums[e]) for x in fit), n**3)) for e in range(dims)] for d in range(dims)]


def test_products_of_planes_are_exact():
    draw = np.random.default_rng(1)
    for bits in ([7, 0, 3, 1], [40, 62, 5], [0, 0]):
        x = np.stack([draw.integers(0, 2**b, 777, dtype=np.uint64) if b else np.zeros(777, np.uint64) for b in bits], axis=1)
        found = whitening.products(whitening.planes_of(x, bits), bits)
        whole = x.astype(object)
        for d in range(len(bits)):
            for e in range(d, len(bits)):
                assert int(found[d, e]) == sum(whole[:, d] * whole[:, e])


def test_limbs_give_the_number_again():
    for v in (0, 1, -1, 2**63, -(2**63), 2**150 + 12345, -(2**140) + 7):
        assert whitening.whole(whitening.limbs(v)) == v


def test_whitening_of_embeddings(spark, tiny):
    vectors = {r.vec_id: r.embedding for r in queries.table(spark, tiny, "embeddings").collect()}
    xs, fit = expected(vectors)
    sums, covariance = exact_covariance(fit)
    values, directions = np.linalg.eigh(np.array(covariance))
    values, directions = values[::-1], directions[:, ::-1]
    rows = queries.op11_whitening(spark, tiny).collect()
    assert len(rows) == 16 * len(xs)
    assert {r.component for r in rows} == set(range(1, 17)) and {r.n for r in rows} == {len(fit)}
    assert max(r.identity_error for r in rows) < 1e-9
    n = len(fit)
    found = {}
    for r in rows:
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(xs[r.vec_id], sums, strict=True))
        assert r.explained == pytest.approx(values[r.component - 1] / sum(values), rel=1e-9)
        found[r.vec_id, r.component] = r.whitened
    ids = sorted(xs)
    for k in range(1, 17):
        ours = np.array([found[i, k] for i in ids])
        theirs = (np.array([xs[i] for i in ids]) - np.array(sums) / n) @ directions[:, k - 1] / np.sqrt(values[k - 1])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-7


def test_whitening_of_odd_rows(spark):
    draw = np.random.default_rng(2)
    vectors = {k: draw.normal(size=3).tolist() for k in range(30)}
    vectors |= {30: None, 31: [1.0, None, 2.0], 32: [1.0, float("nan"), 0.0], 33: [float("inf"), 0.0, 0.0], 34: vectors[0], 35: [0.5], 36: [], 37: [1e300, -1e300, 1.0]}
    df = spark.createDataFrame([(k, v, "clash", k) for k, v in vectors.items()] + [(None, vectors[1], "clash", 0)] * 2, SCHEMA)
    model = whitening.fit(df)
    rows = whitening.whiten(df, model).collect()
    assert sorted(r.vec_id if r.vec_id is not None else -1 for r in rows) == sorted([-1, -1, *range(30), 34, 35, 36, 37])
    assert whitening.whiten(df, model).columns == ["vec_id", "embedding", "label", "deviation", "whitened"]
    most = 2**63 - 1 - 1_000_000
    xs = {k: tuple(max(-(2**63), min(int(np.floor(64 * c)) if abs(c) < 1e200 else int(np.sign(c)) * 2**63, most)) + 1_000_000 for c in v) + (1_000_000,) * (3 - len(v)) for k, v in vectors.items() if k not in (30, 31, 32, 33)}
    fit = sorted(set(xs.values()))
    assert model.n == len(fit) == 33
    sums = [sum(x[d] for x in fit) for d in range(3)]
    assert model.sums == sums
    for r in rows:
        if r.vec_id is not None:
            exact = sum((model.n * c - s) ** 2 for c, s in zip(xs[r.vec_id], sums, strict=True))
            assert (r.deviation is None and exact >= 10**38) or int(r.deviation) == exact


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(k, [0.25, 0.5], "x", 0) for k in range(5)], SCHEMA)
    model = whitening.fit(same)
    assert (model.n, model.explained, model.identity_error) == (1, [None, None], None)
    assert {(int(r.deviation), tuple(r.whitened)) for r in whitening.whiten(same, model).collect()} == {(0, (None, None))}
    line = spark.createDataFrame([(k, [float(k), float(k)], "x", 0) for k in range(5)], SCHEMA)
    model = whitening.fit(line)
    assert model.explained == [pytest.approx(1), 0.0] and model.identity_error < 1e-9
    assert all(r.whitened[1] is None for r in whitening.whiten(line, model).collect())
    for empty in (same.limit(0), spark.createDataFrame([(1, None, "x", 0)], SCHEMA), spark.createDataFrame([(1, [], "x", 0)], SCHEMA)):
        model = whitening.fit(empty)
        assert model.dims == 0
        assert all(list(r.whitened) == [] for r in whitening.whiten(empty, model).collect())


def test_nothing_is_left_behind(spark, tiny, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "named_folder", lambda spark: str(tmp_path))
    whitening.fit(queries.table(spark, tiny, "embeddings"))
    assert list(tmp_path.iterdir()) == []
