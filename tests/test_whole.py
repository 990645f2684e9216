"""Queries that must look at whole tables and whole rows, against plain calculations."""

import hashlib
import math
import re
from collections import Counter

import numpy as np

from marlpit.operators import features
from marlpit.plans import catalogue
from marlpit.plans.base import table


def test_edges_of_the_whole_tree_are_checked(spark, small):
    parts = {r.p_partkey for r in table(spark, small, "part").collect()}
    up = {k: {k // 2} for k in parts if k > 1 and k % 7}
    for k in parts:
        if k % 101 == 2 and 2 * k in parts:
            up.setdefault(k, set()).add(2 * k)
    items = {k for k in parts if k % 11 != 3}
    parents = set().union(*up.values())

    def above(k):
        seen, left = set(), [k]
        while left:
            new = up.get(left.pop(), set()) - seen
            seen |= new
            left += new
        return seen

    ancestors = {k: above(k) for k in up}
    inside = {k for k in up if k in ancestors[k]}
    expected = {("unknown_parent", k) for k in parents - items} | {("orphan", k) for k in items - set(up) - parents}
    expected |= {("cycle", k) for k in up if k in inside or ancestors[k] & inside}
    found = [(r.check, r.item) for r in catalogue.QUERIES["edge_checks_whole"](spark, small).collect()]
    assert set(found) == expected and len(found) == len(expected)
    assert max(k for _, k in found) > len(parts) / 2 > 100


def test_index_of_clusters_by_all_dimensions(spark, tiny):
    rows = table(spark, tiny, "embeddings").select("label", "embedding").collect()
    x, label = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])
    assert x.shape[1] == 64
    groups = [x[label == v] for v in np.unique(label)]
    between = sum(len(g) * ((g.mean(0) - x.mean(0)) ** 2).sum() for g in groups)
    within = sum(((g - g.mean(0)) ** 2).sum() for g in groups)
    found = catalogue.QUERIES["calinski_harabasz_whole"](spark, tiny).first()
    assert found.n_clusters == len(groups)
    assert abs(found.calinski_harabasz - (between / (len(groups) - 1)) / (within / (len(x) - len(groups)))) < 1e-3


def test_weights_of_terms(spark):
    texts = {1: "The cat, the dog", 2: "the bird", 3: "", 4: None, 5: " ".join(f"w{k}" for k in range(3000)), None: "a row without key"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    counts = {k: Counter(w for w in re.split(r"\W+", (t or "").lower()) if w) for k, t in texts.items()}
    tf = {k: Counter() for k in counts}
    for k, c in counts.items():
        for w, n in c.items():
            tf[k][int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % (1 << 18)] += n
    n_docs = Counter(b for c in tf.values() for b in c)
    rows = features.term_weights(df, "text", "doc_id").collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = {b: n * math.log((len(texts) + 1) / (n_docs[b] + 1)) for b, n in tf[r.doc_id].items()}
        assert r.buckets == sorted(expected) and r.counts == [tf[r.doc_id][b] for b in r.buckets]
        assert np.allclose(r.tfidf, [expected[b] for b in r.buckets], atol=1e-9)
    assert next(len(r.buckets) for r in rows if r.doc_id == 5) > 2950
