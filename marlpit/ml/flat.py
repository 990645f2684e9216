"""Fitted ensembles and cluster centres as arrays, so that all models score a table in one pass over it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.functions.scalar import col, filled

#: Bytes of arrays that one pass sends to the executors, and rows that a task takes at once.
CHUNK_BYTES, ROWS = 64 << 20, 8192
LINE = re.compile(r"^( *)(?:(Tree \d+ \(weight (\S+)\):)|If \(feature (\d+) <= (\S+)\)|(Else) \(.*\)|Predict: (\S+))$")


class Trees(NamedTuple):
    """Nodes of all trees one after another: a leaf's ``feature`` is -1, its children itself. ``kind``: classifier or regressor."""

    kind: str
    roots: np.ndarray
    weights: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[rows, np.maximum(self.feature[node], 0)] <= self.threshold[node]
            node = np.where(low, self.left[node], self.right[node])
        # trees are added one after another, as the model itself does
        total = np.zeros(len(x))
        for k, w in enumerate(self.weights):
            total += self.value[node[:, k]] * w
        return total

    def score(self, x: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray | None]:
        raw = self.raw(x)
        if self.kind == "regressor":
            return raw, None, None
        return (raw > 0).astype(float), 1 / (1 + np.exp(-2 * raw)), None


class Centres(NamedTuple):
    places: np.ndarray

    def score(self, x: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray | None]:
        near = np.stack([((x - c) ** 2).sum(axis=1) for c in self.places])
        return None, None, near.argmin(axis=0)


def flat(model: Model) -> Trees | Centres | None:
    """The model's arrays; None for kinds that have none here (only boosted trees of numeric features, and centres, do)."""
    if hasattr(model, "clusterCenters"):
        return Centres(np.stack(model.clusterCenters()))
    if type(model).__name__ not in ("GBTClassificationModel", "GBTRegressionModel"):
        return None
    roots, weights, nodes = [], [], []
    open_: list[tuple[int, int]] = []  # (node, the child that comes next)
    for line in model.toDebugString.split("\n")[1:]:
        if not line.strip():
            continue
        m = LINE.match(line)
        if not m:
            return None
        if m[2]:
            weights.append(float(m[3]))
            roots.append(len(nodes))
            open_ = []
            continue
        if m[6]:
            continue
        me = len(nodes)
        nodes.append([int(m[4]) if m[4] else -1, float(m[5]) if m[5] else 0.0, me, me, float(m[7]) if m[7] else 0.0])
        if open_:
            parent, side = open_.pop()
            nodes[parent][2 + side] = me
            if side == 0:
                open_.append((parent, 1))
        if m[4]:
            open_.append((me, 0))
    columns = [np.array(c) for c in zip(*nodes, strict=True)]
    kind = "classifier" if "Classif" in type(model).__name__ else "regressor"
    depth = _depth(columns[2], columns[3], np.array(roots))
    return Trees(kind, np.array(roots), np.array(weights), columns[0].astype(int), columns[1].astype(float), columns[2].astype(int), columns[3].astype(int), columns[4].astype(float), depth)


def _depth(left: np.ndarray, right: np.ndarray, roots: np.ndarray) -> int:
    at, depth = roots.astype(int), 0
    while True:
        below = np.unique(np.concatenate([left[at], right[at]]).astype(int))
        below = below[~np.isin(below, at)]
        if not len(below):
            return depth
        at, depth = below, depth + 1


def chunks(models: dict[str, tuple], most: int = CHUNK_BYTES) -> list[dict[str, tuple]]:
    """Models in lots of at most so many bytes, or of one."""
    out: list[dict[str, tuple]] = []
    size = most + 1
    for name, (arrays, features) in models.items():
        own = sum(a.nbytes for a in arrays if isinstance(a, np.ndarray))
        if size + own > most:
            out.append({})
            size = 0
        out[-1][name] = (arrays, features)
        size += own
    return out


def score_flat(df: DataFrame, key: str, models: dict[str, tuple[Trees | Centres, list[str]]]) -> DataFrame:
    """(model_id, record_id, prediction, probability, cluster_id, error): every row by every model, missing features 0.

    One scan and one pass for all models of a lot; a lot's arrays are broadcast. Without models there are no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    fields = f"model_id string, record_id {kind}, prediction double, probability double, cluster_id int, error string"
    spark, out = df.sparkSession, None
    for lot in chunks(models):
        used = sorted({f for _, features in lot.values() for f in features})
        places = {f: k for k, f in enumerate(used)}
        sent = spark.sparkContext.broadcast({name: (arrays, [places[f] for f in features]) for name, (arrays, features) in lot.items()})

        def scored(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    n = part.num_rows
                    x = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]], axis=1)
                    for name, (arrays, own) in sent.value.items():
                        values = arrays.score(x[:, own])
                        kinds = pa.float64(), pa.float64(), pa.int32()
                        columns = [pa.nulls(n, t) if v is None else pa.array(v, t) for v, t in zip(values, kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), part.column(0), *columns, pa.nulls(n, pa.string())], ["model_id", "record_id", "prediction", "probability", "cluster_id", "error"])

        one = df.select(col(key).alias("_key"), *(filled(f).alias(f"_f{k}") for k, f in enumerate(used))).mapInArrow(scored, fields)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], fields)
