"""Very many small models in one job each: all groups of a table are fitted together by aggregates, never one after another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.scalar import bin_of, col, number
from marlpit.sources.scratch import kept, scratch

#: Rows that may be sent to every executor.
BROADCAST_ROWS = 1_000_000


def linear_models(df: DataFrame, model: str, features: list[str], target: str) -> DataFrame:
    """(model, n, intercept, weights, r2): least squares of each group, from one aggregate of its moments.

    Rows that lack the target or a feature are left out. Moments are centred as they are summed. A group whose features don't determine
    the weights gets the shortest ones that fit as well; of one row, or equal targets, ``r2`` is null. A very large group is summed by many tasks.
    """
    x, y = [F.col(f"_x{k}") for k in range(len(features))], F.col("_y")
    own = df.select(col(model).alias("_m"), number(target).alias("_y"), *(number(f).alias(f"_x{k}") for k, f in enumerate(features))).dropna(subset=["_y", *(f"_x{k}" for k in range(len(features)))])
    upper = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    moments = own.groupBy("_m").agg(
        F.count("*").alias("n"), F.avg(y).alias("my"), F.var_pop(y).alias("vy"), F.array(*map(F.avg, x)).alias("mx"), F.array(*(F.covar_pop(c, y) for c in x)).alias("cy"), F.array(*(F.covar_pop(x[i], x[j]) for i, j in upper)).alias("cx")
    )

    @F.arrow_udf("weights array<double>, explained double")
    def solved(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        p = len(features)
        i, j = (np.array([u[k] for u in upper]) for k in (0, 1))
        for cy, cx in batches:
            right = cy.flatten().to_numpy(zero_copy_only=False).reshape(len(cy), p)
            square = np.zeros((len(cy), p, p))
            square[:, i, j] = square[:, j, i] = cx.flatten().to_numpy(zero_copy_only=False).reshape(len(cy), len(upper))
            weights = np.einsum("nij,nj->ni", np.linalg.pinv(square, rcond=1e-12, hermitian=True), right)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, weights.size + 1, p, dtype=np.int32)), pa.array(weights.ravel()))
            yield pa.StructArray.from_arrays([flat, pa.array((weights * right).sum(axis=1))], ["weights", "explained"])

    held = moments.withColumn("_s", solved("cy", "cx"))
    centre = F.aggregate(F.zip_with(F.col("_s.weights"), F.col("mx"), lambda w, m: w * m), F.lit(0.0), lambda a, v: a + v)
    return held.select(F.col("_m").alias(model), "n", (F.col("my") - centre).alias("intercept"), F.col("_s.weights").alias("weights"), F.when(F.col("vy") > 0, F.col("_s.explained") / F.col("vy")).alias("r2"))


def _edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Inner ends of each feature's bins over all groups, every one a value of the feature."""
    row = df.agg(*(F.percentile_approx(number(f), [k / bins for k in range(1, bins)], 10_000).alias(f"e{k}") for k, f in enumerate(features)), *(F.min(number(f)).alias(f"m{k}") for k, f in enumerate(features))).first()
    return [sorted(set(row[f"e{k}"] or []) - {row[f"m{k}"]}) for k in range(len(features))]


def grouped_trees(df: DataFrame, model: str, features: list[str], target: str, depth: int = 2, bins: int = 32, least_rows: int = 1) -> DataFrame:
    """(model, features, thresholds, values): a regression tree for each group, grown level by level for all groups at once.

    Nodes are numbered from 1, the children of k are 2k (feature below the threshold) and 2k + 1; ``features`` is -1 where a node isn't
    split, ``values`` the mean of its rows, null for nodes that there aren't. A node takes the split of the greatest gain (first feature, then lowest threshold of
    equal ones) if it has a gain and leaves ``least_rows`` on either side. Thresholds are quantiles of all rows, values themselves where a feature has
    at most ``bins``. Missing features count as the lowest, rows without a target are left out.

    Each level is one aggregate of counts and sums by group, node, feature and bin, so that neither many groups nor a very large one
    comes to one task; rows themselves are written once a level.
    """
    edges = _edges(df, features, bins)
    spark = df.sparkSession
    with scratch(spark) as held:
        places = [F.coalesce(bin_of(number(f), F.array(*map(F.lit, e)).cast("array<double>")), F.lit(0)).cast("int") for f, e in zip(features, edges, strict=True)]
        rows = held(df.select(col(model).alias("_m"), number(target).alias("_y"), F.array(*places).alias("_b")).filter("_y is not null").withColumn("_node", F.lit(1)))
        nodes, splits = held(rows.groupBy("_m", "_node").agg(F.count("*").alias("n"), F.sum("_y").alias("s"))), None
        parts = [nodes]
        for _ in range(depth):
            cells = rows.select("_m", "_node", "_y", F.posexplode("_b").alias("f", "b")).groupBy("_m", "_node", "f", "b").agg(F.count("*").alias("n"), F.sum("_y").alias("s"))
            inside = Window.partitionBy("_m", "_node", "f")  # a row for each bin
            upto = inside.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
            run = cells.select("_m", "_node", "f", "b", F.sum("n").over(upto).alias("nl"), F.sum("s").over(upto).alias("sl"), F.sum("n").over(inside).alias("n"), F.sum("s").over(inside).alias("s"), F.lead("b").over(inside.orderBy("b")).alias("next"))
            run = run.filter("next is not null").select("*", (F.col("n") - F.col("nl")).alias("nr"), (F.col("s") - F.col("sl")).alias("sr")).filter((F.col("nl") >= least_rows) & (F.col("nr") >= least_rows))
            gain = F.col("sl") * F.col("sl") / F.col("nl") + F.col("sr") * F.col("sr") / F.col("nr") - F.col("s") * F.col("s") / F.col("n")
            # the threshold is the lowest value of the bin that follows
            best = run.withColumn("gain", gain).filter("gain > 0").groupBy("_m", "_node").agg(F.max(F.struct("gain", (-F.col("f")).alias("nf"), (-F.col("b")).alias("nb"), "next")).alias("w"))
            new = held(best.select("_m", "_node", (-F.col("w.nf")).alias("f"), F.col("w.next").alias("b")))
            splits = new if splits is None else splits.unionByName(new)
            small = F.broadcast(new) if new.count() <= BROADCAST_ROWS else new
            # rows of nodes that aren't split go no further
            rows = held(rows.join(small, ["_m", "_node"]).select("_m", "_y", "_b", (2 * F.col("_node") + (F.get("_b", F.col("f")) >= F.col("b")).cast("int")).alias("_node")))
            parts.append(held(rows.groupBy("_m", "_node").agg(F.count("*").alias("n"), F.sum("_y").alias("s"))))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        size = 1 << depth + 1
        value = F.map_from_entries(F.collect_list(F.struct("_node", (F.col("s") / F.col("n")).alias("v"))))
        leaves = every.groupBy("_m").agg(value.alias("v"))
        flat = F.array(*(F.array(*map(F.lit, e)).cast("array<double>") for e in edges))
        chosen = F.map_from_entries(F.collect_list(F.struct("_node", F.struct("f", F.get(F.get(flat, F.col("f")), F.col("b") - 1).alias("t")).alias("w"))))
        made = leaves.join(splits.groupBy("_m").agg(chosen.alias("w")), "_m", "left") if splits is not None else leaves.withColumn("w", F.lit(None).cast("map<int,struct<f:int,t:double>>"))
        ids = F.sequence(F.lit(0), F.lit(size - 1))
        out = made.select(
            F.col("_m").alias(model),
            F.transform(ids, lambda k: F.coalesce(F.try_element_at("w", k)["f"], F.lit(-1))).alias("features"),
            F.transform(ids, lambda k: F.try_element_at("w", k)["t"]).alias("thresholds"),
            F.transform(ids, lambda k: F.try_element_at("v", k)).alias("values"),
        )
        return kept(out)


def tree_value(features: list[str], depth: int) -> Column:
    """The value at the node that a row comes to; the tree's columns stand beside the row's."""
    x = F.array(*(F.coalesce(number(f), F.lit(float("-inf"))) for f in features))
    right = lambda node: F.get(x, F.get("features", node)) >= F.get("thresholds", node)
    step = lambda node, _: F.when(F.get("features", node) < 0, node).otherwise(2 * node + right(node).cast("int"))
    return F.get("values", F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step)) if depth else F.get("values", F.lit(1))


def score_trees(df: DataFrame, model: str, key: str, features: list[str], trees: DataFrame, depth: int) -> DataFrame:
    """(model, key, prediction) of rows by their group's tree; null for groups without one."""
    small = F.broadcast(trees) if trees.count() * (1 << depth) <= BROADCAST_ROWS else trees
    given = df.select(col(model), col(key), *(number(f).alias(f"_x{k}") for k, f in enumerate(features)))
    held = given.join(small, model, "left")
    return held.select(col(model), col(key), tree_value([f"_x{k}" for k in range(len(features))], depth).alias("prediction"))
