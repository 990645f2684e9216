"""Search by successive halving: many parameter sets on few rows and trees, the better half of them on twice as many, and so on."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.functions.scalar import uniform
from marlpit.ml import training
from marlpit.sources.scratch import scratch

TRIALS = "rung int, trial int, parameters string, rows_share double, trees int, value double, promoted boolean"


class Halving(NamedTuple):
    """The winner, fitted on all rows; every fit as a row of ``TRIALS``; what the fits cost, as fits of all rows and trees."""

    model: Model
    parameters: dict
    value: float
    trials: DataFrame
    cost: float


def shares_of(rungs: int, eta: int) -> list[float]:
    return [float(eta) ** -(rungs - 1 - k) for k in range(rungs)]


def successive_halving(df: DataFrame, model_type: str, features: list[str], target: str | None, key: str, space: dict[str, list], trials: int = 8, rungs: int = 3, eta: int = 2, parallelism: int = 2) -> Halving:
    """The best parameter set of a sampled grid, by ``rungs`` rounds of which each keeps one in ``eta``.

    Round k fits each set that is left on a share of the rows and of its own trees (or turns), ``eta`` times as much as the round before and
    all of it in the last; values are those of a fifth of the rows that no round fits on. Rows are drawn by hash of the key, so a round's
    rows hold the round's before. Of equal values the set of fewer trees, then the earlier one, is the better. The budget is bounded by
    ``trials * rungs / eta^(2 * (rungs - 1))`` whole fits and what is left over from rounding up, whatever the values are.
    """
    kind, grid = training.category(model_type), training.sampled_grid(space, trials)
    if not grid:
        raise ValueError("there is no parameter set")
    spark, name = df.sparkSession, "max_iter" if kind == "clusterer" else "n_estimators"
    whole = {k: p.get(name, 20) for k, p in enumerate(grid)}
    with scratch(spark) as kept:
        data = kept(training._training_rows(df, features, target, key, 5, kind == "classifier").withColumn("_at", uniform(key)))
        held_out = data.filter("fold = 0")
        evaluator = ClusteringEvaluator() if kind == "clusterer" else training._evaluator(kind, "label")

        def value_of(model: Model) -> float:
            scored = model.transform(held_out)
            if kind == "clusterer" and scored.select("prediction").distinct().count() < 2:
                return -1.0
            return evaluator.evaluate(scored)

        left, rows, cost, values = list(range(len(grid))), [], 0.0, {}
        for rung, share in enumerate(shares_of(rungs, eta)):
            some = data.filter((F.col("fold") != 0) & (F.col("_at") < share))

            def tried(k: int, some: DataFrame = some, share: float = share) -> tuple[int, int, float]:
                trees = max(1, round(whole[k] * share))
                return k, trees, value_of(training.create(model_type, grid[k] | {name: trees}).fit(some))

            with ThreadPoolExecutor(parallelism) as pool:
                found = list(pool.map(inheritable_thread_target(spark)(tried), left))
            values = {k: v for k, _, v in found}
            ranked = sorted(left, key=lambda k: (-values[k], whole[k], k))
            better = set(ranked[: max(1, -(-len(left) // eta))]) if rung < rungs - 1 else {ranked[0]}
            rows += [(rung, k, json.dumps(grid[k], sort_keys=True), share, trees, float(v), k in better) for k, trees, v in found]
            cost += sum(share * trees / whole[k] for k, trees, _ in found)
            left = [k for k in left if k in better]
        best = left[0]
        model = training.create(model_type, grid[best]).fit(data)
        return Halving(model, grid[best], float(values[best]), spark.createDataFrame(rows, TRIALS), cost)
