"""Exact quantiles by group, without a group's values in one task.

Approximate quantiles a little below and above each rank bracket its value. A count of what lies below the bracket says which place the rank
has inside it, and only the values inside are looked at: as distinct values with counts, so that a value of very many rows is one row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.scalar import col
from marlpit.sources.scratch import kept, scratch

#: Groups whose brackets may be sent to every executor: some hundred bytes each.
BROADCAST_GROUPS = 10_000
#: Approximate ranks are wrong by one in so many at most.
ACCURACY = 10_000
#: Half a bracket's share of ranks, for groups of at least so many rows: wider than that error and the two ranks next to a quantile; smaller groups are one bracket.
BRACKETS = ((200_000, 0.0005), (400, 0.01))


def exact_quantiles(rows: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """(by, quantiles): an array in the order of ``shares``, interpolated linearly between neighbours, for each group of (by, value).

    Missing values are left out; a group without values has no row. ``by`` columns must not be null. Rows are read three times, compared with the
    ends of brackets alone, and only those in one are shuffled: a thousandth for each share of a large group. Tables written on the way are deleted, and only the
    result's, a row for each group, is left.
    """
    with scratch(rows.sparkSession) as held:
        return kept(_exact_quantiles(rows, by, shares, held))


def _brackets(shares: list[float]) -> tuple[list[float], list[tuple[Column, Column]]]:
    """The shares that approximate quantiles are asked for, and each share's ends as columns of them (``_p``), ``_min``, ``_max`` and ``_n``."""
    points: list[float] = []
    ends = []
    for s in shares:
        low, high = F.col("_min"), F.col("_max")
        for least, half in reversed(BRACKETS):
            for side, end in ((s - half, "_min"), (s + half, "_max")):
                at = F.col(end)
                if 0 < side < 1:
                    at = F.col("_p")[len(points)]
                    points.append(side)
                if end == "_min":
                    low = F.when(F.col("_n") >= least, at).otherwise(low)
                else:
                    high = F.when(F.col("_n") >= least, at).otherwise(high)
        ends.append((low, high))
    return points or [0.5], ends


def _exact_quantiles(rows: DataFrame, by: list[str], shares: list[float], kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    given = rows.filter("value is not null").select(*(col(b) for b in by), F.col("value").cast("double").alias("value"))
    places = range(len(shares))
    points, ends = _brackets([float(s) for s in shares])
    found = given.groupBy(*by).agg(F.percentile_approx("value", points, ACCURACY).alias("_p"), F.min("value").alias("_min"), F.max("value").alias("_max"), F.count("*").alias("_n"))
    brackets = kept(found.select(*by, "_n", *(e.alias(f"_{side}{k}") for k in places for side, e in zip(("low", "high"), ends[k], strict=True))))
    groups = brackets.count()
    few = groups <= BROADCAST_GROUPS
    dealt = given.join(F.broadcast(brackets) if few else brackets, by)
    below = kept(dealt.groupBy(*by).agg(F.max("_n").alias("_n"), *(F.count_if(F.col("value") < F.col(f"_low{k}")).alias(f"_below{k}") for k in places)))
    inside = [F.col("value").between(F.col(f"_low{k}"), F.col(f"_high{k}")) for k in places]
    some = dealt.filter(reduce(lambda a, b: a | b, inside)).select(*by, "value", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in enumerate(inside))))).alias("_k"))
    counts = some.groupBy(*by, "_k", "value").agg(F.count("*").alias("_c"))
    up_to = Window.partitionBy(*by, "_k").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("_upto", F.sum("_c").over(up_to))
    asked = F.inline(F.array(*(F.struct(F.lit(k).alias("_k"), (F.lit(float(s)) * (F.col("_n") - 1)).alias("_at"), F.col(f"_below{k}").alias("_before")) for k, s in enumerate(shares))))
    ranks = below.select(*by, asked)
    ranks = ranks.select(*by, "_k", "_at", "_before", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank")).withColumn("_own", F.col("_rank") - F.col("_before"))
    held = summed.join(F.broadcast(ranks) if few else ranks, [*by, "_k"]).filter("_own < _upto and _own >= _upto - _c")
    ends_of = held.groupBy(*by, "_k").agg(F.min(F.struct("_rank", "value")).alias("lo"), F.max(F.struct("_rank", "value")).alias("hi"), F.first("_at").alias("_at"))
    value = F.col("lo.value") + (F.col("_at") - F.col("lo._rank")) * (F.col("hi.value") - F.col("lo.value"))
    each = ends_of.select(*by, F.struct("_k", value.alias("v")).alias("q"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("q")), lambda q: q["v"]).alias("quantiles"))
