"""Dependency tables, as edges (child, parent): closure, layers and checks, each by joins that repeat until nothing is new.

Each turn's tables are written to the checkpoint folder that the session names, so that plans don't grow and lost executors cost one turn only.
Tables that grow with the edges are never sent through the driver: a turn's joins shuffle, however small the turn, as what is broadcast adds up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.sources.scratch import kept, new_folder, scratch


class CycleError(ValueError):
    """Raised where an order is asked of items that depend on each other in a circle."""


def cut(df: DataFrame) -> DataFrame:
    """The table, its lineage ended in the checkpoint folder; a temporary folder where a session on one machine names none."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or new_folder(spark, "checkpoint"))
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """The table, to be joined by a shuffle."""
    return df.hint("merge")


def edges_of(models: DataFrame, item: str = "model_id", parents: str = "depends_on") -> DataFrame:
    """(child, parent) of a table with an array of parents."""
    return models.select(F.col(item).alias("child"), F.explode(parents).alias("parent"))


def closure(edges: DataFrame, start: DataFrame | None = None, transitive: bool = True) -> DataFrame:
    """(item, ancestor) of all pairs, or of the items in ``start`` (one column) only. Circles end by themselves.

    Each turn joins the pairs found last to all that are known, or to the edges where only some items are asked for, and keeps
    what wasn't known. For all items the ways that are covered double in length each turn; pairs found earlier aren't written again.
    """
    own = cut(edges.select(F.col("child").alias("item"), F.col("parent").alias("ancestor")).filter("item is not null and ancestor is not null").distinct())
    new = own if start is None else cut(own.join(shuffled(start.select(F.col(start.columns[0]).alias("item"))), "item", "left_semi"))
    parts = [new]
    while transitive:
        known = reduce(DataFrame.unionByName, parts)
        above = (known if start is None else own).select(F.col("item").alias("ancestor"), F.col("ancestor").alias("above"))
        found = new.join(shuffled(above), "ancestor").select("item", F.col("above").alias("ancestor")).distinct()
        new = cut(found.join(shuffled(known), ["item", "ancestor"], "left_anti"))
        if new.isEmpty():
            break
        parts.append(new)
    return reduce(DataFrame.unionByName, parts)


def upstream(edges: DataFrame, item, transitive: bool = True) -> DataFrame:
    """(item): what the item depends on."""
    spark = edges.sparkSession
    start = spark.range(1).select(F.lit(item).alias("item"))
    return closure(edges, start, transitive).select(F.col("ancestor").alias("item"))


def downstream(edges: DataFrame, item, transitive: bool = True) -> DataFrame:
    """(item): what depends on the item."""
    turned = edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return upstream(turned, item, transitive)


def layers(edges: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(item, layer): the longest way to the item from one without parents, which is in layer 0.

    A layer is all items left whose parents are in earlier ones. Raises :class:`CycleError` if none can be next.
    """
    own = cut(edges.select("child", "parent").filter("child is not null and parent is not null").distinct())
    named = own.select(F.col("child").alias("item")).unionByName(own.select(F.col("parent").alias("item")))
    if items is not None:
        named = named.unionByName(items.select(F.col(items.columns[0]).alias("item")))
    left, n, out = cut(named.filter("item is not null").distinct()), 0, None
    while not left.isEmpty():
        blocked = own.join(shuffled(left.select(F.col("item").alias("parent"))), "parent", "left_semi").select(F.col("child").alias("item")).distinct()
        ready = cut(left.join(shuffled(blocked), "item", "left_anti"))
        if ready.isEmpty():
            raise CycleError("items depend on each other in a circle")
        now = ready.withColumn("layer", F.lit(n))
        out = now if out is None else out.unionByName(now)
        left, n = cut(left.join(shuffled(ready), "item", "left_anti")), n + 1
    return out if out is not None else named.limit(0).withColumn("layer", F.lit(0))


def cyclic(edges: DataFrame) -> DataFrame:
    """(item): items in a circle, or below one.

    Those are the items that are left when items without parents are taken away again and again. Each turn drops the edges to such parents, and an
    item of one parent takes that one's parent instead if it has one only, as both stand or fall together: so chains halve in length, and a turn costs
    as much as the edges that are left. A ladder, in which each item has several parents, takes a turn for each of its steps.
    """
    with scratch(edges.sparkSession) as held:
        left = held(edges.select("child", "parent").filter("child is not null and parent is not null").distinct())
        size = left.count()
        # children of the whole table: an item that takes another parent stays a child
        while size:
            own = left.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("only"))
            above = own.select(F.col("child").alias("parent"), F.when(F.col("n") == 1, F.col("only")).alias("next"))
            left = held(left.join(shuffled(above), "parent").select("child", F.coalesce("next", "parent").alias("parent")).distinct())
            before, size = size, left.count()
            if size == before and left.join(shuffled(left.select(F.col("child").alias("parent"))), "parent", "left_anti").isEmpty():
                break
        return kept(left.select(F.col("child").alias("item")).distinct())


def edge_checks(edges: DataFrame, items: DataFrame) -> DataFrame:
    """(check, item): parents that aren't items (``unknown_parent``), items without any edge (``orphan``), and those in or
    below a circle (``cycle``)."""
    known = items.select(F.col(items.columns[0]).alias("item")).distinct()
    unknown = edges.select(F.col("parent").alias("item")).distinct().join(shuffled(known), "item", "left_anti").withColumn("check", F.lit("unknown_parent"))
    touched = edges.select(F.col("child").alias("item")).unionByName(edges.select(F.col("parent").alias("item"))).distinct()
    orphan = known.join(shuffled(touched), "item", "left_anti").withColumn("check", F.lit("orphan"))
    return unknown.unionByName(orphan).unionByName(cyclic(edges).withColumn("check", F.lit("cycle"))).select("check", "item")
