"""From band keys to components, with DataFrame operations alone.

Items that share a band key are candidates. A bucket (all items of one key) is never turned into all its pairs:
its items are held against one representative each, exact links are joined into components, and buckets whose
items are in one component are done. Of the items in other buckets those drop out that can't have a link to any, as
too many of their elements are in no other such item; buckets that are still open get another representative, the
item with most links. What then still lies in different components is held against each other in blocks, inside a
join whose condition has an upper bound of the similarity and the sketch estimate, so that only likely pairs come out of it: first, for
as long as it pays, only within small blocks that are dealt anew each turn, as few links join most of a large group of near copies, and
at last block against block. Nothing is capped; every candidate pair of
different components has been tested in the end.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.llm.tables import BROADCAST_ROWS, FAST_GROUPS, scope, setting, written

#: Rows of a bucket that one task holds against as many others; a bucket of n rows is copied n / BLOCK times for that, so this bounds what is shuffled.
BLOCK = 2048
#: Rows of a bucket that are held against each other in a turn before all are; turns go on while there is a link for each so many open items.
PART, WORTH = 64, 20
#: Pairs of whole sets that a task compares.
COMPARED = 1_000
#: A task's groups, as a power of two, while keys are made of many elements to an item: 12 for each of some 80,000 items.
GROUPS_BIT = "20"
#: Longs of an odd sketch, and all columns that bounds are made of.
PARITIES = tuple(f"q{k}" for k in range(16))
BOUNDS = ("size", "shared", *PARITIES)


class Sketches(NamedTuple):
    """``keyed``: (id, key), a row for each band key of each item; read once. ``frame``: id and sketch columns, of which ``likely``
    takes two functions from a column's name to its value on either side, and says whether the pair may reach the
    threshold; without columns every pair may. ``items`` makes the array of a set's distinct values from the column that
    ``sets_of`` gives. ``dealt``: the keys come out of a shuffle of their items, whose files are to be gone before the keys are shuffled."""

    keyed: DataFrame
    frame: DataFrame | None = None
    columns: tuple[str, ...] = ()
    likely: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None
    items: Callable[[str], Column] = F.col
    dealt: bool = False


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is known to have few rows; without one otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame, spark_ids: tuple[str, str] = ("a", "b"), rows: int | None = None) -> DataFrame:
    """(id, component) of every id in ``edges``: the least id reachable. Distributed union-find.

    Each turn takes the least label among neighbours, then the label of that label, so that long chains
    shrink by half. Ends when no label changes; only the last labels are left. ``rows``: how many edges there are at most.
    """
    with scope(edges.sparkSession) as result:
        a, b = spark_ids
        pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        ends = None if rows is None else 2 * rows
        both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), ends)
        ends = both.count()
        labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("component")), ends)
        small = 2 * labels.count()
        while True:
            near = both.join(few(labels.withColumnRenamed("id", "b"), small), "b").groupBy("a").agg(F.min("component").alias("least")).withColumnRenamed("a", "id")
            lower = near.join(few(labels, small), "id").select("id", F.least("component", "least").alias("component"), F.col("component").alias("before"))
            above = labels.select(F.col("id").alias("component"), F.col("component").alias("jump"))
            new = lower.join(few(above, small), "component").select("id", F.least("component", "jump").alias("component"), "before")
            new = written(new, ends)
            labels = new.select("id", "component")
            if new.filter("component < before").isEmpty():
                return result(labels, ends)


def link(sketches: Sketches, sets_of: Callable[[DataFrame, int], DataFrame], numerator: int = 75, denominator: int = 100) -> DataFrame:
    """(id, component) of every item that has a link; items without one are left out.

    ``sets_of(ids, rows)`` gives (id, items) for a table of distinct ids; ``sketches.items`` of it is an array of distinct values. Two
    items are linked if ``denominator`` * common >= ``numerator`` * united.
    """
    bucket = Window.partitionBy("key")
    with scope(sketches.keyed.sparkSession) as result:
        keyed = sketches.keyed
        if sketches.dealt:
            with setting(keyed.sparkSession, FAST_GROUPS, GROUPS_BIT):
                keyed = written(keyed)
        # keys of one item, which most are, go here
        shared = result(keyed.select("id", "key", F.min("id").over(bucket).alias("low"), F.max("id").over(bucket).alias("high"), F.count("*").over(bucket).alias("n")).filter("low < high"))
    members = shared.filter("n > 2").select("key", "id", "low")
    n_larger = members.count()
    stars = shared.filter("id > low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    tried = written(_likely(stars.distinct(), sketches))
    n_tried = tried.count()
    links = _confirmed(tried, n_tried, sets_of, sketches.items, numerator, denominator)
    n_links = links.count()
    labels = components(links, rows=n_links) if n_links else None
    if not n_larger:
        return labels if labels is not None else _none(shared)
    open_ = _open(members, n_larger, labels)
    ids = written(open_.select("id").distinct(), n_larger)
    rows = ids.count()
    if not rows:
        return labels if labels is not None else _none(shared)
    sets = written(sets_of(ids, rows))
    with setting(sets.sparkSession, FAST_GROUPS, GROUPS_BIT):
        bounds = written(_bounds(sets.select("id", sketches.items("items").alias("items"))), rows)
    # an item of which too much is in no other open item can't have a link
    hopeful = bounds.filter(denominator * F.col("shared") >= numerator * F.col("size"))
    members = written(open_.select("key", "id").join(few(hopeful, (1 + len(BOUNDS)) * rows), "id"), n_larger)
    n_members = members.count()

    def again(wanted: DataFrame, n: int) -> DataFrame:
        return sets.join(few(wanted, n), "id", "left_semi")

    def tested(pairs: DataFrame) -> int:
        """Confirms those of the pairs that are new; gives how many of them are links."""
        nonlocal tried, n_tried, links, n_links, labels
        fresh = written(pairs.join(few(tried, 2 * n_tried), ["a", "b"], "left_anti"))
        n_fresh = fresh.count()
        more = _confirmed(fresh, n_fresh, again, sketches.items, numerator, denominator)
        found = more.count() if n_fresh else 0
        tried, n_tried = tried.unionByName(fresh), n_tried + n_fresh
        if found:
            links, n_links = links.unionByName(more), n_links + found
            labels = components(links, rows=n_links)
        return found

    # whichever turns there are, all candidate pairs of different components have been tested in the end
    for _ in range(2):  # other representatives, for buckets whose items are not together yet
        open_ = _open(members, n_members, labels)
        degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
        ranked = open_.join(few(degree, 4 * n_links), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        chosen = ranked.groupBy("key").agg(F.max(F.struct("degree", F.bitwise_not("id").alias("order"), "component", *BOUNDS)).alias("r"))
        chosen = chosen.select("key", F.bitwise_not(F.col("r.order")).alias("to"), F.col("r.component").alias("to_component"), *(F.col(f"r.{c}").alias(f"to_{c}") for c in BOUNDS))
        apart = (F.col("component") != F.col("to_component")) & _possible("", "to_", numerator, denominator)
        pairs = open_.join(chosen.withColumnRenamed("key", "to_key"), (F.col("key") == F.col("to_key")) & apart).select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"))
        if WORTH * tested(_likely(pairs.distinct(), sketches)) < rows:
            break
    for turn in count():
        open_ = _open(members, n_members, labels)
        if turn:  # smaller buckets are done with the first turn
            open_ = open_.filter(F.col("in_bucket") > PART)
        if WORTH * tested(_within(open_, n_members, sketches, turn, numerator, denominator)) < rows:
            break
    wide = _open(members, n_members, labels).filter(F.col("in_bucket") > PART)
    if not wide.isEmpty():
        tested(_across(wide, sketches, numerator, denominator))
    return labels if labels is not None else _none(shared)


def _bounds(sets: DataFrame) -> DataFrame:
    """(id, size, shared and parities): how many elements a set has, how many of them are in another set of the table
    too, and an odd sketch: for each of 1024 places whether an odd number of elements falls there."""
    # outer, or Spark would add a filter on the array's size, which builds each set again
    items = sets.select("id", F.explode_outer("items").alias("item")).filter("item is not null")
    alone = items.groupBy("item").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1")
    own = alone.groupBy("id").agg(F.count("*").alias("own"))
    place = F.pmod(F.xxhash64("item"), F.lit(64 * len(PARITIES)))
    put = items.withColumn("place", place).select("id", F.expr("place div 64").alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit"))
    odd = put.groupBy("id").agg(F.count("*").alias("size"), *(F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(q) for k, q in enumerate(PARITIES)))
    return odd.join(own, "id", "left").withColumn("shared", F.col("size") - F.coalesce("own", F.lit(0))).drop("own")


def _possible(a: str, b: str, numerator: int, denominator: int) -> Column:
    """Whether two sets could reach the threshold, by bounds that no link breaks: they can't have more in common than
    either shares with any set, and differ in at least as many elements as their odd sketches do in places."""
    most = F.least(f"{a}shared", f"{b}shared")
    sizes = F.col(f"{a}size") + F.col(f"{b}size")
    differ = F.lit(0)
    for q in PARITIES:
        differ = differ + F.bit_count(F.col(f"{a}{q}").bitwiseXOR(F.col(f"{b}{q}")))
    return (denominator * most >= numerator * (sizes - most)) & ((denominator + numerator) * differ <= (denominator - numerator) * sizes)


def _none(keyed: DataFrame) -> DataFrame:
    return keyed.select("id", F.col("id").alias("component")).limit(0)


def _open(members: DataFrame, rows: int, labels: DataFrame | None) -> DataFrame:
    """Members, of which there are ``rows``, of buckets whose items lie in more than one component, with component and in_bucket, the bucket's size."""
    if labels is not None:
        own = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    else:
        own = members.withColumn("component", F.col("id"))
    own = written(own, rows)
    apart = own.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("in_bucket")).filter("c0 < c1")
    return written(own.join(apart.select("key", "in_bucket"), "key"), rows)


def _likely(pairs: DataFrame, sketches: Sketches) -> DataFrame:
    """Pairs (a, b) whose sketches say that they may reach the threshold."""
    if not sketches.columns:
        return pairs
    one = sketches.frame.select(F.col("id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in sketches.columns))
    two = sketches.frame.select(F.col("id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in sketches.columns))
    held = pairs.join(one, "a").join(two, "b")
    return held.filter(sketches.likely(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))).select("a", "b")


def _within(open_: DataFrame, rows: int, sketches: Sketches, turn: int, numerator: int, denominator: int) -> DataFrame:
    """Likely pairs (a, b) of items in different components of one bucket, within blocks of about PART rows that are dealt by ``turn``."""
    blocks = F.ceil(F.col("in_bucket") / PART).cast("int")
    dealt = open_.withColumn("own", F.pmod(F.xxhash64("id", "key", F.lit(turn)), blocks).cast("int"))
    return _pairs(written(_sketched(dealt, sketches).withColumns({"x": F.col("own"), "y": F.col("own")}), rows), sketches, numerator, denominator)


def _across(open_: DataFrame, sketches: Sketches, numerator: int, denominator: int) -> DataFrame:
    """Likely pairs (a, b) of items in different components of one bucket, block against block."""
    blocks = F.ceil(F.col("in_bucket") / BLOCK).cast("int")
    dealt = written(_sketched(open_, sketches).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id", "key"), blocks).cast("int")))
    # each item goes to the pairs of blocks that its own is in
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return _pairs(spread.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")), sketches, numerator, denominator)


def _sketched(open_: DataFrame, sketches: Sketches) -> DataFrame:
    return open_.join(sketches.frame.select("id", *sketches.columns), "id") if sketches.columns else open_


def _pairs(spread: DataFrame, sketches: Sketches, numerator: int, denominator: int) -> DataFrame:
    """Likely pairs (a, b) in different components among rows of one key, x and y; those of two blocks once."""
    one = spread.select(F.col("key").alias("a_key"), "x", "y", *(F.col(c).alias(f"a_{c}") for c in BOUNDS), F.col("id").alias("a"), F.col("component").alias("a_component"), F.col("own").alias("a_own"), *(F.col(c).alias(f"a_{c}") for c in sketches.columns))
    two = spread.select(F.col("key").alias("b_key"), F.col("x").alias("b_x"), F.col("y").alias("b_y"), *(F.col(c).alias(f"b_{c}") for c in BOUNDS), F.col("id").alias("b"), F.col("component").alias("b_component"), F.col("own").alias("b_own"), *(F.col(c).alias(f"b_{c}") for c in sketches.columns))
    apart = (F.col("a") < F.col("b")) & (F.col("a_component") != F.col("b_component")) & ((F.col("x") == F.col("y")) | (F.col("a_own") != F.col("b_own")))
    likely = sketches.likely(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")) if sketches.columns else F.lit(True)
    same = (F.col("a_key") == F.col("b_key")) & (F.col("x") == F.col("b_x")) & (F.col("y") == F.col("b_y"))
    return one.join(two, same & apart & _possible("a_", "b_", numerator, denominator) & likely).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, n: int, sets_of: Callable[[DataFrame, int], DataFrame], items: Callable[[str], Column], numerator: int, denominator: int) -> DataFrame:
    """Those of ``n`` pairs whose whole sets reach the threshold, written; the sets are deleted."""
    if not n:
        return pairs.limit(0)
    with scope(pairs.sparkSession) as result:
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), 2 * n)
        rows = ids.count()
        sets = written(sets_of(ids, rows))
        one, two = (sets.select(F.col("id").alias(x), F.col("items").alias(f"{x}_items")) for x in "ab")
        held = pairs.join(one, "a").join(two, "b")
        held = held.select("a", "b", F.inline(F.array(F.struct(items("a_items").alias("one"), items("b_items").alias("two")))))
        common = F.size(F.array_intersect("one", "two")).cast("bigint")
        sizes = F.size("one") + F.size("two")
        # one number comes out of the generator, so that the filter doesn't build the sets again
        held = held.select("a", "b", F.inline(F.array(F.struct(common.alias("common"), sizes.alias("sizes")))))
        return result(held.filter(denominator * F.col("common") >= numerator * (F.col("sizes") - F.col("common"))).select("a", "b"), n, COMPARED)
