"""The prefix trie of conversations, from sorted neighbours.

A turn is a digest of its role and text, and a conversation the key that its turns' digests make, so that sorted keys lay the
conversations of each trie node next to each other. Keys are dealt out by ranges. Within a range the edges between
neighbours, each with the number of turns they share, are taken in descending depth, and union-find joins the runs on either side: a join makes a
branching node, or adds to one of that depth. Nodes whose run touches the neighbouring range are contracted to a row of sums; those rows are merged
across ranges by node, which works because each node is counted as a child, as a leaf and with its bytes by one range alone.

A conversation of more than ``SEGMENT`` turns takes several rows, one below the other; the tries of later segments are made first
and hang on the nodes at which they begin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.llm.tables import BROADCAST_ROWS, scratch, written

#: Turns of a conversation that one row holds, and bytes of a digest.
SEGMENT, DIGEST = 4096, 16
#: Turns of one range of keys, about, and decimal ids of one row.
RANGE, IDS = 100_000, 50_000
#: Conversations in a block that share a beginning, and the most turns that they share.
BLOCK, SHARED = 5, 8

NONE = hashlib.sha256().hexdigest()
CLOSED, OPEN, TOP, ENDS = range(4)
ROWS = "kind int, prefix binary, depth bigint, conv_id bigint, parent binary, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, part int, chunk int"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
Kept = Callable[[DataFrame], DataFrame]


def digest_of(role: Column, text: Column) -> Column:
    """32 hexadecimal digits of a role and a text, told apart by the role's length."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)


def short(value: Column) -> Column:
    """The first bytes of a value's SHA-256."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 2 * DIGEST))


def numbered(turns: DataFrame, kept: Kept) -> DataFrame:
    """``turns`` (conv_id, turn, digest, size) with ``at``, from 1: by turn, nulls first, then digest.

    Turns are dealt out by ranges of that order, so that a conversation of very many turns lies in many tasks; the turns of
    one conversation in earlier ranges are added from a table that has at most one row for each range.
    """
    laid = kept(turns.repartitionByRange(F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = laid.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = counts.select("conv_id", "part", F.sum("n").over(before).alias("earlier")).filter("earlier > 0")
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    held = laid.withColumn("own", own).join(F.broadcast(earlier), ["conv_id", "part"], "left")
    return held.select("conv_id", (F.col("own") + F.coalesce("earlier", F.lit(0))).alias("at"), "digest", "size")


def rebuilt(turns: DataFrame, kept: Kept) -> tuple[DataFrame, DataFrame]:
    """(rows, convs): turns of each conversation as rebuilt (conv_id, at, digest, size), and its ``total`` of them.

    A conversation begins with the first ``crc32(conv_id) % 9`` turns of the first one of its block of five, and goes on with its own turns
    after as many.
    """
    own = kept(numbered(turns, kept))
    first = F.sort_array(F.collect_list(F.when(F.col("at") <= SHARED, F.struct("at", "digest", "size"))))
    each = kept(own.groupBy("conv_id").agg(F.count("*").alias("n"), first.alias("head")))
    head = each.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    shared = (F.crc32(F.col("conv_id").cast("string")) % (SHARED + 1)).cast("int")
    convs = each.select("conv_id", "n", shared.alias("shared"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    borrowed = F.coalesce(F.slice("base_head", 1, F.col("shared")), F.array().cast("array<struct<at:bigint,digest:string,size:bigint>>"))
    convs = convs.join(head, "base", "left").select("conv_id", "shared", borrowed.alias("borrowed"), F.greatest(F.col("n") - F.col("shared"), F.lit(0)).alias("rest"))
    convs = kept(convs.withColumn("total", F.size("borrowed") + F.col("rest")))
    begin = convs.select("conv_id", F.inline("borrowed"))
    lengths = convs.select("conv_id", "shared", F.size("borrowed").alias("n_borrowed"))
    rest = own.join(lengths, "conv_id").filter("at > shared").select("conv_id", (F.col("at") - F.col("shared") + F.col("n_borrowed")).alias("at"), "digest", "size")
    return begin.select("conv_id", F.col("at").cast("bigint").alias("at"), "digest", F.col("size").cast("bigint").alias("size")).unionByName(rest), convs.select("conv_id", "total")


def segments(rows: DataFrame, convs: DataFrame, kept: Kept, segment: int) -> DataFrame:
    """(conv_id, level, root, key, sizes, ends, next_root) of each run of ``segment`` turns, and of conversations without turns.

    ``root`` is a digest of all turns before, empty at level 0; ``ends`` says whether the conversation goes no further.
    """
    level = F.expr(f"(at - 1) div {segment}")
    own = rows.withColumn("level", level.cast("int")).groupBy("conv_id", "level").agg(F.sort_array(F.collect_list(F.struct("at", "digest", "size"))).alias("turns"))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    own = own.select("conv_id", "level", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    bare = convs.filter("total = 0").select("conv_id", F.lit(0).alias("level"), F.lit(b"").alias("key"), F.array().cast("array<bigint>").alias("sizes"))
    items = kept(own.unionByName(bare).join(convs, "conv_id").withColumn("ends", F.col("total") <= (F.col("level") + 1).cast("bigint") * segment).drop("total"))
    long = items.filter("NOT ends OR level > 0")
    chain = F.sort_array(F.collect_list(F.struct("level", short(F.col("key")).alias("own"))))
    next_root = lambda done, s: F.concat(done, F.array(short(F.concat(F.element_at(done, -1), s["own"]))))
    roots = F.aggregate(chain, F.array(F.lit(b"")), next_root)
    rooted = long.groupBy("conv_id").agg(roots.alias("roots")).select("conv_id", F.posexplode("roots").alias("level", "root"))
    held = items.join(rooted, ["conv_id", "level"], "left").withColumn("root", F.coalesce("root", F.lit(b"")))
    full = F.when(F.size("sizes") == segment, short(F.concat(F.col("root"), short(F.col("key")))))
    return kept(held.withColumn("next_root", full))


def identity(root: bytes, key: bytes) -> bytes:
    """A node's name, which is also the root of what lies below a full segment."""
    return hashlib.sha256(root + hashlib.sha256(key).digest()[:DIGEST]).digest()[:DIGEST]


def in_common(a: bytes, b: bytes, root: int) -> int:
    """Turns that two keys share after the same root; -1 for different roots."""
    if a[:root] != b[:root]:
        return -1
    low, high = 0, (min(len(a), len(b)) - root) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[: root + middle * DIGEST] == b[: root + middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


class Forest:
    """The contracted tries of sorted keys: nodes 0..m-1 are where items end, further ones where runs of items were joined.

    ``depth``, ``low``, ``high`` (the run of items) and ``parent`` (-1: none) are by node; ``node_of`` gives the node at which each item ends, as equal
    items have one; ``alive`` lists the nodes that are left, those below before those above.
    """

    def __init__(self, lengths: list[int], shared: list[int]):
        """``shared[i]``: turns that items i - 1 and i have in common, -1 if they have not even a root."""
        m = len(lengths)
        self.depth, self.low, self.high = list(lengths), list(range(m)), list(range(m))
        self.parent, into = [-1] * m, list(range(m))
        up, top = list(range(m)), list(range(m))

        def find(k: int) -> int:
            while up[k] != k:
                up[k] = k = up[up[k]]
            return k

        children: list[list[int]] = [[] for _ in range(m)]
        for i in sorted((i for i in range(1, m) if shared[i] >= 0), key=lambda i: -shared[i]):
            left, right, at = find(i - 1), find(i), shared[i]
            a, b = top[left], top[right]
            if self.depth[a] == at:
                node = a
                own = children[b] if self.depth[b] == at else [b]
                if self.depth[b] == at:
                    into[b] = a
            elif self.depth[b] == at:
                node, own = b, [a]
            else:
                node, own = len(self.depth), [a, b]
                self.depth.append(at)
                self.low.append(self.low[a])
                self.high.append(self.high[b])
                self.parent.append(-1)
                into.append(node)
                children.append([])
            for c in own:
                self.parent[c] = node
            children[node] += own
            self.low[node], self.high[node] = self.low[a], self.high[b]
            up[right] = left
            top[left] = node
        self.node_of = list(range(m))
        for i in range(m):
            while into[self.node_of[i]] != self.node_of[i]:
                self.node_of[i] = into[self.node_of[i]]
        self.alive = sorted((k for k in range(len(self.depth)) if into[k] == k), key=lambda k: -self.depth[k])


def nodes_of(items: pa.Table, part: int, before: int, after: int, level: int, segment: int) -> Iterator[tuple]:
    """The rows of one range, of which ``before`` and ``after`` turns are shared with its neighbours (-1: not even the root)."""
    width = DIGEST if level else 0
    items = items.take(pc.sort_indices(items, [("key", "ascending"), ("ends", "ascending"), ("conv_id", "ascending")]))
    keys, convs, ends = items["key"].to_pylist(), items["conv_id"].to_pylist(), items["ends"].to_pylist()
    below = list(zip(*(items[f"below_{c}"].to_pylist() for c in ("n_children", "n_leaves", "saved_tokens")), strict=True))
    sums = [[0, *np.cumsum(s).tolist()] for s in items["sizes"].to_pylist()]
    totals = [0, *np.cumsum([s[-1] for s in sums]).tolist()]
    m = len(keys)
    shared = [-1, *(in_common(keys[i - 1], keys[i], width) for i in range(1, m))]
    trees = Forest([(len(k) - width) // DIGEST for k in keys], shared)
    depth, low, high, parent = trees.depth, trees.low, trees.high, trees.parent
    size = len(depth)
    least: list = [None] * size
    own_ends: list[list[int]] = [[] for _ in range(size)]
    for i, k in enumerate(trees.node_of):
        least[k] = convs[i] if least[k] is None else min(least[k], convs[i])
        if ends[i]:
            own_ends[k].append(convs[i])
    for k in trees.alive:
        if (up := parent[k]) >= 0:
            least[up] = least[k] if least[up] is None else min(least[up], least[k])

    def seen(k: int, d: int) -> bool:
        """Whether the range before has this node too."""
        return low[k] == 0 and d <= before

    def goes_on(k: int, d: int) -> bool:
        return high[k] == m - 1 and d <= after

    def name(k: int, d: int) -> bytes | None:
        """Nodes that other ranges or levels may know have a name."""
        key = keys[low[k]]
        if level and d == 0:
            return key[:width]
        return identity(key[:width], key[width : width + d * DIGEST]) if d == segment or seen(k, d) or goes_on(k, d) else None

    distinct, further, leaves, children = [0] * size, [0] * size, [0] * size, [0] * size
    for k in trees.alive:
        at, cum, n = depth[k], sums[low[k]], high[k] - low[k] + 1
        above = depth[parent[k]] if parent[k] >= 0 else -1
        hanging = below[low[k]] if at == segment else (None,) * 3
        if hanging[0] is not None:
            if not seen(k, at):
                children[k] += hanging[0]
                leaves[k] += hanging[1]
                further[k] += hanging[2]
        elif low[k] == high[k] or keys[low[k]] == keys[high[k]]:  # nothing here goes deeper
            leaves[k] += not goes_on(k, at)
        counted = before if low[k] == 0 else -1
        for d in range(above + 1, at + 1):
            mine = name(k, d)
            bytes_here = distinct[k] + cum[at] - cum[min(at, max(d - 1, counted, 0))]
            saved = totals[high[k] + 1] - totals[low[k]] - n * cum[max(d - 1, 0)] - bytes_here + further[k]
            n_children = children[k] if d == at else int(not seen(k, d + 1))
            if level and d == 0:
                yield TOP, mine, level * segment, None, None, None, n, n_children, leaves[k], saved, None, part, None
                continue
            upper = k if d - 1 > above else parent[k]
            of = name(upper, d - 1) if d else None
            whole = own_ends[k] if d == at else []
            digest = None if mine else hashlib.sha256(",".join(map(str, whole)).encode()).hexdigest()
            yield CLOSED if mine is None else OPEN, mine, level * segment + d, least[k], of, least[upper] if d and of is None else None, n, n_children, leaves[k], saved, digest, part, None
            for j in range(0, len(whole) if mine else 0, IDS):
                yield ENDS, mine, None, None, None, None, None, None, None, None, ",".join(map(str, whole[j : j + IDS])), part, j // IDS
        if (up := parent[k]) >= 0:
            distinct[up] += distinct[k] + cum[at] - cum[min(at, max(above, counted, 0))]
            further[up] += further[k]
            leaves[up] += leaves[k]
            children[up] += not seen(k, above + 1)


KINDS = {"int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}


def _level(items: DataFrame, level: int, segment: int, kept: Kept) -> DataFrame:
    """The rows of all ranges of one level; ``items`` bears ``below_`` columns."""
    spark = items.sparkSession
    turns = items.agg(F.sum(F.size("sizes"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // RANGE))
    keyed = items.select(F.concat("root", "key").alias("key"), "ends", "conv_id", "sizes", "below_n_children", "below_n_leaves", "below_saved_tokens")
    laid = kept(keyed.repartitionByRange(parts, "key", "ends", "conv_id").withColumn("part", F.spark_partition_id()))
    bounds = sorted(laid.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect(), key=lambda r: r.part)
    width = DIGEST if level else 0
    shared = [-1, *(in_common(bytes(a.last), bytes(b.first), width) for a, b in zip(bounds, bounds[1:], strict=False)), -1]
    near = {r.part: (shared[k], shared[k + 1]) for k, r in enumerate(bounds)}
    fields = [f.split() for f in ROWS.split(", ")]
    schema = pa.schema([(c, KINDS[t]) for c, t in fields])

    def made(group: tuple, table: pa.Table) -> pa.Table:
        part = group[0].as_py()
        columns = list(zip(*nodes_of(table, part, *near[part], level, segment), strict=True))
        return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema)

    return laid.groupBy("part").applyInArrow(made, ROWS)


def _hashed(rows: DataFrame) -> DataFrame:
    """(prefix, digest) of the ids that open nodes have in all ranges, hashed one row after another."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        out = lambda p, h: pa.RecordBatch.from_arrays([pa.array([p], pa.binary()), pa.array([h.hexdigest()])], ["prefix", "digest"])
        for batch in batches:
            for prefix, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if prefix != now:
                    if state:
                        yield out(now, state)
                    now, state = prefix, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if state:
            yield out(now, state)

    ordered = rows.filter(F.col("kind") == ENDS).repartition("prefix").sortWithinPartitions("prefix", "part", "chunk")
    return ordered.select("prefix", "ends").mapInArrow(streamed, "prefix binary, digest string")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """A row for each distinct beginning of the rebuilt conversations: the columns of ``NODE``.

    Turns go by the turn column, nulls first, equal ones by their digests. Null roles and texts are empty. Rows without a conversation id
    belong to no conversation and play no part; other columns don't either. A repeated row is one more turn. A conversation left
    without turns is a member of the root alone. An empty table gives no rows, as there is no conversation that a root could be named after.

    A task holds about ``RANGE`` turns as digests, never their texts, and a row ``segment`` turns of a conversation. The ids that end in one node may
    be very many: they are hashed in order as they are read, as SHA-256 can't be put together from parts.
    """
    spark = conversations.sparkSession
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col)]
    turns = conversations.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), digest_of(*texts).alias("digest"), F.octet_length(texts[1]).cast("bigint").alias("size"))
    with scratch(spark) as kept:
        items = segments(*rebuilt(turns.filter("conv_id IS NOT NULL"), kept), kept, segment)
        deepest = items.agg(F.max("level")).first()[0]
        if deepest is None:
            return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'bigint'}" for c in NODE))
        sums = ("n_children", "n_leaves", "saved_tokens")
        rows, below = None, None
        for level in range(deepest, -1, -1):
            own = items.filter(F.col("level") == level)
            if below is None:
                own = own.withColumns({f"below_{c}": F.lit(None).cast("bigint") for c in sums})
            else:
                hung = F.broadcast(below) if below.count() <= BROADCAST_ROWS else below
                own = own.join(hung, "next_root", "left")
            made = kept(_level(own, level, segment, kept))
            rows = made if rows is None else rows.unionByName(made)
            below = kept(made.filter(F.col("kind") == TOP).groupBy(F.col("prefix").alias("next_root")).agg(*(F.sum(c).alias(f"below_{c}") for c in sums)))
        shared = rows.filter(F.col("kind") == OPEN).groupBy("prefix").agg(
            F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"), F.max("parent_conv_id").alias("parent_conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", *sums))
        )
        shared = kept(shared.join(_hashed(rows), "prefix", "left").withColumn("ends", F.coalesce("digest", F.lit(NONE))).drop("digest"))
        columns = ["conv_id", "depth", "parent", "parent_conv_id", "n_convs", *sums, "ends"]
        nodes = rows.filter(F.col("kind") == CLOSED).select(columns).unionByName(shared.select(columns))
        names = shared.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("above"))
        names = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
        known = nodes.filter("parent IS NULL").drop("parent")
        named = nodes.filter("parent IS NOT NULL").join(names, "parent").withColumn("parent_conv_id", F.col("above")).select(known.columns)
        return written(known.unionByName(named).withColumnRenamed("ends", "ends_sha256").select(*NODE))
