"""Line deduplication by MinHash over character shingles, with DataFrame operations alone.

Equal lines are one item. Each item's shingles (ten code points) are hashed once, and the least hash of each of 36
buckets makes its signature, by one grouped aggregation without a shuffle of shingles. Twelve bands of three
values give candidates; whole shingle sets confirm them; components keep their first line.

A changed character touches ten shingles of ten, which is too many for lines under 79 code points. Those are also held
against each other by shingles of two to nine code points, an eighth of the shorter line's length; candidates are lines
that are equal but for one stretch, as any one edit leaves them at such a length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.llm.linking import Sketches, components, few, link
from marlpit.llm.tables import fresh, scope, written

SHINGLE, BUCKETS, BAND = 10, 36, 3
#: Code points of the shortest line that stays similar with one character changed, by bigrams, and of the longest that may be near a line under 79.
SHORTEST, LONGEST = 15, 104
WORD = r"[^\x20\x09-\x0D]"


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, copy (a hash of the text, which tells rows of one id apart), line_no, line and two 64-bit hashes of it, of every
    line that has a word. Null texts have none."""
    text = F.col(f"`{text_col}`")
    # outer, or Spark would add a filter on the number of lines, which splits each text again; null texts go with the lines without a word
    parts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("copy"), F.posexplode_outer(F.split(text, "\n")).alias("line_no", "line"))
    return parts.filter(F.col("line").rlike(WORD)).withColumns({"id": F.xxhash64("line"), "check": F.xxhash64("line", F.lit(1))})


def _shingle(encoded: str, at: str) -> Column:
    """The hash of the shingle that begins at a code point; four bytes are one code point."""
    return F.expr(f"xxhash64(substring({encoded}, cast(4 * {at} + 1 as int), {4 * SHINGLE}))")


def _starts(line: str) -> Column:
    """Where shingles begin; a shorter line is one shingle."""
    return F.sequence(F.lit(0), F.greatest(F.length(line) - SHINGLE, F.lit(0)))


def band_keys(lines: DataFrame) -> DataFrame:
    """(id, key), a row for each band of each distinct line.

    One hash for each shingle: its remainder names one of 36 buckets, of which the least hash is kept, and three
    buckets make a band; a band without any shingle has no row. Equal lines meet once after each task has made its
    own distinct, so a line that fills a third of the table is one row a task; both aggregations stand where the
    distinct lines already lie, so no shingle is shuffled.
    """
    distinct = lines.groupBy("id").agg(F.first("line").alias("line"))
    # encoded below the explosion: once for each line, not once for each shingle
    coded = distinct.select("id", F.encode("line", "UTF-32").alias("code"), _starts("line").alias("starts"))
    shingles = coded.select("id", "code", F.explode("starts").alias("at"))
    bucket = F.pmod("h", F.lit(BUCKETS)).cast("int")
    hashed = shingles.select("id", _shingle("code", "at").alias("h")).select("id", "h", F.floor(bucket / BAND).cast("int").alias("band"), (bucket % BAND).alias("slot"))
    bands = hashed.groupBy("id", "band").agg(*(F.min(F.when(F.col("slot") == k, F.col("h"))).alias(f"least{k}") for k in range(BAND)))
    return bands.select("id", F.xxhash64("band", *(F.coalesce(f"least{k}", F.lit(0)) for k in range(BAND))).alias("key"))


def short_items(lines: DataFrame) -> DataFrame:
    """(item, id, k, line): distinct lines under 79 code points and those that may be near one, once for each shingle
    length k that they are compared by: from an eighth of three quarters of their length to an eighth of all of it, so
    that lines of unlike length have one in common. Lines are linked if they are similar by any k that both have."""
    length = F.length("line")
    distinct = lines.filter(length.between(SHORTEST, LONGEST)).groupBy("id").agg(F.first("line").alias("line"))
    low = F.expr("greatest(2, (cast(ceil(0.75 * length(line)) as int) + 1) div 8)")
    high = F.expr(f"least({SHINGLE - 1}, (length(line) + 1) div 8)")
    each = distinct.select("id", "line", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("k"))
    return each.select(F.xxhash64("id", "k").alias("item"), "id", "k", "line")


def stretch_keys(items: DataFrame) -> DataFrame:
    """(id, key): eight for each item, of a beginning and an end with 7 k - 1 code points in all.

    The shorter line of a pair has 8 k - 1 code points at least; wherever one stretch of it is changed that leaves the
    pair similar, one of the eight has it between beginning and end.
    """
    cut = items.select("item", "k", "line", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    cut = cut.withColumn("head", F.expr("least(j * k, 7 * k - 1)")).withColumn("tail", F.expr("7 * k - 1 - head"))
    key = F.expr("xxhash64(k, j, substring(line, 1, head), if(tail > 0, substring(line, length(line) - tail + 1, tail), ''))")
    return cut.select(F.col("item").alias("id"), key.alias("key"))


def _sets(line: str) -> Column:
    """Distinct hashes of the shingles of ``line.k`` code points; a shorter line is one shingle."""
    # bound to a name, or the line would be encoded once for each shingle
    return F.expr(f"array_distinct(element_at(transform(array(struct(encode({line}.line, 'UTF-32') as code, 4 * {line}.k as width, 4 * greatest(length({line}.line) - {line}.k, 0) + 1 as last)), c -> transform(sequence(1, c.last, 4), i -> xxhash64(substring(c.code, i, c.width)))), 1))")


def linked_lines(lines: DataFrame, numerator: int = 75, denominator: int = 100) -> DataFrame:
    """(id, component) of the lines that have a link, by either kind of shingles."""
    items = written(short_items(lines))
    keyed = band_keys(lines).unionByName(stretch_keys(items))

    def sets_of(ids: DataFrame, rows: int) -> DataFrame:
        wanted = few(ids, rows)
        whole = lines.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("line").alias("line"))
        short = items.join(wanted.withColumnRenamed("id", "item"), "item", "left_semi").select(F.col("item").alias("id"), "line", "k")
        return whole.withColumn("k", F.lit(SHINGLE)).unionByName(short).select("id", F.struct("line", "k").alias("items"))

    labels = link(Sketches(keyed, items=_sets, dealt=True), sets_of, numerator, denominator)
    placed = written(labels.join(items.select(F.col("item").alias("id"), F.col("id").alias("line_id")), "id", "left"))
    short = placed.filter("line_id is not null")
    least = short.groupBy("component").agg(F.min("line_id").alias("a"))
    edges = short.join(least, "component").select("a", F.col("line_id").alias("b"))
    whole = placed.filter("line_id is null").select("id", "component")
    if edges.isEmpty():
        return whole
    return components(edges.unionByName(whole.select(F.col("component").alias("a"), F.col("id").alias("b"))))


def _grouped(found: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """doc_id, copy, line_no of each line, with ``first``: the place of its component's first line, or null if it is alone."""
    place = F.struct("doc_id", "copy", "line_no")
    with scope(found.sparkSession) as result:
        # a row for each distinct line from here on, however often it comes
        lines = written(found.groupBy("id", "check").agg(F.min(place).alias("place"), F.count("*").alias("n")))
        labels = linked_lines(found, numerator, denominator)
        labelled = written(lines.join(labels, "id"))
        first = labelled.groupBy("component").agg(F.min("place").alias("first"))
        known = labelled.join(first, "component").select("id", "check", "first")
        alone = lines.filter("n > 1").join(labels, "id", "left_anti").select("id", "check", F.col("place").alias("first"))
        known = result(known.unionByName(alone))
    return found.select("doc_id", "copy", "line_no", "id", "check").join(few(known, 5 * known.count()), ["id", "check"], "left").select("doc_id", "copy", "line_no", "first")


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numerator: int = 75, denominator: int = 100) -> DataFrame:
    """doc_id, line_no, first_doc_id, first_line_no and kept, for every line that has a word.

    Lines are cut at newlines and numbered from 0. Two lines are linked if they are equal, or
    ``denominator`` * common shingles >= ``numerator`` * united ones, by shingles of ten code points or, for short
    lines, of an eighth of the line; lines and shingles are compared by their hashes (128 and 64 bits). The first line of a component, by doc_id (nulls
    first), a hash of the text and line number, is kept. Rows that share an id and a text are one document; rows that share an id alone are told
    apart. Null and empty texts, blank lines and empty tables give no rows; a very long line is one item, whole.
    """
    found = _grouped(lines_of(docs, id_col, text_col), numerator, denominator)
    first = F.coalesce("first", F.struct("doc_id", "copy", "line_no"))
    every = found.select("doc_id", "copy", "line_no", first.alias("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("copy") == F.col("first.copy")) & (F.col("line_no") == F.col("first.line_no"))
    return every.select("doc_id", "line_no", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"), same.alias("kept"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numerator: int = 75, denominator: int = 100) -> DataFrame:
    """``docs`` with all columns, whatever their names, their texts without the lines that :func:`line_groups` doesn't keep.

    Rows and their order of lines stay; a text that loses all its lines is empty. Of rows that share an id and a text
    each keeps the lines that the first of them keeps. Null texts stay null.
    """
    p = fresh(docs, "_l")
    with scope(docs.sparkSession) as result:
        found = _grouped(lines_of(docs, id_col, text_col), numerator, denominator).filter("first is not null")
        other = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("copy") != F.col("first.copy")) | (F.col("line_no") != F.col("first.line_no"))
        gone = found.filter(other).groupBy(F.col("doc_id").alias(f"{p}id"), F.col("copy").alias(f"{p}copy")).agg(F.collect_set("line_no").alias(f"{p}gone"))
        gone = result(gone)
    numbers = gone.agg(F.coalesce(F.sum(F.size(f"{p}gone") + 4), F.lit(0))).first()[0]
    text = F.col(f"`{text_col}`")
    same = F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col(f"{p}id")) & (F.xxhash64(text) == F.col(f"{p}copy"))
    held = docs.join(few(gone, numbers), same, "left")
    # the lines are bound to a name, or the text would be split once for each of them
    left = F.expr(f"element_at(transform(array(split(`{text_col}`, '\n')), x -> array_join(transform(array_except(sequence(0, size(x) - 1), {p}gone), i -> get(x, i)), '\n')), 1)")
    new = F.when(F.col(f"{p}gone").isNull(), text).otherwise(left)
    return held.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
