"""Near duplicates by HyperMinHash on sets of word shingles.

A set's distinct 64-bit shingle hashes fall into 128 buckets by their upper bits. Of each bucket's least hash the
register keeps the count of leading zeros and ten bits after the first one. Empty registers borrow from others
picked by fixed random numbers. Four registers make a band key, 32 bands a text. Four bits of each register make the
sketch: equal lanes, corrected for those that are equal by chance, estimate the Jaccard similarity before the whole sets are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.llm import arrow
from marlpit.llm.linking import Sketches, few, link
from marlpit.llm.tables import fresh, scope, written

SHINGLE = 5
BUCKET_BITS, MANTISSA = 7, 10
REGISTERS, BAND = 1 << BUCKET_BITS, 4
BANDS = REGISTERS // BAND
LANE = 4
LANES = 64 // LANE
SKETCH = tuple(f"s{k}" for k in range(REGISTERS // LANES))
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; a text of fewer words is one shingle, one of none is empty."""
    found = arrow.split_words(texts, lower=True)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found.words.to_pylist()), np.uint64, len(found.words))
    word = own[found.codes]
    rolled = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for j in range(size):
        rolled = rolled * ODD + word[j : j + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist(), strict=True):
        if b - a < size:
            whole = np.zeros(min(1, b - a), np.uint64)
            for w in word[a:b]:
                whole = whole * ODD + w
            out.append(mix(whole + np.uint64(b - a)))
            continue
        hashes = np.sort(rolled[a : b - size + 1])
        keep = np.empty(len(hashes), bool)
        keep[0] = True
        np.not_equal(hashes[1:], hashes[:-1], out=keep[1:])
        out.append(hashes[keep])
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 128 registers for each set: leading zeros and mantissa of the bucket's least hash, 0 if it has none."""
    edges = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
    least = np.zeros((len(sets), REGISTERS), np.uint64)
    held = np.zeros((len(sets), REGISTERS), bool)
    for k, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, edges)
            inside = np.append(at[1:], len(s)) > at
            least[k, inside] = s[at[inside]]
            held[k] = inside
    rest = least << np.uint64(BUCKET_BITS)
    zeros = 53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]
    after = rest << np.minimum(zeros + 1, 63).astype(np.uint64)
    value = (zeros + 1).astype(np.uint64) << np.uint64(MANTISSA) | after >> np.uint64(64 - MANTISSA)
    return np.where(held, value, 0).astype(np.uint16)


def filled(own: np.ndarray) -> np.ndarray:
    """Registers without gaps: an empty one copies the first full one of a sequence that is fixed for its place."""
    draw = np.random.default_rng(4)
    out = own.copy()
    for _ in range(48):
        from_ = draw.integers(0, REGISTERS, REGISTERS)
        gaps = out == 0
        if not gaps.any():
            return out
        out = np.where(gaps, own[:, from_], out)
    for step in range(1, REGISTERS):
        gaps = out == 0
        if not gaps.any():
            break
        out = np.where(gaps, np.roll(own, -step, axis=1), out)
    return out


def band_keys(full: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    bands = full.reshape(len(full), BANDS, BAND).astype(np.uint64)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(full), 1))
    for j in range(BAND):
        key = key * ODD + bands[:, :, j]
    return mix(key).view(np.int64)


def lanes(full: np.ndarray) -> np.ndarray:
    """Four bits of each register, sixteen to a long."""
    four = mix(full.astype(np.uint64)) & np.uint64((1 << LANE) - 1)
    four = four.reshape(len(full), len(SKETCH), LANES) << (np.arange(LANES, dtype=np.uint64) * np.uint64(LANE))
    return np.bitwise_or.reduce(four, axis=2).view(np.int64)


def likely(numerator: int, denominator: int) -> Callable[[Callable[[str], Column], Callable[[str], Column]], Column]:
    """Whether sizes allow the threshold, and the corrected estimate is within five standard errors of it."""

    def test(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        differ = F.lit(0)
        for c in SKETCH:
            x = a(c).bitwiseXOR(b(c))
            x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
            differ = differ + F.bit_count(x)
        chance, goal = 1 / (1 << LANE), numerator / denominator
        estimate = (1 - differ / F.lit(float(REGISTERS)) - chance) / (1 - chance)
        low, high = F.least(a("n"), b("n")), F.greatest(a("n"), b("n"))
        # lanes that were borrowed count twice, but a small set is sampled nearly whole
        error = F.sqrt(F.lit(goal * (1 - goal)) * (F.lit(1 / REGISTERS) + 0.35 / low.cast("double")) + 0.0004)
        return (denominator * low >= numerator * high) & (estimate >= goal - 5 * error)

    return test


SIGNED = "doc_id bigint, n bigint, set_hash binary, keys array<bigint>, " + ", ".join(f"{c} bigint" for c in SKETCH)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Size, hash, band keys and sketch of each whole text's set; of an empty set only the size, 0."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in arrow.by_bytes(batch, arrow.texts_of(batch.column(1)), arrow.BATCH_BYTES // 2):
                sets = shingle_sets(texts)
                full = filled(registers(sets))
                keys, sketch = band_keys(full), lanes(full)
                some = np.array([len(s) > 0 for s in sets])
                hashes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                offsets = pa.array((np.arange(len(sets) + 1) * BANDS).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())), *(pa.array(sketch[:, k], mask=~some) for k in range(len(SKETCH)))],
                    ["doc_id", "n", "set_hash", "keys", *SKETCH],
                )

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(sign, SIGNED)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numerator: int = 75, denominator: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links) and kept (the row is that one), for each row.

    Two texts are linked if ``denominator`` * common shingles >= ``numerator`` * united ones, which is confirmed on
    the whole sets of shingles, each known by a 64-bit hash. Equal sets are one class, whose least id stands for it; copies aren't made into pairs.
    Null and empty texts have no shingles, are linked with nothing and kept. Rows without an id are linked
    with nothing and kept, their component null. Rows that share an id are one document.
    """
    with scope(docs.sparkSession) as result:
        table = written(signed(docs, id_col, text_col))
        full = table.filter("n > 0 and doc_id is not null")
        classes = written(full.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")))
        # by both, of which no pair is in many rows, so that a text of very many copies is no hot key
        frame = full.withColumn("id", F.col("doc_id")).join(classes.select("set_hash", "id"), ["set_hash", "id"], "left_semi").dropDuplicates(["id", "set_hash"])
        sketched = written(frame.select("id", "n", *SKETCH), classes.count())  # which every turn of the linking reads

        def sets_of(ids: DataFrame, rows: int) -> DataFrame:
            def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for part, texts in arrow.by_bytes(batch, arrow.texts_of(batch.column(1)), arrow.BATCH_BYTES // 2):
                        sets = shingle_sets(texts)
                        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                        items = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(items))], ["id", "items"])

            own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
            return own.join(few(ids, rows), "id", "left_semi").mapInArrow(made, "id bigint, items array<bigint>")

        keyed = frame.select("id", F.explode("keys").alias("key"))
        labels = link(Sketches(keyed, sketched, ("n", *SKETCH), likely(numerator, denominator)), sets_of, numerator, denominator)
        # copies take their class' component, which is looked up once for each class; all other rows go by their own id
        several = written(classes.filter("copies > 1").join(labels, "id", "left").select("set_hash", F.coalesce("component", "id").alias("of_class")))
        own = labels.select(F.col("id").alias("doc_id"), F.col("component").alias("of_row"))
        placed = full.select("doc_id", "n", "set_hash").join(few(several, 3 * several.count()), "set_hash", "left").join(own, "doc_id", "left")
        found = placed.select("doc_id", "n", F.coalesce("of_class", "of_row", "doc_id").alias("component_id"))
        alone = table.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
        every = found.unionByName(alone)
        return result(every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, that of the least id, with all its columns as they were, whatever their names.

    Rows that share the kept id all stay; null and empty texts and rows without an id stay; an empty table stays empty.
    """
    m = fresh(docs, "_m")
    with scope(docs.sparkSession) as result:
        gone = result(near_duplicates(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias(m)).distinct())
    key = F.col(f"`{id_col}`").cast("bigint")
    return docs.join(few(gone, gone.count()), key == F.col(m), "left_anti")
