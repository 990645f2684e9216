"""Whitening of embeddings by exact integer covariances.

Entries become integers. Each task takes the least value of a dimension from its entries, packs the bit planes of what is left across
rows into words, and counts the ones that two planes have in common; weighted by powers of two these counts are the exact sums
of products. They are centred as integers, and only the covariance itself is a double.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.llm.tables import fresh, scratch

SCALE, OFFSET = 64, 1_000_000
#: Greatest integer before the offset; entries beyond it are taken as this.
GREATEST = 2**63 - 1 - OFFSET
#: Rows whose bits are packed together, a multiple of 64.
ROWS = 4096
#: Parts of 32 bits in which sums go through Spark; the last one bears the sign.
LIMBS = tuple(f"l{k}" for k in range(5))


class Whitening(NamedTuple):
    """``n`` vectors of ``dims`` entries with sums ``sums``; unit ``vectors`` in columns by falling ``eigenvalues``.

    ``explained`` is None where all vectors are equal; ``identity_error`` is None if no component has a variance.
    """

    n: int
    dims: int
    sums: list[int]
    vectors: np.ndarray
    eigenvalues: np.ndarray
    explained: list[float | None]
    identity_error: float | None


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~odd


def integers(vector: Column, dims: int) -> Column:
    """``floor(64 * c) + 1000000`` of each entry; short vectors are filled with entries 0, long ones cut."""
    found = F.transform(vector, lambda c: F.least(F.floor(c.cast("double") * SCALE), F.lit(GREATEST)) + OFFSET)
    return F.slice(F.concat(found, F.array_repeat(F.lit(OFFSET).cast("bigint"), dims)), 1, dims)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)


def limbs(value: int) -> tuple[int, ...]:
    return (*(value >> 32 * k & 0xFFFFFFFF for k in range(len(LIMBS) - 1)), value >> 32 * (len(LIMBS) - 1))


def whole(row: tuple) -> int:
    return sum(v << 32 * k for k, v in enumerate(row))


def planes_of(shifted: np.ndarray, bits: list[int]) -> np.ndarray:
    """Words of each dimension's bit planes, dimension after dimension and low bits first; column d needs ``bits[d]`` of them."""
    rows = -(-len(shifted) // 64) * 64
    packed = np.zeros((sum(bits), rows // 8), np.uint8)
    at = 0
    for d, n in enumerate(bits):
        if n:
            ones = (shifted[:, d][None, :] >> np.arange(n, dtype=np.uint64)[:, None]) & np.uint64(1)
            found = np.packbits(ones.astype(np.uint8), axis=1)
            packed[at : at + n, : found.shape[1]] = found
            at += n
    return packed.view(np.uint64)


def products(planes: np.ndarray, bits: list[int]) -> np.ndarray:
    """Sums of products of each pair of dimensions d <= e, exact, of up to ``ROWS`` rows."""
    owner = np.repeat(np.arange(len(bits)), bits)
    bit = np.concatenate([np.arange(n) for n in bits]) if bits else np.zeros(0, int)
    small = 2 * max(bits, default=0) + ROWS.bit_length() < 63
    out = np.zeros((len(bits), len(bits)), np.int64 if small else object)
    for k in range(len(planes)):
        common = np.bitwise_count(planes[k:] & planes[k]).sum(axis=1, dtype=np.int64)
        # two different planes of one dimension meet twice in its square
        power = bit[k:] + bit[k] + ((owner[k:] == owner[k]) & (np.arange(len(common)) > 0))
        if small:
            weighted = common << power
        else:
            weighted = np.array([int(c) << int(p) for c, p in zip(common, power, strict=True)], object)
        starts = np.flatnonzero(np.diff(owner[k:], prepend=-1))
        out[owner[k], owner[k:][starts]] += np.add.reduceat(weighted, starts)
    return out


def _grouped(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)


def _added(name: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in (LIMBS if name == "limbs" else (name,))]


def _ranges(fitted: DataFrame, dims: int) -> list[tuple[int, int, int]]:
    """(least, greatest, sum) of each dimension."""
    names = ["d", "low", "high", *LIMBS]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, total = np.full(dims, 2**63 - 1), np.full(dims, -(2**63)), np.zeros(dims, object)
        seen = False
        for batch in batches:
            x = matrix(batch.column(0), dims)
            for at in range(0, len(x), ROWS):
                own = x[at : at + ROWS]
                seen = True
                low, high = np.minimum(low, own.min(axis=0)), np.maximum(high, own.max(axis=0))
                # the sum of so many rows fits into a long if they are below 2^50
                total += own.sum(axis=0).astype(object) if max(-int(low.min()), int(high.max())) < 2**50 else own.astype(object).sum(axis=0)
        if seen:
            yield _grouped([(d, int(low[d]), int(high[d]), *limbs(int(total[d]))) for d in range(dims)], names)

    found = fitted.select("x").mapInArrow(summed, ", ".join(f"{c} bigint" for c in names))
    rows = found.groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"), *_added("limbs")).collect()
    return [(r.low, r.high, whole(r[3:])) for r in sorted(rows, key=lambda r: r.d)]


def _scatter(fitted: DataFrame, lows: list[int], bits: list[int]) -> dict[tuple[int, int], int]:
    """Sums of products of shifted entries for d <= e; pairs whose sum is 0 may be missing."""
    dims, names = len(lows), ["d", "e", *LIMBS]

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        shift = np.array(lows, np.int64).view(np.uint64)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            for at in range(0, len(x), ROWS):
                total += products(planes_of(x[at : at + ROWS].view(np.uint64) - shift, bits), bits).astype(object)
        rows = [(d, e, *limbs(int(total[d, e]))) for d in range(dims) for e in range(d, dims) if total[d, e]]
        if rows:
            yield _grouped(rows, names)

    found = fitted.select("x").mapInArrow(crossed, ", ".join(f"{c} bigint" for c in names))
    return {(r.d, r.e): whole(r[2:]) for r in found.groupBy("d", "e").agg(*_added("limbs")).collect()}


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = 16) -> Whitening:
    """Means, components and variances of the distinct usable vectors, from exact integer sums.

    Vectors that are null or hold a null, NaN or infinite entry play no part; equal ones count once, however many there are.
    Dimensions are as many as the longest vector has, and shorter ones are filled with entries 0. Entries whose integer would
    not fit into a long count as the greatest that does. Other columns play no part. Without usable vectors, or with empty ones only, there
    are no components. A component of no variance (all vectors equal, or fewer vectors than components) keeps its direction.

    The distinct vectors are written once and read three times; a task holds ``ROWS`` of them and sums of all pairs of dimensions,
    and so many sums reach the driver.
    """
    vector = F.col(f"`{vec_col}`")
    own = vectors.select(vector.alias("vector")).filter(usable(F.col("vector")))
    dims = own.agg(F.max(F.size("vector"))).first()[0] or 0
    if not dims:
        return Whitening(0, 0, [], np.zeros((0, 0)), np.zeros(0), [], None)
    with scratch(vectors.sparkSession) as kept:
        fitted = kept(own.select(integers(F.col("vector"), dims).alias("x")).distinct())
        n = fitted.count()
        ranges = _ranges(fitted, dims)
        lows, bits = [r[0] for r in ranges], [(r[1] - r[0]).bit_length() for r in ranges]
        cross = _scatter(fitted, lows, bits)
        sums = [r[2] for r in ranges]
        shifted = [s - n * low for s, low in zip(sums, lows, strict=True)]
        centred = [[n * cross.get((min(d, e), max(d, e)), 0) - shifted[d] * shifted[e] for e in range(dims)] for d in range(dims)]
        # a quotient of integers is rounded once
        values, directions = np.linalg.eigh(np.array([[v / (n * n) for v in row] for row in centred]))
        order = np.argsort(-values, kind="stable")[:components]
        values, directions = values[order], directions[:, order]
        trace = sum(centred[d][d] for d in range(dims)) / (n * n)
        values = np.where(values > max(values.max(), 0) * dims * 2.0**-50, values, 0.0)
        model = Whitening(n, dims, sums, directions, values, [float(v) / trace if trace else None for v in values], None)
        return model._replace(identity_error=_identity_error(fitted, model))


def deviations(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """(``x - S / n`` as doubles, sum of squares of ``n * x - S`` as exact integers)."""
    most = max(int(x.max()), -int(x.min()), 1) * model.n + max(map(abs, model.sums))
    if most < 2**62:
        apart = x * model.n - np.array(model.sums, np.int64)
        if len(apart) and int(np.abs(apart).max()) ** 2 * model.dims < 2**63:
            return apart / model.n, (apart * apart).sum(axis=1)
    apart = x.astype(object) * model.n - np.array(model.sums, object)
    return (apart / model.n).astype(float), (apart * apart).sum(axis=1)


def project(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """(whitened, squared deviation) of each row; NaN along components of no variance."""
    centred, squares = deviations(x, model)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.eigenvalues > 0, centred @ model.vectors / np.sqrt(model.eigenvalues), np.nan), squares


def _identity_error(fitted: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over the components with a variance."""
    k = int((model.eigenvalues > 0).sum())
    if not k:
        return None

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one more column of ones gives the sums themselves
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            x = matrix(batch.column(0), model.dims)
            for at in range(0, len(x), ROWS):
                own = x[at : at + ROWS]
                y = np.hstack([project(own, model)[0][:, :k], np.ones((len(own), 1))])
                total += y.T @ y
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(total[i, j])], ["i", "j", "v"])

    rows = fitted.select("x").mapInArrow(summed, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    found = {(r.i, r.j): r.v / model.n for r in rows}
    return max(abs(found[i, j] - found[i, k] * found[j, k] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(vectors: DataFrame, model: Whitening, vec_col: str = "embedding") -> DataFrame:
    """The rows of usable vectors with ``deviation`` (decimal) and ``whitened`` (array), which replace columns of those names.

    ``deviation`` is the exact sum of ``(n * x - S)^2``, null beyond 38 digits. ``whitened`` has a double for each component, null for
    those of no variance. Equal vectors get equal values and no row is lost; a vector shorter than the fitted ones is filled
    with entries 0, entries beyond them are left out. Without components ``whitened`` is empty.
    """

    @F.arrow_udf("deviation decimal(38,0), whitened array<double>")
    def projected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = pa.decimal128(38, 0), pa.list_(pa.float64())
        for column in batches:
            deviation, parts = [pa.array([], kinds[0])], [pa.array([], kinds[1])]
            if not model.dims:
                deviation, parts = [pa.array([Decimal(0)] * len(column), kinds[0])], [pa.array([[]] * len(column), kinds[1])]
            for at in range(0, len(column) if model.dims else 0, ROWS):
                white, squares = project(matrix(column.slice(at, ROWS), model.dims), model)
                if squares.dtype == object:
                    deviation.append(pa.array([Decimal(v) if v < 10**38 else None for v in squares], kinds[0]))
                else:
                    deviation.append(pa.array(squares).cast(kinds[0]))
                flat = white.ravel()
                offsets = np.arange(0, flat.size + 1, white.shape[1], dtype=np.int32)
                parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=np.isnan(flat))))
            yield pa.StructArray.from_arrays([pa.concat_arrays(deviation), pa.concat_arrays(parts)], ["deviation", "whitened"])

    own = vectors.filter(usable(F.col(f"`{vec_col}`")))
    found = projected(integers(F.col(f"`{vec_col}`"), model.dims))
    kept = [F.col(f"`{c}`") for c in vectors.columns if c.lower() not in ("deviation", "whitened")]
    name = fresh(vectors, "found")
    held = own.select(*kept, found.alias(name))
    return held.select(*kept, F.col(f"{name}.deviation").alias("deviation"), F.col(f"{name}.whitened").alias("whitened"))
