"""Small Arrow and numpy helpers that run inside tasks.

A "word" everywhere in this subpackage is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once inside a task; bounds the memory of every Arrow function here.
BATCH_BYTES = 8 << 20


class Words(NamedTuple):
    """Words of a batch of texts: ``words[codes[offsets[i]:offsets[i + 1]]]`` are those of text i."""

    words: pa.Array
    codes: np.ndarray
    offsets: np.ndarray


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the texts' UTF-8 one after another, and where each begins; no copy."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - (at[0] if len(at) else 0)


def by_bytes(batch: pa.RecordBatch, texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cuts a batch into row ranges of about ``limit`` text bytes; a longer text stands alone."""
    _, at = text_bytes(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start), texts.slice(start, end - start)
        start = end


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Splits at ASCII white space and keeps each distinct word once; none is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    words = coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
        # the empty word leaves the dictionary too, so those after it move up by one
        codes = codes - (codes > empty)
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    return Words(words, codes, offsets)


def places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``starts[i]`` to ``starts[i] + lengths[i]`` for all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``flat[starts[i] : starts[i] + lengths[i]]`` for all i, one after another."""
    return flat[places(starts, lengths)]


def ragged_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each range of values; empty ranges give 0."""
    return np.diff(np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])[offsets])
