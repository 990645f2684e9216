"""Packing of tokenised documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm import arrow, tokenizer

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, slot bigint"
PIECES_WITH_IDS = PIECES + ", ids binary"


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenises each whole text, adds ``end_id`` and cuts what is longer than ``window`` into full windows and a rest.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, slot (a number that spreads pieces evenly)
    and, on request, the ids as little-endian unsigned 32-bit integers. Null texts count as empty: one piece with
    only ``end_id``. A null id stays null. Repeated rows give repeated pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        slot = (task.partitionId() if task else 0) << 33
        for batch in batches:
            for rows, texts in arrow.by_bytes(batch, arrow.texts_of(batch.column(1))):
                words = arrow.split_words(texts)
                flat, lengths = tokenizer.encode_distinct(vocabulary, words.words)
                starts = np.cumsum(lengths) - lengths
                ids = arrow.gather(flat, starts[words.codes], lengths[words.codes]).astype("<u4")
                sizes = arrow.ragged_sums(lengths[words.codes], words.offsets)
                at = np.concatenate([[0], np.cumsum(sizes)])
                out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "slot", "ids")}
                for k, doc_id in enumerate(rows.column(0).to_pylist()):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), window):
                        raw = own[start : start + window].tobytes()
                        for name, value in zip(out, (doc_id, start, len(raw) // 4, zlib.crc32(raw), len(own), slot, raw if with_ids else b""), strict=True):
                            out[name].append(value)
                        slot += 1
                if not with_ids:
                    out.pop("ids")
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], list(out))

    own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return own.mapInArrow(cut, PIECES_WITH_IDS if with_ids else PIECES)


class OpenWindows:
    """Open windows in a segment tree indexed by remaining capacity."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.some = [False] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _mark(self, capacity: int, held: bool) -> None:
        node = capacity + self.size
        self.some[node] = held
        while node > 1:
            node >>= 1
            now = self.some[2 * node] or self.some[2 * node + 1]
            if now == self.some[node]:
                return
            self.some[node] = now

    def add(self, window: int, capacity: int) -> None:
        if capacity > 0:
            self.at[capacity].append(window)
            if len(self.at[capacity]) == 1:
                self._mark(capacity, True)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the (window, capacity) of least capacity at or above ``need``, if there is one."""
        node = need + self.size
        if not self.some[node]:
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        capacity = node - self.size
        window = self.at[capacity].pop()
        if not self.at[capacity]:
            self._mark(capacity, False)
        return window, capacity


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset in it) of each length, all of which are from 1 to ``window``."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = OpenWindows(window), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        found = tree.tightest(need)
        if found is None:
            found, used = (used, window), used + 1
        where[k], offset[k] = found[0], window - found[1]
        tree.add(found[0], found[1] - need)
    return where, offset


def pack(pieces: DataFrame, groups: int, window: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``window`` tokens.

    Pieces are dealt evenly by ``slot`` into ``groups`` groups, each packed by best-fit decreasing in one task, so
    that no group grows with a key. Sequence numbers are unique: the group in the high bits, the window in the low
    ones. Within a group, ties in length go by doc_id, start and slot, so that a retried task packs alike.
    """
    columns = [f"`{c}`" for c in pieces.columns if c != "slot"]

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "start", "slot"], kind="stable").reset_index(drop=True)
        where, offset = best_fit_decreasing(part["length"].to_numpy(np.int64), window)
        return part.assign(sequence_id=part["bin"].to_numpy(np.int64) * (1 << 32) + where, offset=offset).drop(columns=["bin", "slot"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "slot") + ", sequence_id bigint, offset bigint"
    binned = pieces.select(*columns, "slot", F.pmod(F.xxhash64("slot"), F.lit(groups)).alias("bin"))
    return binned.groupBy("bin").applyInPandas(packed, schema)


def groups_for(rows: int, text_bytes: int, window: int = 4096, pieces_per_group: int = 4_000) -> int:
    """Groups of bounded size for so many documents and bytes of text; fewer, larger groups leave less padding.

    Each document has a last piece, and a full one for each ``window`` tokens, taken as four bytes each: where tokens are
    shorter, groups have up to four times the pieces.
    """
    return max(1, math.ceil((rows + text_bytes / (4 * window)) / pieces_per_group))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Documents to packed pieces: :func:`cut_pieces`, then :func:`pack`. An empty table gives no rows.

    The ids never cross a shuffle unless they are asked for; only counts and checksums do.
    """
    pieces = cut_pieces(docs, id_col, text_col, window, vocabulary, end_id, with_ids)
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("bigint")), F.lit(0)).alias("bytes")).first()
    return pack(pieces, groups_for(size["rows"], size["bytes"], window), window)
