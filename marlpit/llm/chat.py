"""Chat formatting by columnar byte assembly, and reading the formatted text back.

A turn is written as ``<s>[role]`` newline text ``</s>`` newline. Inside roles and texts a backslash goes before each
backslash, ``<``, ``[`` and ``]``; so no text can hold a control string, and taking those backslashes out gives the
text again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm import arrow

OPEN, NAMED, CLOSE = b"<s>[", b"]\n", b"</s>\n"
ESCAPED = r"([\\<\[\]])"
TURN = re.compile(r"<s>\[((?:\\.|[^\\\]])*)\]\n((?:\\.|[^\\<])*)</s>\n", re.DOTALL)

#: Bytes from which a segment is copied by itself.
LONG = 1 << 16
PARTS = "conv_id bigint, part bigint, formatted string, loss_start array<bigint>, loss_end array<bigint>"


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin, text_begin, text_end) of all turns in one preallocated buffer; turn k is ``bytes[begin[k]:begin[k + 1]]``.

    Batches of many short turns are scattered at once, at some forty bytes of places for each byte; a long segment is copied
    as it is, so that a very long text needs little more than its own size.
    """
    n = len(texts)
    sources = [np.frombuffer(b, np.uint8) for b in (OPEN, NAMED, CLOSE)]
    role, role_at = arrow.text_bytes(pc.replace_substring_regex(roles, ESCAPED, r"\\\1"))
    text, text_at = arrow.text_bytes(pc.replace_substring_regex(texts, ESCAPED, r"\\\1"))
    zero = np.zeros(n, np.int64)
    # the five segments of each turn: source, where they start there, and how long they are
    parts = [(sources[0], zero, zero + len(OPEN)), (role, role_at[:-1], np.diff(role_at)), (sources[1], zero, zero + len(NAMED)), (text, text_at[:-1], np.diff(text_at)), (sources[2], zero, zero + len(CLOSE))]
    ends = np.cumsum(np.stack([p[2] for p in parts], axis=1).ravel()).reshape(n, 5) if n else np.zeros((0, 5), np.int64)
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, (source, start, length) in enumerate(parts):
        target = ends[:, k] - length
        long = length > LONG
        for a, b, size in zip(target[long].tolist(), start[long].tolist(), length[long].tolist(), strict=True):
            out[a : a + size] = source[b : b + size]
        target, start, length = target[~long], start[~long], length[~long]
        total = int(length.sum())
        step = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(target, length) + step] = source[np.repeat(start, length) + step]
    return out, np.append(ends[:, 4] - sum(p[2] for p in parts), len(out)) if n else np.zeros(1, np.int64), ends[:, 2], ends[:, 3]


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, part, formatted, and loss_start and loss_end: code point ranges of the texts that ``loss_role`` says.

    Turns are put in order by the turn column (nulls first), equal ones by role and text. Null roles and texts are
    empty; rows without a conversation id form one conversation. A conversation that runs over more than one
    batch is given in several parts, numbered from 0 and next to each other, each of whole turns, so that no
    conversation must fit in memory. An empty table gives no rows; other columns play no part.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), 0
        for whole in batches:
            for batch, texts in arrow.by_bytes(whole, arrow.texts_of(whole.column(2))):
                roles = arrow.texts_of(batch.column(1))
                raw, begin, text_begin, text_end = assemble(roles, texts)
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                ids = batch.column(0).to_pylist()
                first = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]]
                offsets = np.append(begin[first], len(raw)).astype(np.int32)
                formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(raw))
                group = np.searchsorted(np.array(first), np.arange(len(ids)), "right") - 1
                loss = pc.equal(roles, loss_role).to_numpy(zero_copy_only=False)
                base = points[offsets[:-1]][group]
                counts = np.append(0, np.cumsum(np.bincount(group[loss], minlength=len(first)))).astype(np.int32)
                ranges = [pa.ListArray.from_arrays(pa.array(counts), pa.array((points[x] - base)[loss])) for x in (text_begin, text_end)]
                parts = []
                for k in first:
                    part = part + 1 if ids[k] == last else 0
                    last = ids[k]
                    parts.append(part)
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in first], pa.int64()), pa.array(parts, pa.int64()), formatted, *ranges], [x.split()[0] for x in PARTS.split(", ")])

    own = turns.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{turn_col}`").alias("turn"))
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(written, PARTS)


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


class _Reading:
    """What has been read of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def part(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        at = 0
        for m in TURN.finditer(formatted):
            if m.start() != at:
                break
            at = m.end()
            self.turns += 1
            self.all.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
        if at != len(formatted):
            raise ValueError(f"conversation {self.conv_id} can't be read back at {at}")
        for a, b in zip(starts, ends, strict=True):
            text = unescape(formatted[a:b])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from what :func:`format_chats` has written, part after part."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), [x.split()[0] for x in READ.split(", ")]
        rows = lambda found: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
        now: _Reading | None = None
        for batch in batches:
            done = []
            for conv_id, part, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == 0:
                    if now:
                        done.append(now.row())
                    now = _Reading(conv_id)
                now.part(text, starts, ends)
            if done:
                yield rows(done)
        if now:
            yield rows([now.row()])

    return formatted.mapInArrow(digested, READ)
