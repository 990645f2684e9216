"""GIF media columns: frames out of GIF values, with timing and colour histograms, and payloads stored as GIF.

Reading follows the format: blocks, global and local palettes, LZW code streams with deferred clears, interlacing,
transparency, disposal and delays. A code stream is decoded one clear code at a time: all codes of such a block are
cut out of the bits at once, and the strings they stand for are followed back to their roots together.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm import arrow

#: Fixed values of the format.
MAX_BITS, MAX_SIDE = 12, 65535
FULL = 1 << MAX_BITS
KEEP, TO_BACKGROUND, TO_PREVIOUS = 1, 2, 3
INTERLACE = ((0, 8), (4, 8), (2, 4), (1, 2))

#: Grey levels and colour levels of the histograms.
LEVELS = 4
#: Pixels of the largest screen that is opened: 256 MB of colours.
MAX_PIXELS = 1 << 26


class Frame(NamedTuple):
    """One composited frame: ``rgba`` has a row for each pixel of the screen; ``samples`` are its own stored indices."""

    delay_ms: int
    width: int
    height: int
    rgba: np.ndarray
    samples: np.ndarray


# ---------------------------------------------------------------- LZW


@lru_cache(maxsize=16)
def _widths(min_bits: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the codes after a clear code, and where each begins."""
    first = (1 << min_bits) + 2
    known = np.minimum(first + np.maximum(np.arange(count) - 1, 0), FULL - 1)
    bits = np.floor(np.log2(known)).astype(np.int64) + 1
    return bits, np.cumsum(bits) - bits


def _block(codes: np.ndarray, clear: int) -> np.ndarray:
    """Samples of the codes between two clear codes."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint8)
    parent = np.where(codes >= clear, codes - (clear + 2), -1)
    steps = np.arange(n)
    if (parent >= steps).any() or (codes == clear + 1).any() or (codes == clear).any():
        raise ValueError("the LZW stream has a code that is not known yet")
    root = np.where(parent >= 0, parent, steps)
    depth = (parent >= 0).astype(np.int64)
    while True:  # each turn doubles how far back a step sees
        above = depth[root]
        if not above.any():
            break
        depth += above
        root = root[root]
    first = codes[root]
    last = np.where(parent >= 0, first[np.minimum(parent + 1, n - 1)], codes).astype(np.uint8)
    place = np.cumsum(depth + 1) - 1
    out = np.zeros(int(place[-1]) + 1, np.uint8)
    at = steps
    while len(at):
        out[place] = last[at]
        at = parent[at]
        live = at >= 0
        at, place = at[live], place[live] - 1
    return out


def lzw_decode(stream: bytes, min_bits: int, size: int) -> np.ndarray:
    """``size`` samples of a code stream; a stream that ends early leaves zeros."""
    clear, ahead = 1 << min_bits, FULL
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    total, bit, parts, got = 8 * len(stream), 0, [], 0
    while got < size:
        bits, begin = _widths(min_bits, ahead)
        fits = int(np.searchsorted(begin + bits, total - bit, "right"))
        if not fits:
            break
        at = bit + begin[:fits]
        byte = at >> 3
        word = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
        codes = (word >> (at & 7).astype(np.uint32) & ((1 << bits[:fits]) - 1).astype(np.uint32)).astype(np.int64)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if not len(stop) and fits == ahead:  # a clear that was put off
            ahead *= 2
            continue
        end = int(stop[0]) if len(stop) else fits
        found = _block(codes[:end], clear)
        parts.append(found)
        got += len(found)
        if not len(stop) or codes[end] == clear + 1:
            break
        bit, ahead = int(at[end] + bits[end]), FULL
    out = np.zeros(size, np.uint8)
    joined = np.concatenate(parts) if parts else out[:0]
    out[: min(size, len(joined))] = joined[:size]
    return out


def lzw_encode(samples: bytes) -> bytes:
    """Code stream of 8-bit samples; the table is cleared when it is full."""
    codes, table = [], {}
    put, get, free = codes.append, table.get, 258
    prefix = samples[0]
    for b in memoryview(samples)[1:]:
        key = prefix << 8 | b
        code = get(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        table[key] = free
        free += 1
        if free == FULL:
            put(256)
            table.clear()
            free = 258
        prefix = b
    put(prefix)
    put(257)
    block = FULL - 258 + 1  # codes up to and with a clear code
    bits = np.concatenate([[9], np.resize(_widths(8, block)[0], len(codes))])
    every = np.concatenate([[256], codes])
    places = np.arange(MAX_BITS)
    spread = (every[:, None] >> places & 1).astype(np.uint8)
    return np.packbits(spread[places < bits[:, None]], bitorder="little").tobytes()


# ---------------------------------------------------------------- format


def _sub_blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := raw[at]:
        parts.append(raw[at + 1 : at + 1 + size])
        at += size + 1
    return b"".join(parts), at + 1


def _palette(raw: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    size = 3 << (flags & 7) + 1
    return np.frombuffer(raw, np.uint8, size, at).reshape(-1, 3), at + size


def read(raw: bytes) -> Iterator[Frame]:
    """The frames of a GIF, each composited onto what the frames before it have left.

    A screen or frame of more than ``MAX_PIXELS`` pixels is a ValueError, as a few bytes can claim any size.
    """
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", raw, 6)
    if width * height > MAX_PIXELS:
        raise ValueError(f"a screen of {width} x {height} pixels is too large")
    at, shared = 13, None
    if flags & 0x80:
        shared, at = _palette(raw, at, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, see_through, disposal = 0, -1, 0
    while at < len(raw) and (kind := raw[at]) != 0x3B:
        at += 1
        if kind == 0x21:
            label = raw[at]
            body, at = _sub_blocks(raw, at + 1)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0]
                see_through = body[3] if body[0] & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, own = struct.unpack_from("<HHHHB", raw, at)
        if w * h > MAX_PIXELS:
            raise ValueError(f"a frame of {w} x {h} pixels is too large")
        at, colours = at + 9, shared
        if own & 0x80:
            colours, at = _palette(raw, at, own)
        min_bits = raw[at]
        stream, at = _sub_blocks(raw, at + 1)
        samples = lzw_decode(stream, min_bits, w * h)
        image = samples.reshape(h, w)
        if own & 0x40:
            rows = np.concatenate([np.arange(a, h, step) for a, step in INTERLACE])
            straight = np.empty_like(image)
            straight[rows] = image
            image = straight
        before = canvas.copy() if disposal == TO_PREVIOUS else None
        area = canvas[top : top + h, left : left + w]
        image = image[: area.shape[0], : area.shape[1]]
        if colours is not None:
            shown = image != see_through
            area[shown, :3] = colours[np.minimum(image, len(colours) - 1)][shown]
            area[shown, 3] = 255
        yield Frame(10 * delay, width, height, canvas.copy(), samples)
        if disposal == TO_BACKGROUND:
            area[:] = 0
        elif before is not None:
            canvas = before
        delay, see_through, disposal = 0, -1, 0


def write(payload: bytes, width: int = 64, delay_cs: int = 10) -> bytes:
    """A grey-scale GIF whose stored samples are the payload, a positive multiple of ``width`` bytes.

    One frame holds up to 65535 rows; a longer payload goes on in further frames.
    """
    rows = len(payload) // width
    tall = min(rows, MAX_SIDE)
    out = [b"GIF89a", struct.pack("<HHBBB", width, tall, 0xF7, 0, 0), bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))]
    for start in range(0, rows, MAX_SIDE):
        h = min(MAX_SIDE, rows - start)
        out += [b"\x21\xf9\x04" + struct.pack("<BHBB", KEEP << 2, delay_cs, 0, 0), b"\x2c" + struct.pack("<HHHHB", 0, 0, width, h, 0), b"\x08"]
        stream = lzw_encode(payload[start * width : (start + h) * width])
        out += [bytes([len(part := stream[i : i + 255])]) + part for i in range(0, len(stream), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def colour_histogram(rgba: np.ndarray) -> np.ndarray:
    """Visible pixels by red, green and blue level, four levels each: 64 counts, red first."""
    seen = rgba.reshape(-1, 4)
    # the two upper bits of each colour side by side; a pixel that isn't visible counts beyond them
    place = (seen[:, 0] >> 6 << 4) | (seen[:, 1] >> 6 << 2) | (seen[:, 2] >> 6)
    place[seen[:, 3] == 0] = LEVELS**3
    return np.bincount(place, minlength=LEVELS**3 + 1)[: LEVELS**3]


# ---------------------------------------------------------------- columns

#: Bytes of pixels that a batch of frames may have, but for one frame, and pixels of all frames of one value.
FRAME_BYTES, VALUE_PIXELS = 64 << 20, 1 << 28
FRAMES = "id bigint, frame int, delay_ms int, width int, height int, rgba binary, colours array<bigint>, error string"


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each frame of each GIF: its delay, composited pixels and colour histogram.

    Null and empty values have no frames. A value that can't be read gives the frames before the fault, then one
    row with ``error`` set and ``frame`` null; other rows go on. So does one whose frames have more than ``VALUE_PIXELS`` pixels together, which a few
    bytes can say. Frames are given in batches of about ``FRAME_BYTES``. Repeated rows give repeated frames.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, held, pixels = [], 0, 0
                try:
                    for k, f in enumerate(read(raw) if raw else ()):
                        pixels += f.width * f.height
                        if pixels > VALUE_PIXELS:
                            raise ValueError(f"frames have more than {VALUE_PIXELS} pixels")
                        if found and held + f.rgba.nbytes > FRAME_BYTES:
                            yield _rows(found)
                            found, held = [], 0
                        found.append((key, k, f.delay_ms, f.width, f.height, f.rgba.tobytes(), colour_histogram(f.rgba).tolist(), None))
                        held += f.rgba.nbytes
                except (ValueError, IndexError, struct.error, MemoryError) as e:
                    found.append((key, None, None, None, None, None, None, str(e)))
                if found:
                    yield _rows(found)

    own = media.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{media_col}`").cast("binary").alias("media"))
    return own.mapInArrow(opened, FRAMES)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string())
    names = [x.split()[0] for x in FRAMES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """doc_id, n_bytes and media: each whole text's UTF-8, filled up with bytes 0 to a positive multiple of ``unit``, as a GIF.

    Null counts as the empty text. Equal texts give equal media; repeated rows stay.
    """

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in arrow.by_bytes(batch, arrow.texts_of(batch.column(1)), arrow.BATCH_BYTES // 4):
                raw = [t.encode() for t in texts.to_pylist()]
                media = [write(r.ljust(max(unit, -(-len(r) // unit) * unit), b"\0"), unit) for r in raw]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return own.mapInArrow(stored, "doc_id bigint, n_bytes bigint, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """Adds payload (the samples of all frames, read from the stored bytes), n_frames, delay_ms (of all frames together) and colours:
    the colour histogram of the composited pixels, summed over the frames.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(2)
            sizes = pc.binary_length(media).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // (arrow.BATCH_BYTES // 4), prepend=-1)).tolist() + [len(media)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                payload, frames_, delays, colours = [], [], [], []
                for raw in media.slice(a, b - a).to_pylist():
                    found, delay, seen = [], 0, np.zeros(LEVELS**3, np.int64)
                    for f in read(raw):
                        found.append(f.samples.tobytes())
                        delay += f.delay_ms
                        seen += colour_histogram(f.rgba)
                    payload.append(b"".join(found))
                    frames_.append(len(found))
                    delays.append(delay)
                    colours.append(seen.tolist())
                rows = batch.slice(a, b - a)
                made = [pa.array(payload, pa.binary()), pa.array(frames_, pa.int64()), pa.array(delays, pa.int64()), pa.array(colours, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *made], [*batch.schema.names, "payload", "n_frames", "delay_ms", "colours"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(opened, "doc_id bigint, n_bytes bigint, media binary, payload binary, n_frames bigint, delay_ms bigint, colours array<bigint>")
