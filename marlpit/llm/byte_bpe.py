"""Byte-level BPE: a minimal acyclic transducer of frequent words, exact merges for all others, and decoding.

A text is first cut into segments, each of which starts where a white space byte follows another byte: no token
crosses such a place. Frequent segments are words of the lexicon; their ids come out of the transducer. A segment
that the lexicon lacks is cut by the tokenizer's own pattern and merged by rank, all such words of a batch at once.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.llm import arrow, tokenizer
from marlpit.llm.frequent import most_frequent
from marlpit.llm.merges import Merges, byte_letters
from marlpit.llm.tables import scope, written
from marlpit.llm.tokenizer import vocabulary_path

#: White space of the tokenizer's pattern (Unicode White_Space), and its contractions.
SPACE = r"\t-\r \x85\xa0  -     　"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

#: White space beyond ASCII: a text that has some is one segment, as its spaces may join with the ASCII ones.
WIDE_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: What a task has at once, so that a worker's memory hangs neither on the batch nor on how many of its words are new: bytes of texts, bytes of
#: segments that are merged together, words that are kept, and rows that are decoded.
PIECE_BYTES, MERGED_BYTES, KEPT_WORDS, DECODED_ROWS = arrow.BATCH_BYTES // 4, 1 << 18, 50_000, 1_000


# ---------------------------------------------------------------- segments


def segments_of(texts: pa.Array) -> arrow.Words:
    """Distinct segments of a batch of texts, in the manner of :func:`arrow.split_words`. No byte is lost."""
    raw, at = arrow.text_bytes(texts)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-1] = space[1:] & ~space[:-1]
    wide = pc.match_substring_regex(texts, WIDE_SPACE).to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(wide):
        cut[at[k] : at[k + 1]] = False
    cut[at] = True
    starts = np.flatnonzero(cut)
    data = pa.py_buffer(raw)
    flat = pa.BinaryArray.from_buffers(pa.binary(), max(0, len(starts) - 1), [None, pa.py_buffer(starts.astype(np.int32)), data])
    coded = flat.dictionary_encode()
    return arrow.Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(starts, at))


def frequent_words(docs: DataFrame, text_col: str = "text", size: int = 65_536) -> list[tuple[bytes, int]]:
    """The most frequent segments of all texts, ``size`` at most, with their counts.

    Each task counts its own segments first, so one frequent word is one row a task.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in arrow.by_bytes(batch, arrow.texts_of(batch.column(0)), arrow.BATCH_BYTES):
                found = segments_of(texts)
                n = np.bincount(found.codes, minlength=len(found.words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([found.words, pa.array(n)], ["segment", "n"])

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(counted, "segment binary, n bigint")
    with scope(docs.sparkSession):
        counts = written(rows.groupBy("segment").agg(F.sum("n").alias("n")).filter(F.octet_length("segment").between(1, 64)))
        return sorted((bytes(r.segment), r.n) for r in most_frequent(counts, "n", size).collect())


# ---------------------------------------------------------------- vocabulary


class Vocabulary:
    """Ids of bytes, merges by pair, and the bytes of each id, from a tokenizers file."""

    def __init__(self, name: str):
        import regex

        with open(vocabulary_path(name), encoding="utf-8") as f:
            found = json.load(f)
        letter = byte_letters()
        byte = {c: b for b, c in enumerate(letter)}
        vocab = found["model"]["vocab"]
        self.byte_id = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in found["model"]["merges"]]
        self.merges = Merges(*(np.array([vocab[x] for x in side], np.int64) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs])))
        self.cache, self.plain = tokenizer.WordCache(KEPT_WORDS), tokenizer.WordCache(KEPT_WORDS)
        self.special = {x["content"]: x["id"] for x in found["added_tokens"]}
        tokens = {i: bytes(byte[c] for c in t) for t, i in vocab.items() if t not in self.special}
        tokens |= {i: t.encode() for t, i in self.special.items()}
        sizes = np.array([len(tokens.get(i, b"")) for i in range(max(tokens) + 1)], np.int64)
        self.token_bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(sizes))), np.uint8)
        self.token_size, self.token_start = sizes, np.cumsum(sizes) - sizes
        self.pattern = regex.compile(rf"{'|'.join(CONTRACTIONS)}| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def encode_segments(self, segments: list[bytes], special_strings: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of each segment, by the pattern and the merges alone; segments of about MERGED_BYTES at a time."""
        if not segments:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        part = np.cumsum([len(x) for x in segments]) // MERGED_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(segments)]
        found = [self._encode_part(segments[a:b], special_strings) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return np.concatenate([ids for ids, _ in found]), np.concatenate([counts for _, counts in found])

    def _encode_part(self, segments: list[bytes], special_strings: bool) -> tuple[np.ndarray, np.ndarray]:
        pieces: list[str] = []
        owner: list[int] = []
        special: dict[int, int] = {}
        for k, raw in enumerate(segments):
            text = raw.decode("utf-8")
            if special_strings and self.split_special and self.split_special.search(text):
                for part in self.split_special.split(text):
                    if part in self.special:
                        special[len(pieces)] = self.special[part]
                    found = ["\0"] if part in self.special else self.pattern.findall(part)
                    pieces += found
                    owner += [k] * len(found)
                continue
            found = self.pattern.findall(text)
            pieces += found
            owner += [k] * len(found)
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(len(segments), np.int64)
        column = pa.array(pieces, pa.string())
        raw, at = arrow.text_bytes(column)
        ids, counts = self.merges.merge(self.byte_id[raw], at[:-1])
        at = np.cumsum(counts) - counts
        for k, token in special.items():
            ids[at[k]] = token
        return ids, np.bincount(np.array(owner), weights=counts, minlength=len(segments)).astype(np.int64)

    def encode_plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`unseen`, but special tokens' strings are ordinary text."""
        return self.plain.look_up(words, lambda new: self.encode_segments(new, False))

    def unseen(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode_segments`; what was merged before in this process is looked up."""
        return self.cache.look_up(segments, self.encode_segments)

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' bytes as text in UTF-8; bytes that are no UTF-8 become U+FFFD."""
        raw = arrow.gather(self.token_bytes, self.token_start[ids], self.token_size[ids]).tobytes()
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


# ---------------------------------------------------------------- lexicon


def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words, with an output on each arc.

    Suffixes are shared as words come in sorted order. ``skip`` of an arc is how many words pass before it
    at its state, so that the outputs on a word's path add up to its place in the sorted list.
    """
    known: dict[tuple, int] = {}
    arcs: list[tuple] = []  # of each finished state: (final, ((byte, state), ...))
    total: list[int] = []

    def finish(final: bool, out: list[tuple[int, int]]) -> int:
        key = (final, tuple(out))
        state = known.get(key)
        if state is None:
            state = known[key] = len(arcs)
            arcs.append(key)
            total.append(final + sum(total[s] for _, s in out))
        return state

    path: list[list] = [[False, [], -1]]  # open states: final, finished arcs, byte that led here
    last = b""
    for word in words:
        shared = len(os.path.commonprefix([last, word]))
        while len(path) > shared + 1:
            final, out, by = path.pop()
            path[-1][1].append((by, finish(final, out)))
        for b in word[shared:]:
            path.append([False, [], b])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        final, out, by = path.pop()
        path[-1][1].append((by, finish(final, out)))
    root = finish(path[0][0], path[0][1])
    keys, targets, skips = [], [], []
    for state, (final, out) in enumerate(arcs):
        before = int(final)
        for b, s in out:
            keys.append(state << 8 | b)
            targets.append(s)
            skips.append(before)
            before += total[s]
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    pick = lambda x, kind: np.array(x, kind)[order]
    return {"keys": pick(keys, np.int64), "targets": pick(targets, np.int32), "skips": pick(skips, np.int32), "final": np.array([f for f, _ in arcs], bool), "root": np.array([root])}


class Lexicon:
    """The automaton with the ids of its words, in arrays that may be memory-mapped."""

    NAMES = ("keys", "targets", "skips", "final", "root", "ids", "id_start", "id_size")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: list[bytes], vocab: Vocabulary) -> Lexicon:
        words = sorted(set(words))
        ids, counts = vocab.encode_segments(words)
        return cls(build_automaton(words) | {"ids": ids.astype(np.int32), "id_start": np.cumsum(counts) - counts, "id_size": counts})

    def save(self, path: str) -> None:
        """One file: a line of JSON that says where each array lies, then the arrays."""
        head, at = {}, 0
        for k in self.NAMES:
            a = np.ascontiguousarray(self.arrays[k])
            head[k] = (str(a.dtype), at, len(a))
            at += -(-a.nbytes // 64) * 64
        line = json.dumps(head).encode()
        with open(path, "wb") as f:
            f.write(line.ljust(1023) + b"\n")
            for k in self.NAMES:
                raw = np.ascontiguousarray(self.arrays[k]).tobytes()
                f.write(raw.ljust(-(-len(raw) // 64) * 64, b"\0"))

    @classmethod
    def load(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            head = json.loads(f.read(1024))
        whole = np.memmap(path, np.uint8, "r")
        return cls({k: whole[1024 + at : 1024 + at + n * np.dtype(t).itemsize].view(t) for k, (t, at, n) in head.items()})

    def find(self, words: pa.Array) -> np.ndarray:
        """Each word's place in the sorted lexicon, or -1. All words step through the automaton together."""
        _, offsets, data = words.buffers()
        at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        found = np.full(len(words), -1, np.int64)
        live, state, place, step = np.arange(len(words)), np.full(len(words), int(self.root[0]), np.int64), np.zeros(len(words), np.int64), 0
        while len(live):
            ended = at[live] + step == at[live + 1]
            if ended.any():
                good = ended & self.final[state]
                found[live[good]] = place[good]
                live, state, place = live[~ended], state[~ended], place[~ended]
            if not len(live) or not len(self.keys):
                break
            key = state << 8 | raw[at[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            live, arc = live[hit], arc[hit]
            state, place, step = self.targets[arc].astype(np.int64), place[hit] + self.skips[arc], step + 1
        return found


@lru_cache(maxsize=2)
def _mapped(file_name: str) -> Lexicon:
    return Lexicon.load(SparkFiles.get(file_name))


def ship(spark: SparkSession, lexicon: Lexicon) -> str:
    """Sends the lexicon's file to every executor; gives its name there. Its size is that of the lexicon's words."""
    handle, path = tempfile.mkstemp(prefix="lexicon-", suffix=".bin")
    os.close(handle)
    lexicon.save(path)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


# ---------------------------------------------------------------- encoding


def encode_texts(texts: pa.Array, vocab: Vocabulary, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): those of text i are ``ids[offsets[i]:offsets[i + 1]]``."""
    found = segments_of(texts)
    place = lexicon.find(found.words)
    known = place >= 0
    new_ids, new_sizes = vocab.unseen(found.words.filter(pa.array(~known)).to_pylist())
    flat = np.concatenate([np.asarray(lexicon.ids, np.int64), new_ids])
    starts, sizes = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    starts[known], sizes[known] = lexicon.id_start[place[known]], lexicon.id_size[place[known]]
    starts[~known], sizes[~known] = len(lexicon.ids) + np.cumsum(new_sizes) - new_sizes, new_sizes
    ids = arrow.gather(flat, starts[found.codes], sizes[found.codes])
    ends = np.concatenate([[0], np.cumsum(sizes[found.codes])])
    return ids, ends[found.offsets]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.json", lexicon_size: int = 65_536, decoded: bool = False) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers, as binary) of each whole text; with ``decoded`` the text of those ids too, as
    :func:`decode` adds it, but by the worker that has found them, so that a task needs one worker and no batch is sent twice.

    The lexicon is compiled from counts over all texts; it changes how ids are found, never which. Null and empty
    texts, and tables without rows, give empty ids. Repeated rows give repeated results; other columns play no part.
    """
    vocab = vocabulary(name)
    lexicon = Lexicon.compile([w for w, _ in frequent_words(docs, text_col, lexicon_size)], vocab)
    file_name = ship(docs.sparkSession, lexicon)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in arrow.by_bytes(batch, arrow.texts_of(batch.column(1)), PIECE_BYTES):
                ids, at = encode_texts(texts, vocabulary(name), _mapped(file_name))
                raw = ids.astype("<u4").tobytes()
                column = pa.array([raw[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                more = {"decoded": texts_of_ids(column, vocabulary(name))} if decoded else {}
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "ids": column} | more)

    own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return own.mapInArrow(encoded, "doc_id bigint, ids binary" + ", decoded string" * decoded)


def texts_of_ids(ids: pa.Array, vocab: Vocabulary) -> pa.Array:
    """The text of each row of ids as :func:`encode` gives them, a few rows at a time; null has the empty text."""
    parts = (ids.slice(k, DECODED_ROWS).to_pylist() for k in range(0, len(ids), DECODED_ROWS))
    found = [pa.array([vocab.decode(np.frombuffer(x or b"", "<u4")).decode() for x in part], pa.string()) for part in parts]
    return pa.concat_arrays(found) if found else pa.array([], pa.string())


def decode(encoded: DataFrame, name: str = "byte_bpe_50k.json") -> DataFrame:
    """Adds ``decoded``, the text of the ids, to rows of :func:`encode`; special tokens are kept."""

    @F.arrow_udf("string")
    def decoded(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(name)
        for column in ids:
            yield texts_of_ids(column, vocab)

    return encoded.withColumn("decoded", decoded("ids"))
