"""Access to the public tokenizer files; a path that exists is used as it is."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marlpit.llm.arrow import gather, places
from marlpit.llm.arrow import text_bytes as arrow_bytes
from marlpit.llm.merges import Merges, byte_letters


def vocabulary_path(name: str) -> str:
    """A file's path: ``name`` itself if it exists, else that of the public file of this name."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(name: str):
    """The tokenizer, once per worker process, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary_path(name))
    found.no_truncation()
    found.no_padding()
    return found


class WordCache:
    """Ids of words met before in this worker process. Emptied before it would hold more than ``most`` words or ``most_ids`` ids; words longer than
    ``longest`` and their ids aren't kept at all, so that memory is bounded whatever the texts are."""

    def __init__(self, most: int = 250_000, longest: int = 64, most_ids: int = 4_000_000):
        self.most, self.longest, self.most_ids = most, longest, most_ids
        self.clear()

    def clear(self) -> None:
        self.slot: dict = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def look_up(self, words: list, encode: Callable[[list], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of distinct words; ``encode`` is asked for the new ones."""
        get = self.slot.get
        slots = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new, old = np.flatnonzero(slots < 0), np.flatnonzero(slots >= 0)
        fresh = [words[k] for k in new.tolist()]
        new_ids, new_sizes = encode(fresh) if fresh else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        sizes = np.zeros(len(words), np.int64)
        sizes[old], sizes[new] = self.size[slots[old]], new_sizes
        begins, at = np.cumsum(sizes) - sizes, np.cumsum(new_sizes) - new_sizes
        ids = np.zeros(int(sizes.sum()), np.int32)
        ids[places(begins[old], sizes[old])] = self.ids[places(self.start[slots[old]], sizes[old])]
        ids[places(begins[new], new_sizes)] = new_ids
        self._keep(fresh, new_ids, at, new_sizes)
        return ids, sizes

    def _keep(self, words: list, ids: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> None:
        short = [k for k, w in enumerate(words) if len(w) <= self.longest]
        own = gather(ids, at[short], sizes[short])
        if len(self.slot) + len(short) > self.most or self.used + len(own) > self.most_ids:
            self.clear()
        if len(short) > self.most or len(own) > self.most_ids:
            return
        n, m = len(self.slot), len(self.slot) + len(short)
        if m > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * m), np.resize(self.size, 2 * m)
        if self.used + len(own) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + len(own)))
        self.ids[self.used : self.used + len(own)] = own
        self.start[n:m], self.size[n:m] = self.used + np.cumsum(sizes[short]) - sizes[short], sizes[short]
        self.used += len(own)
        self.slot.update(zip([words[k] for k in short], range(n, m), strict=True))


@lru_cache(maxsize=4)
def _cache(name: str) -> WordCache:
    return WordCache()


#: How a tokenizers file must prepare texts for its pieces to be cut as :func:`pieces_of` does.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Words that are cut here: printable ASCII and Latin letters that are one code point, without special strings and contractions.
PLAIN = r"^[!-&(-;=-{}~À-ÖØ-öø-ÿ]+$"


@lru_cache(maxsize=4)
def _merges(name: str) -> tuple[Merges, np.ndarray] | None:
    """The file's merges, and the ids of bytes, then those of bytes at the end of a piece; none if it isn't of this kind."""
    with open(vocabulary_path(name), encoding="utf-8") as f:
        found = json.load(f)
    model, cut = found["model"], found["pre_tokenizer"] or {}
    patterns = [x.get("pattern") for x in cut.get("pretokenizers", [])]
    if found["normalizer"] != NORMALIZER or patterns != [{"Regex": PIECES}, None] or model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    sides = ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs])
    letters = byte_letters()
    return Merges(*(np.array([vocab[x] for x in side], np.int64) for side in sides)), np.array([vocab[c] for c in letters] + [vocab[c + "</w>"] for c in letters], np.int64)


def pieces_of(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of lower-case plain words: runs of letters, digits one by one, runs of the rest."""
    digit = (raw >= 48) & (raw <= 57)
    kind = np.where((raw >= 97) & (raw <= 122) | (raw >= 128), 1, 2)
    begins = np.ones(len(raw), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | digit[1:] | digit[:-1]
    begins[at[:-1]] = True
    return np.flatnonzero(begins)


def encode_distinct(name: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of each word of an array of distinct words, none of them empty.

    The tokenizer must drop white space (as ``word_bpe_49k.json`` does), so that a text's ids are its
    words' ids one after another: white space is then a safe boundary. No special string holds white space. Plain words
    are cut and merged together here; all others are words that the library encodes, each as a text of its own.
    """
    known = _merges(name)
    if known is None or not len(words):
        return _cache(name).look_up(words.to_pylist(), lambda new: by_library(name, new))
    merges, byte_id = known
    plain = pc.match_substring_regex(words, PLAIN)
    raw, at = arrow_bytes(pc.utf8_lower(words.filter(plain)))
    first = pieces_of(raw, at)
    own = raw.astype(np.int64)
    own[np.append(first[1:], len(raw))[: len(first)] - 1] += 256
    ids, counts = merges.merge(byte_id[own], first)
    place = np.searchsorted(first, at)
    plain = plain.to_numpy(zero_copy_only=False)
    sizes = np.zeros(len(words), np.int64)
    sizes[plain] = np.diff(np.concatenate([[0], np.cumsum(counts)])[place])
    if plain.all():
        return ids, sizes
    other_ids, sizes[~plain] = _cache(name).look_up(words.filter(pa.array(~plain)).to_pylist(), lambda new: by_library(name, new))
    starts = np.zeros(len(words), np.int64)
    starts[plain] = np.cumsum(sizes[plain]) - sizes[plain]
    starts[~plain] = len(ids) + np.cumsum(sizes[~plain]) - sizes[~plain]
    return gather(np.concatenate([ids, other_ids]), starts, sizes), sizes


def by_library(name: str, words: list[str], step: int = 16384) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of words by the library, each as a text of its own."""
    tokenizer, found = load(name), []
    for at in range(0, len(words), step):
        found += [np.array(x.ids, np.int32) for x in tokenizer.encode_batch_fast(words[at : at + step], add_special_tokens=False)]
    return np.concatenate([np.zeros(0, np.int32), *found]), np.array([len(x) for x in found], np.int64)
