"""Byte-pair merges of many words at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Stands for a pair that has no merge.
NONE = 1 << 40


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write each byte as."""
    printable = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    spare = iter(range(256, 512))
    return [chr(b if own else next(spare)) for b, own in enumerate(printable)]


class Merges:
    """Ranks of pairs of ids, and what each merge makes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        """Pair k, of rank k, becomes ``merged[k]``."""
        self.merged = merged
        keys = (left << 20) | right
        # open addressing from pair to rank: a probe or two instead of a search
        self.slots = 1 << (2 * len(keys)).bit_length()
        self.slot_key, self.slot_rank = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int64)
        waiting = np.arange(len(keys))
        place = self._place(keys)
        while len(waiting):
            free = self.slot_key[place[waiting]] < 0
            first = np.unique(place[waiting[free]], return_index=True)[1]
            put = waiting[free][first]
            self.slot_key[place[put]], self.slot_rank[place[put]] = keys[put], put
            waiting = np.setdiff1d(waiting, put, assume_unique=True)
            place[waiting] = np.where(self.slot_key[place[waiting]] >= 0, (place[waiting] + 1) % self.slots, place[waiting])

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 0x9E3779B1) >> 13) % self.slots

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; a large number if there is none."""
        place = self._place(keys)
        out = np.full(len(keys), NONE, np.int64)
        left = np.arange(len(keys))
        while len(left):
            held = self.slot_key[place[left]]
            hit = held == keys[left]
            out[left[hit]] = self.slot_rank[place[left[hit]]]
            left = left[~hit & (held >= 0)]
            place[left] = (place[left] + 1) % self.slots
        return out

    def merge(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words whose bytes' ids lie one after another, those of word k from ``starts[k]``.

        Each turn does, in every word, all merges of the word's lowest rank, from left to right; words
        without a merge left drop out.
        """
        ids = ids.copy()
        word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
        order = np.arange(len(ids))
        done_ids, done_word, done_order = [], [], []
        rank = np.full(len(ids), NONE, np.int64)
        if len(ids) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self.rank((ids[:-1] << 20) | ids[1:]), NONE)
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            over = np.repeat(least >= NONE, size)
            if over.any():
                done_ids.append(ids[over])
                done_word.append(word[over])
                done_order.append(order[over])
                live = ~over
                ids, word, order, rank, least, size = ids[live], word[live], order[live], rank[live], least[least < NONE], size[least < NONE]
                if not len(ids):
                    break
            hit = rank == np.repeat(least, size)
            twin = hit[1:] & hit[:-1]
            if twin.any():  # a run of one letter: every other place
                begins = hit.copy()
                begins[1:] &= ~hit[:-1]
                run = np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
                hit &= (np.arange(len(hit)) - run) % 2 == 0
            at = np.flatnonzero(hit)
            ids[at] = self.merged[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            new = np.cumsum(keep) - 1
            ids, word, order, rank = ids[keep], word[keep], order[keep], rank[keep]
            stale = np.zeros(len(ids), bool)
            stale[new[at]] = True
            stale[:-1] |= stale[1:]  # a neighbour's pair too, or one left over from another word: looked up again
            rank[stale] = NONE
            inner = np.flatnonzero(stale[:-1] & (word[:-1] == word[1:]))
            rank[inner] = self.rank((ids[inner] << 20) | ids[inner + 1])
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
        all_ids, all_word = np.concatenate(done_ids), np.concatenate(done_word)
        back = np.argsort(np.concatenate(done_order), kind="stable")
        return all_ids[back], np.bincount(all_word, minlength=len(starts))
