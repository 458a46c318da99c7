"""Merge rounds of byte-pair encoding over flat numpy arrays, for many words at once."""

from __future__ import annotations

import numpy as np

_NONE = np.iinfo(np.int32).max


class Merges:
    """Ranked pairs of symbols and what they become; a lower rank merges first, of equal ranks the leftmost.

    ``left``, ``right``, ``into`` and ``rank`` are parallel arrays of numbers below 2**31.
    """

    def __init__(self, left, right, into, rank):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        into, rank = np.asarray(into, np.int32), np.asarray(rank, np.int32)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.into, self.rank = keys[order], into[order], rank[order]
        # A symbol is early if a pair that holds it ranks no later than a merge that makes it. After such a merge the new
        # pair may come before other places of the old one, so then only the leftmost place of a word merges in a round.
        size = int(max(left.max(initial=0), right.max(initial=0), into.max(initial=0))) + 1
        first = np.full(size, _NONE, np.int64)
        np.minimum.at(first, left, rank)
        np.minimum.at(first, right, rank)
        self.early = np.zeros(size, bool)
        self.early[into[first[into] <= rank]] = True

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; the rank of a pair that never merges is the largest int."""
        if not len(self.keys):
            return np.full(len(left), _NONE, np.int32), np.zeros(len(left), np.int32)
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], _NONE).astype(np.int32), self.into[at]


def merge_rounds(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of every word until no pair remains.

    ``symbols`` holds the words one after another, ``lengths`` their sizes (all at least 1). Each round finds the least
    pair rank of each word, merges all its places from the left (never overlapping ones), and closes the gaps. Returns
    the symbols and sizes that remain, in the words' order.
    """
    count = len(lengths)
    symbols, word = symbols.astype(np.int32), np.repeat(np.arange(count, dtype=np.int32), lengths)
    rank, into = np.full(len(symbols), _NONE, np.int32), np.zeros(len(symbols), np.int32)
    if len(symbols):
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], into[inner] = merges.look_up(symbols[inner], symbols[inner + 1])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.append(starts, len(word)))
        least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        ended = least == _NONE
        if ended.any():
            done.append((word[ended], symbols[ended]))
            on = ~ended
            symbols, word, rank, into, least = symbols[on], word[on], rank[on], into[on], least[on]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == least)
        # of places in a row every other one, counted from the left of their run
        run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
        first = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
        at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
        early = merges.early[into[at]]
        if early.any():
            # a word with an early result keeps its leftmost place only
            words = word[at]
            alone = np.isin(words, words[early])
            leftmost = np.concatenate([[True], words[1:] != words[:-1]])
            at = at[~alone | leftmost]
        symbols[at] = into[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        symbols, word, rank, into = symbols[keep], word[keep], rank[keep], into[keep]
        # new pairs: those that begin or end with a merged symbol
        at = moved[at]
        near = np.zeros(len(symbols) + 1, bool)
        near[at] = near[at - 1] = True  # the place before the first is the spare last one
        changed = np.flatnonzero(near[:-1])
        rank[changed] = _NONE
        if len(changed) and changed[-1] == len(symbols) - 1:
            changed = changed[:-1]
        changed = changed[word[changed] == word[changed + 1]]
        rank[changed], into[changed] = merges.look_up(symbols[changed], symbols[changed + 1])
    if not done:
        return symbols, np.zeros(count, np.int64)
    word, symbols = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(word, kind="stable")
    return symbols[order], np.bincount(word, minlength=count).astype(np.int64)
