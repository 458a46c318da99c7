"""Periodic runs of words, by recompression.

The words of a slice of texts stand in one row of numbers, a mark after each text. Rounds of compression replace, in turn,
every block of one symbol and every pair of a left and a right symbol by a new symbol, alike wherever they stand; the levels
that this gives are a grammar of the whole row. How far two places agree is read off it by climbing while whole symbols agree
and descending where they part: a few steps a level.

For a period q, places a grid step apart are tried, so that every run of that period has one of them: where the word there is
the word q further on, the two places are extended to both sides through the grammar, which gives the exact stretch.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowassay.llm.common import SLICE, map_texts, mix64

#: Places of the grid that are tried at once.
BATCH = 1 << 20
#: The mark after each text; never part of a block or a pair.
MARK = 0


def _renamed(keys: np.ndarray, base: int) -> tuple[np.ndarray, int]:
    """Equal keys get equal numbers from ``base`` on."""
    distinct, names = np.unique(keys, return_inverse=True)
    return names + base, base + len(distinct)


class Grammar:
    """Levels of a run-length grammar over numbers; 0 is a mark, and both ends must be marks.

    ``symbols[h]`` is the row of level h. ``parent[h]`` gives, for a place there, the place above it in level h + 1, and
    ``first[h]``, ``last[h]`` the leftmost and rightmost place below one of level h + 1.
    """

    #: Rounds end when the row has shrunk to this many symbols a text, or after so many rounds; the rest is compared one by one.
    SMALL, ROUNDS = 3, 160

    def __init__(self, row: np.ndarray):
        self.symbols, self.parent, self.first, self.last, self.of_blocks = [row], [], [], [], []
        texts, names, still = int((row == MARK).sum()), int(row.max()) + 1, 0
        for r in range(self.ROUNDS):
            if len(row) <= self.SMALL * texts or still > 24:
                break
            joined = self._blocks(row) if r % 2 == 0 else self._pairs(row, r)
            if not joined.any():
                still += 1
                continue
            still = 0
            start = np.flatnonzero(np.concatenate([[True], ~joined]))
            size = np.diff(np.append(start, len(row)))
            above = row[start].copy()
            grown = np.flatnonzero(size > 1)
            if r % 2 == 0:
                key = (row[start[grown]].astype(np.uint64) << np.uint64(32)) | size[grown].astype(np.uint64)
            else:
                key = (row[start[grown]].astype(np.uint64) << np.uint64(32)) | row[start[grown] + 1].astype(np.uint64)
            above[grown], names = _renamed(key, names)
            self.of_blocks.append(r % 2 == 0)
            self.parent.append(np.repeat(np.arange(len(start)), size))
            self.first.append(start)
            self.last.append(start + size - 1)
            self.symbols.append(above)
            row = above

    @staticmethod
    def _blocks(row: np.ndarray) -> np.ndarray:
        """Which places, from the second on, belong to the place before: the same symbol."""
        return (row[1:] == row[:-1]) & (row[1:] != MARK)

    @staticmethod
    def _pairs(row: np.ndarray, r: int) -> np.ndarray:
        """The same for pairs: the place before has a left symbol, this one a right symbol, drawn anew each round."""
        right = (mix64(row.astype(np.uint64) + (np.uint64(r) << np.uint64(40))) & np.uint64(1)).astype(bool)
        real = row != MARK
        return (~right & real)[:-1] & (right & real)[1:]

    def agreement(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How many symbols of level 0 agree from places ``a`` and ``b`` on, to the right or to the left.

        The two rows of symbols must part somewhere, as they do at a mark that only one of them has reached.
        """
        near, far, sign = (self.first, self.last, 1) if forward else (self.last, self.first, -1)
        top = len(self.parent)
        a0, a, b = a, a.copy(), b.copy()
        level = np.full(len(a), top, np.int64)
        going = np.arange(len(a))
        for h in range(top):
            going = self._stopped(h, going, a, b, level)
            if not len(going):
                break
            up_a, up_b = self.parent[h][a[going]], self.parent[h][b[going]]
            inside = (near[h][up_a] != a[going]) | (near[h][up_b] != b[going])
            if inside.any():
                # a symbol that is entered midway is left first: of a pair its second, of a block what is left of it
                some = going[inside]
                left = np.minimum(np.abs(far[h][up_a[inside]] - a[some]), np.abs(far[h][up_b[inside]] - b[some])) + 1
                a[some] += sign * left
                b[some] += sign * left
                # where blocks of unlike length were left, one place is still inside its block: symbols differ
                going = np.concatenate([going[~inside], self._stopped(h, some, a, b, level)])
            a[going], b[going] = self.parent[h][a[going]], self.parent[h][b[going]]
        while len(going):
            going = self._stopped(top, going, a, b, level)
            a[going] += sign
            b[going] += sign
        for h in range(top, 0, -1):
            at = np.flatnonzero(level >= h)
            if len(at):
                self._descend(h - 1, at, a, b, near, sign)
        return np.abs(a - a0)

    def _stopped(self, h: int, going: np.ndarray, a: np.ndarray, b: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Those that agree at their places; for the others the level is noted."""
        same = self.symbols[h][a[going]] == self.symbols[h][b[going]]
        level[going[~same]] = h
        return going[same]

    def _descend(self, h: int, at: np.ndarray, a: np.ndarray, b: np.ndarray, near: list, sign: int) -> None:
        """From two unlike symbols of level h + 1 to the first unlike ones of level h."""
        far = self.last if near is self.first else self.first
        up_a, up_b = a[at], b[at]
        a[at], b[at] = near[h][up_a], near[h][up_b]
        same = self.symbols[h][a[at]] == self.symbols[h][b[at]]
        some, up_a, up_b = at[same], up_a[same], up_b[same]
        # two blocks of one symbol share the shorter one; two pairs, or a pair and a lone symbol, their first
        shared = np.minimum(np.abs(far[h][up_a] - a[some]), np.abs(far[h][up_b] - b[some])) + 1 if self.of_blocks[h] else 1
        a[some] += sign * shared
        b[some] += sign * shared


def _grid(sizes: np.ndarray, starts: np.ndarray, least: int, times: int):
    """Batches of (place, period): for each period, places so near to each other that every run has one that it covers
    together with the place a period further on."""
    longest = sizes // times
    text = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(len(text)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    step = np.maximum(least, times * period) - period
    count = np.maximum((sizes[text] - period - 1) // step + 1, 0)
    ends = np.cumsum(count)
    done = 0
    while done < len(text):
        stop = max(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + BATCH, "right")), done + 1)
        n = count[done:stop]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield starts[np.repeat(text[done:stop], n)] + k * np.repeat(step[done:stop], n), np.repeat(period[done:stop], n)
        done = stop


def runs_of(row: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in a row of numbers whose texts are closed by marks, sorted by start and period.

    The row begins with a mark of its own. A run is a stretch of at least ``least`` numbers and ``times`` smallest periods
    that cannot be extended.
    """
    marks = np.flatnonzero(row == MARK)
    starts, sizes = marks[:-1] + 1, np.diff(marks) - 1
    fit = sizes >= least
    grammar, found = None, [np.zeros((0, 3), np.int64)]
    for place, period in _grid(sizes[fit], starts[fit], least, times):
        alike = row[place] == row[place + period]
        place, period = place[alike], period[alike]
        if not len(place):
            continue
        grammar = grammar or Grammar(row)
        start = place - grammar.agreement(place - 1, place + period - 1, forward=False)
        end = place + period + grammar.agreement(place, place + period, forward=True)
        good = end - start >= np.maximum(least, times * period)
        found.append(np.unique(np.stack([start[good], end[good], period[good]], 1), axis=0))
    every = np.unique(np.concatenate(found), axis=0)
    # the same stretch under several periods: they are multiples of the smallest, which comes first
    new = np.ones(len(every), bool)
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    every = every[new]
    return tuple(every[np.lexsort((every[:, 2], every[:, 0]))].T)


def kept_words(size: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words stay: of each run its first period, unless another run drops it."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change)[:size] == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _begin(least: int, times: int):
    def begin():
        def work(texts: pa.Array) -> list[pa.Array]:
            lists = pc.ascii_split_whitespace(texts)
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
            flat, owner = flat.filter(pa.array(real)), owner[real]
            sizes = np.bincount(owner, minlength=len(lists))
            coded = flat.dictionary_encode()
            row = np.zeros(len(flat) + len(lists) + 1, np.int64)
            row[np.arange(len(flat)) + owner + 1] = coded.indices.to_numpy().astype(np.int64) + 1
            first = np.cumsum(sizes + 1) - sizes
            start, end, period = runs_of(row, least, times)
            text = np.searchsorted(first, start, "right") - 1
            runs, best, words = [[] for _ in range(len(lists))], [None] * len(lists), [None] * len(lists)
            cut = np.flatnonzero(np.diff(np.concatenate([[-1], text, [-1]])))
            ends = np.cumsum(sizes)
            for a, b in zip(cut[:-1], cut[1:]):
                t = int(text[a])
                s, e, p = start[a:b] - first[t], end[a:b] - first[t], period[a:b]
                runs[t] = [{"start": x, "length": y - x, "period": z} for x, y, z in zip(s.tolist(), e.tolist(), p.tolist())]
                best[t] = max(runs[t], key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]))
                stay = np.flatnonzero(kept_words(int(sizes[t]), s, e, p)) + (ends[t] - sizes[t])
                words[t] = " ".join(flat.take(pa.array(stay)).to_pylist())
            plain = [t for t in range(len(lists)) if words[t] is None]
            for t in plain:
                words[t] = " ".join(flat.slice(ends[t] - sizes[t], sizes[t]).to_pylist())
            return [pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(words, pa.string())]

        return work

    return begin


def periodic_runs(
    df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", least: int = 24, times: int = 3, limit: int = SLICE
) -> DataFrame:
    """Runs of words in each text, and the text without their repeats.

    Words are what ASCII white space parts, numbered from 0. A run is a stretch of consecutive words with smallest period q
    (words q apart are the same) of at least ``least`` words and ``times`` periods (2 or more) that no neighbouring word
    extends. Returns per row: the columns ``keep``, n_words, runs (array of start, length, period, by start and period),
    strongest (the run of the greatest length in periods; then the smallest start, then period; null if there is none) and
    collapsed (the words that no run holds after its first period, one space between them).

    Null texts have no words. Every row is judged by itself, so repeated rows get equal results; other columns are not read.
    Texts are worked on whole, about ``limit`` bytes at a time, and a longer one by itself.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    run = "struct<start:bigint,length:bigint,period:bigint>"
    schema = f"n_words bigint, runs array<{run}>, strongest {run}, collapsed string"
    return map_texts(df, list(keep), text_col, schema, _begin(least, times), limit)


def looped(text: Column, key: Column) -> Column:
    """Every tenth text, by the crc32 of its key, with its words from some place on repeating in some period.

    Of h = crc32(key) and g = floor(h / 10), texts with h % 10 = 0 and n > 0 words are changed: each word i >= a becomes
    word a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null key changes nothing.
    """
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def built(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda _, i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # words are bound once by a lambda of their own, so that they are not split anew for each of them
    once = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, built(w)).otherwise(F.lit(""))), 1)
    return F.when(h % 10 == 0, once).otherwise(text)
