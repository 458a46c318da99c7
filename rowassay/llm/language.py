"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The likelihood of a word sums over all ways to
cut it into pieces (a forward pass over its characters); a text's is the product over its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowassay.llm.common import Words, map_texts, sums_by_run, text_array, vocabulary

_SPACE = "▁"
#: Pieces of more characters than this, the mark of a word's start included, are left out.
LONGEST = 8
#: Texts of each language that its probabilities are learned from, at most: those with the smallest hash of their id.
SAMPLE = 250
UNKNOWN = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """The pieces (as numbers) at every place of words; a character that is no piece has the spare number ``size``."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.tables = []
        hashes = [self._hash(p) for p in pieces]
        for n in range(1, LONGEST + 1):
            own = np.array([i for i, p in enumerate(pieces) if len(p) == n], np.int64)
            keys = np.array([hashes[i] for i in own], np.uint64)
            order = np.argsort(keys)
            starts = np.unique(np.array([self._hash(p[:n]) for p in pieces if len(p) > n], np.uint64))
            self.tables.append((keys[order], own[order], starts))

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % 2**64
        return h

    def edges(self, words: list[str]):
        """Of words in ascending order of length: lengths, and for each n the start places (flat) and numbers of pieces."""
        text = _SPACE + _SPACE.join(words)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters up to the word's end
        at, h, found = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        for n, (keys, numbers, starts) in enumerate(self.tables, 1):
            on = left[at] >= n
            at, h = at[on], h[on]
            h = h * _BASE + codes[at + n - 1] + np.uint64(1)
            hit = _member(keys, h)
            piece = numbers[np.minimum(np.searchsorted(keys, h[hit]), max(0, len(keys) - 1))] if len(keys) else np.zeros(0, np.int64)
            places = at[hit]
            if n == 1:
                places, piece = np.concatenate([places, at[~hit]]), np.concatenate([piece, np.full((~hit).sum(), self.size)])
            found.append((places, piece))
            on = _member(starts, h)
            at, h = at[on], h[on]
        return lengths, found


def _member(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h), bool)
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h


def _by_place(lengths, found, end: bool):
    """The edges in order of where in their word they end (or start): (n, word, place, piece) for each place in turn."""
    first = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(lengths)), lengths)
    n = np.concatenate([np.full(len(p), k) for k, (p, _) in enumerate(found, 1)])
    start = np.concatenate([p for p, _ in found])
    piece = np.concatenate([q for _, q in found])
    w = word[start]
    start = start - first[w]
    key = start + n if end else start
    order = np.lexsort((w, n, key))
    return n[order], w[order], start[order], piece[order], key[order]


def log_likelihoods(words: list[str], lattice: Lattice, logs: np.ndarray) -> np.ndarray:
    """For each word and language, the log of the summed probability of all segmentations. ``logs``: pieces by languages."""
    out = np.zeros((len(words), logs.shape[1]))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        # words of like length together, so that the table of prefixes stays small
        longest = max(12, 2 * len(words[order[at]]))
        end = at
        while end < len(order) and end - at < 20_000 and len(words[order[end]]) <= longest and (end - at + 1) * (len(words[order[end]]) + 2) < 400_000:
            end += 1
        end = max(end, at + 1)
        own = order[at:end]
        out[own] = _forward(*lattice.edges([words[i] for i in own]), logs)[0]
        at = end
    return out


def _forward(lengths, found, logs):
    n, word, start, piece, stop = _by_place(lengths, found, True)
    alpha = np.full((lengths.max() + 1, len(lengths), logs.shape[1]), -np.inf)
    alpha[0] = 0
    cuts = np.flatnonzero(np.concatenate([[True], (stop[1:] != stop[:-1]) | (n[1:] != n[:-1])]))
    for a, b in zip(cuts, np.append(cuts[1:], len(n))):
        w, i = word[a:b], stop[a]
        alpha[i, w] = np.logaddexp(alpha[i, w], alpha[i - n[a], w] + logs[piece[a:b]])
    return alpha[lengths, np.arange(len(lengths))], alpha


def _expected(words: list[str], weights: np.ndarray, lattice: Lattice, logs: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces over all segmentations of weighted words, under one language (``logs``: a column)."""
    counts = np.zeros(lattice.size + 1)
    order = np.argsort([len(w) for w in words], kind="stable")
    for a in range(0, len(order), 20_000):
        own = order[a : a + 20_000]
        lengths, found = lattice.edges([words[i] for i in own])
        total, alpha = _forward(lengths, found, logs)
        beta = np.full(alpha.shape, -np.inf)
        beta[lengths, np.arange(len(own))] = 0
        n, word, start, piece, _ = _by_place(lengths, found, False)
        cuts = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1]) | (n[1:] != n[:-1])]))
        for x, y in reversed(list(zip(cuts, np.append(cuts[1:], len(n))))):
            w, i = word[x:y], start[x]
            beta[i, w] = np.logaddexp(beta[i, w], beta[i + n[x], w] + logs[piece[x:y]])
        share = np.exp(alpha[start, word, 0] + logs[piece, 0] + beta[start + n, word, 0] - total[word, 0])
        counts += np.bincount(piece, share * weights[own][word], minlength=len(counts))
    return counts


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    logs: np.ndarray  # pieces (and the spare number) by languages
    letters: np.ndarray  # for each language, how many letters it is written in


def letter_pieces(path: str) -> list[str]:
    """The pieces of the vocabulary that are lower-case letters, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in every if len(p) <= LONGEST and p == p.lower() and (p == _SPACE or p.removeprefix(_SPACE).isalpha())})


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = 3, smooth: float = 0.05) -> Model:
    """Piece probabilities of each language from its words' counts: expectation-maximisation over all segmentations."""
    lattice, columns = Lattice(pieces), []
    for language in sorted(counts):
        words = list(counts[language])
        weights = np.array([counts[language][w] for w in words], float)
        logs = np.full((len(pieces) + 1, 1), -np.log(len(pieces) + 1))
        for _ in range(rounds):
            found = _expected(words, weights, lattice, logs) + smooth
            found[-1] = smooth / 10  # a character that is no piece says nothing about the language
            logs = np.log(found / found[:-1].sum())[:, None]
        columns.append(logs[:, 0])
    logs = np.stack(columns, axis=1) if columns else np.zeros((len(pieces) + 1, 0))
    logs[-1] = logs.min() - 1 if logs.size else 0
    return Model(sorted(counts), pieces, logs, np.array([_letters(counts[c]) for c in sorted(counts)], float))


def _letters(counts: dict[str, int]) -> int:
    """Letters that make up 99.9 % of a language's words, and one for the start of a word."""
    found: dict[str, int] = {}
    for word, n in counts.items():
        for c in word:
            found[c] = found.get(c, 0) + n
    sizes = np.sort(np.array(list(found.values()), float))[::-1]
    return 1 + int((np.cumsum(sizes) < 0.999 * sizes.sum()).sum()) + 1


def _letter_words(texts: pa.Array) -> pa.Array:
    """Lists of the runs of letters, in lower case; an end may leave an empty word."""
    return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " "))


def train(df: DataFrame, language_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, path: str | None = None) -> Model:
    """Learn from at most ``sample`` texts of each non-null language. Only counts of distinct words of the sample come to
    the driver. Null texts and ids are passed over."""
    known = df.filter(F.col(language_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    # ids and languages only are ranked; the rank limit applies before rows of a language meet
    turn = Window.partitionBy("_lang").orderBy("_h", "_id")
    chosen = known.select(F.col(id_col).alias("_id"), F.col(language_col).cast("string").alias("_lang"), F.xxhash64(id_col).alias("_h")).withColumn("_n", F.row_number().over(turn)).filter(F.col("_n") <= sample)
    texts = known.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen.select("_id", "_lang").distinct()), "_id")

    def begin():
        def work(texts):
            lists = _letter_words(texts)
            return [lists]

        return work

    words = map_texts(texts, ["_lang"], "_text", "words array<string>", begin).select("_lang", F.explode("words").alias("word")).filter("word <> ''")
    counts: dict[str, dict[str, int]] = {}
    for r in words.groupBy("_lang", "word").count().collect():
        counts.setdefault(r["_lang"], {})[r["word"]] = r["count"]
    return fit(counts, letter_pieces(path or vocabulary("piece_bpe_32k.model")))


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), into: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """Language of every whole text: the columns of ``keep``, and ``into``: the language and its share of the likelihood
    (0 to 1); if a third column is named, also how much better, in nats a letter, that language explains the text than its
    letters drawn alike often. Letter junk and scripts that no learned language has are under 0 there (null without a letter).

    A text that is null or has no letter is ``und`` with score 0; so is every text if no language was learned. Ties go to
    the language that is first by name. Repeated rows are kept; other columns are not read. Names of ``into`` must not be among ``keep``.
    """

    def begin():
        lattice, width = Lattice(model.pieces), len(model.languages)

        def solve(words):
            values = log_likelihoods(words, lattice, model.logs)
            values[[not w for w in words]] = 0
            return values.ravel(), np.full(len(words), width)

        store = Words(solve)

        def work(texts):
            lists = _letter_words(texts)
            words, counts = lists.flatten(), pc.list_value_length(lists).to_numpy()
            said = pc.not_equal(words, "").to_numpy(zero_copy_only=False).astype(np.int64)
            letters = sums_by_run(said, counts) > 0
            if not width:
                return [text_array([UNKNOWN] * len(texts)), pa.array(np.zeros(len(texts))), pa.nulls(len(texts), pa.float64())][: len(into)]
            total = sums_by_run(store.numbers(words)[0].reshape(-1, width), counts)
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
            made = [text_array(names), pa.array(np.where(letters, share, 0.0))]
            if len(into) > 2:
                # a word's start counts as a letter, as it does for the pieces
                size = sums_by_run((pc.utf8_length(words).to_numpy() + 1) * said, counts)
                gain = total.max(axis=1) / np.maximum(size, 1) + np.log(model.letters[best])
                made.append(pa.array(gain, mask=~letters))
            return made

        return work

    return map_texts(df, list(keep), text_col, ", ".join(f"{name} {kind}" for name, kind in zip(into, ("string", "double", "double"))), begin)
