"""Best-fit packing planned on the histogram of lengths.

Texts become token pieces of bounded length. Only the histogram of lengths comes to the driver (at most ``size`` rows,
whatever the input). Best-fit decreasing runs over its counts and yields runs of slots; each piece then finds its slot from
its rank within its length, which is its place in its task plus the counts of earlier tasks.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowassay.llm.bpe import Merges, merge_rounds
from rowassay.llm.common import map_texts, ragged, sums_by_run, vocabulary
from rowassay.session import materialize

#: Words of these characters need no normalisation but lower case; all others go to the tokenizers library.
_PLAIN = "^[!-&(-~À-ÖØ-öø-ÿ]+$"
#: Classes of a word's bytes: letters stand together, digits alone, all else together. Bytes beyond ASCII are letters here.
_LETTER, _DIGIT, _OTHER = 0, 1, 2
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT


def _buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words in a row, and where words begin and the last one ends."""
    words = pa.concat_arrays([words])
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32, len(words) + 1, words.offset * 4)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def _strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    ends = np.append(starts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))


class Store:
    """Distinct words and the numbers a solver gives each of them, in arrays.

    ``solve`` turns a string array into (flat int array, lengths). Words are kept until there are ``limit`` of them, so the
    frequent ones, which come early, are solved once; any later word is solved whenever a slice has it.
    """

    def __init__(self, solve: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], limit: int = 150_000):
        self.solve, self.limit = solve, limit
        self.known = pa.array([], pa.string())
        self.flat, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words in a row, and how many each word has."""
        coded = words.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        place[new] = len(self.known) + np.arange(new.sum())
        flat, lengths = self.flat, self.lengths
        if new.any():
            unknown = coded.dictionary.filter(pa.array(new))
            more, sizes = self.solve(unknown)
            flat, lengths = np.concatenate([flat, more]), np.concatenate([lengths, sizes])
            if len(self.known) + len(unknown) <= self.limit:
                self.known, self.flat, self.lengths = pa.concat_arrays([self.known, unknown]), flat, lengths
        at = place[coded.indices.to_numpy()]
        return ragged(flat, (np.cumsum(lengths) - lengths)[at], lengths[at]), lengths[at]


class WordTokens:
    """Ids of a lower-casing, white-space-dropping BPE tokenizer with word ends, word by word.

    Equals ``tokenizers``' ``encode(text, add_special_tokens=False)``: its matches never hold white space, so the ids of
    a text are those of its words. Words of plain characters are cut into parts and merged here, many at once; any other is
    given to the library.
    """

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        # byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict(zip(own, map(chr, own)))
        for n, b in enumerate(b for b in range(256) if b not in shown):
            shown[b] = chr(256 + n)
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[shown[b] + end] for b in range(256)], np.int32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.merges = Merges([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], [vocab[a + b] for a, b in pairs], range(len(pairs)))
        self.parts = Store(self._merge)
        self.words = Store(self._solve)

    def _merge(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes, ends = _buffers(parts)
        symbols = self.inner[codes]
        symbols[ends[1:] - 1] = self.last[codes[ends[1:] - 1]]
        return merge_rounds(symbols, np.diff(ends).astype(np.int64), self.merges)

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of plain characters."""
        data, ends = _buffers(words)
        data = data.copy()
        upper = (data >= 65) & (data <= 90)
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] <= 0x9E) & (data[1:] >= 0x80)  # À to Þ
        data[upper] += 32
        kind = _CLASS[data]
        begins = np.ones(len(data), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins[ends[:-1]] = True
        starts = np.flatnonzero(begins)
        flat, sizes = self.parts.numbers(_strings(data, starts))
        return flat, sums_by_run(sizes, np.diff(np.searchsorted(starts, ends)))

    def _solve(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        empty = pc.equal(words, "")  # white space at an end of a text leaves one
        plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|")))
        other = np.flatnonzero(pc.invert(pc.or_(plain, empty)).to_numpy(zero_copy_only=False))
        plain = plain.to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(words), np.int64)
        flat, lengths[plain] = self._plain(words.filter(pa.array(plain))) if plain.any() else (np.zeros(0, np.int32), 0)
        if len(other):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            given = words.take(pa.array(other)).to_pylist()
            ids = [np.array(e.ids, np.int32) for e in self.library.encode_batch(given, add_special_tokens=False)]
            starts = np.cumsum(lengths) - lengths
            sizes = np.array([len(x) for x in ids])
            starts[other], lengths[other] = len(flat) + np.cumsum(sizes) - sizes, sizes
            flat = ragged(np.concatenate([flat, *ids]), starts, lengths)
        return flat, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        split = pc.ascii_split_whitespace(texts)
        flat, lengths = self.words.numbers(split.flatten())
        return flat, sums_by_run(lengths, pc.list_value_length(split).to_numpy())


def pieces(df: DataFrame, id_col: str, text_col: str, size: int, end_id: int, path: str) -> DataFrame:
    """Token pieces of every text: id, piece, start, length, ids_crc32, and the piece's place among those of its length in
    its task (_part, _place)."""

    def begin():
        tokens, part = WordTokens(path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)

        def work(texts):
            flat, lengths = tokens.encode(texts)
            lengths = lengths + 1
            ids = np.full(lengths.sum(), end_id, np.uint32)
            inner = np.ones(len(ids), bool)
            ends = np.cumsum(lengths)
            inner[ends - 1] = False
            ids[inner] = flat
            cuts = -(-lengths // size)
            row = np.repeat(np.arange(len(texts)), cuts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * size
            long = np.minimum(lengths[row] - start, size)
            at = (ends - lengths)[row] + start
            crc = np.array([zlib.crc32(ids[p : p + n]) for p, n in zip(at.tolist(), long.tolist())], np.int64)
            # place within the length: earlier slices first, then the order in this one
            order = np.argsort(long, kind="stable")
            of = long[order]
            place = np.empty(len(of), np.int64)
            place[order] = seen[of] + np.arange(len(of)) - np.searchsorted(of, of)
            np.add.at(seen, long, 1)
            each = pa.StructArray.from_arrays([pa.array(x) for x in (start, long, crc, place)], ["start", "length", "ids_crc32", "_place"])
            offsets = np.concatenate([[0], np.cumsum(cuts)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), each), pa.array(np.full(len(texts), part, np.int32))]

        return work

    kind = "_pieces array<struct<start:bigint,length:bigint,ids_crc32:bigint,_place:bigint>>, _part int"
    cut = map_texts(df, [id_col], text_col, kind, begin)
    return cut.select(id_col, "_part", F.posexplode("_pieces").alias("piece", "_p")).select(id_col, "piece", "_p.*", "_part")


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs of slots (length, first rank, slots per sequence, first sequence, offset).

    Ranks from a run's first to the next run's first of that length fill ``slots per sequence`` neighbouring slots of one
    sequence after another. Sequences alike are kept as one group, so the work depends on the histogram only.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, count)
    rooms: list[int] = []
    runs, sequences = [], 0

    def put(room, first, count):
        if room and count:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, count = size, sequences, -(-left // (size // length))
                sequences += count
            each = room // length
            full = min(count, left // each)
            if full:
                runs.append((length, rank, each, first, size - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < count:  # the last few share one sequence
                runs.append((length, rank, left, first + full, size - room))
                put(room - left * length, first + full, 1)
                put(room, first + full + 1, count - full - 1)
                left = 0
            else:
                put(room, first + full, count - full)
    return runs


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Give every text's token pieces a place in sequences of at most ``size`` tokens.

    Returns per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset; offsets of a sequence are gapless
    from 0. A null or empty text is the end id alone. Repeated rows are packed as often as they come; ties in length are
    placed in the order of tasks; an empty table gives no rows; other columns are not read.
    """
    cut = materialize(pieces(df, id_col, text_col, size, end_id, tokenizer or vocabulary("word_bpe_49k.json")), "pieces")
    counts = cut.groupBy("length", "_part").count()
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    runs = np.array(sorted(plan(histogram, size)), np.int64).reshape(-1, 5)
    names = [id_col, "piece", "start", "length", "ids_crc32"]

    def place(batches):
        keys = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            _, first, each, sequence, offset = runs[np.searchsorted(keys, length << 44 | rank, "right") - 1].T
            turn, slot = np.divmod(rank - first, each)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)] + [pa.array(sequence + turn), pa.array(offset + slot * length)], names=names + ["sequence_id", "offset"])

    ranked = cut.join(earlier, ["length", "_part"]).select(*names, (F.col("_place") + F.col("_before")).alias("_rank"))
    kind = df.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
