"""Exact repeated substrings by maximal repeats of an enhanced suffix array, dealt out by anchors.

A byte string of ``length`` bytes is placed by its anchor, the ``ANCHOR``-byte string in it with the least hash; neighbouring
strings with one anchor form a stretch. Stretches that are alike as a whole are settled by sorting their hashes. The rest,
those that share an anchor but differ, meet as bytes: a stack scan over their suffix array and its common prefixes yields the
maximal repeats (the left-diverse intervals) with all their occurrences. Two equal strings always meet, as they have the same
anchor; no task needs more than the stretches of its anchors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowassay.llm.common import list_array, map_texts, mix64, runs
from rowassay.session import discard, materialize

ANCHOR = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_PLACE = 26  # bits of a place in a slice
_SPAN = 1 << _PLACE


class Powers:
    """Powers of the base, as far as slices need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int):
        if n > len(self.up):
            size = max(n, 1 << 16)
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _INVERSE))])
        return self.up, self.down


def stretches(data: np.ndarray, ends: np.ndarray, length: int, powers: Powers):
    """The stretches of texts that lie one after another, each with the end ``ends``.

    Returns parallel arrays: text number, start (in ``data``), size, hash of the anchor, hash of the whole stretch.
    """
    n, window = len(data), length - ANCHOR + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * down[:n], out=total[1:])
    code = mix64((total[ANCHOR:] - total[:-ANCHOR]) * up[: n - ANCHOR + 1])
    # the least hash of each window, of equal ones the leftmost: places in the low bits
    least = (code & ~np.uint64(_SPAN - 1)) | np.arange(len(code), dtype=np.uint64)
    reach = 1
    while 2 * reach <= window:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < window:
        least = np.minimum(least[: -(window - reach)], least[window - reach :])
    anchor = (least & np.uint64(_SPAN - 1)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(anchor)), "right")
    inside = np.arange(len(anchor)) + length <= ends[text]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new & inside)
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + length
    whole = (total[stop] - total[start]) * up[start]
    return text[start], start, stop - start, code[anchor[start]], mix64(whole + (stop - start).astype(np.uint64))


def _stretch_rows(df: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    def begin():
        powers = Powers()

        def work(texts):
            raw = [t.encode() for t in texts.to_pylist()]
            sizes = np.array([len(r) for r in raw], np.int64)
            data = np.frombuffer(b"".join(raw), np.uint8)
            found = [[] for _ in range(4)]
            counts = np.zeros(len(raw), np.int64)
            if len(data) <= _SPAN // 2:
                parts = [(0, data, np.cumsum(sizes))]
            else:  # a very long text: pieces that overlap by a string less a byte, so that each string is in one piece
                step, begin_ = _SPAN // 2, np.cumsum(sizes) - sizes
                parts = [(int(s + o), data[s + o : min(s + n, s + o + step + length - 1)], None) for s, n in zip(begin_, sizes) for o in range(0, int(n), step)]
            for at, piece, ends in parts:
                own = int(np.searchsorted(np.cumsum(sizes), at, "right")) if ends is None else 0
                text, start, size, anchor, whole = stretches(piece, np.array([len(piece)]) if ends is None else ends, length, powers)
                text = text + own
                first = (np.cumsum(sizes) - sizes)[text] if len(text) else text
                counts += np.bincount(text, minlength=len(raw))
                for column, values in zip(found, (anchor.view(np.int64), whole.view(np.int64), (start + at - first).astype(np.int64), size)):
                    column.append(values)
            anchor, whole, place, size = (np.concatenate(c) for c in found)
            return [list_array(anchor, counts), list_array(whole, counts), list_array(place << 8 | size, counts)]

        return work

    schema = "anchors array<bigint>, wholes array<bigint>, places array<bigint>"
    listed = map_texts(df, [id_col], text_col, schema, begin, limit=1 << 21)
    return listed.select(F.col(id_col).alias("doc"), F.explode(F.arrays_zip("anchors", "wholes", "places")).alias("s")).select(
        F.col("s.anchors").alias("anchor"), F.col("s.wholes").alias("whole"), "doc", F.col("s.places").alias("place")
    )


def _settle(batches):
    """Of rows sorted by (anchor, whole, doc, place): stretches of a later document than the first that holds them are
    repeats as a whole; first stretches that share their anchor with a different one of another document are left open.

    What waits for the next batch is the first stretches of the last anchor, and of those no more than three once it is known
    that they are open.
    """
    held = None  # columns anchor, whole, doc, place, sent
    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(4)] + [np.zeros(len(batch), bool)]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        anchor, whole, doc, place, sent = columns
        if not len(anchor):
            continue
        group = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        like = group | np.concatenate([[True], whole[1:] != whole[:-1]])
        first = doc[like][np.cumsum(like) - 1]
        repeat = doc > first
        heads = np.flatnonzero(~repeat)
        group_of = np.cumsum(group) - 1
        # an anchor is open if two of its first stretches differ and lie in different documents
        low = np.full(group_of[-1] + 1, np.iinfo(np.int64).max)
        high = np.full(group_of[-1] + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, group_of[heads], doc[heads])
        np.maximum.at(high, group_of[heads], doc[heads])
        open_ = low < high
        last = group_of == group_of[-1]
        out = repeat | (~repeat & open_[group_of] & ~sent)
        yield pa.RecordBatch.from_arrays([pa.array(repeat[out]), pa.array(anchor[out]), pa.array(doc[out]), pa.array(place[out])], names=["settled", "anchor", "doc", "place"])
        keep = np.flatnonzero(last & ~repeat)
        if open_[-1]:
            keep = np.unique([keep[np.argmin(doc[keep])], keep[np.argmax(doc[keep])], keep[-1]])
            sent = np.ones(len(sent), bool)
        held = [c[keep] for c in (anchor, whole, doc, place, sent)]


def maximal_repeats(data: np.ndarray, ends: np.ndarray, length: int):
    """Maximal repeats of at least ``length`` bytes within strings that lie one after another.

    An enhanced suffix array: suffixes in order, with the common prefix of neighbours. A stack scan finds the intervals of
    suffixes with a common prefix; an interval whose suffixes follow different bytes (or a string's start) cannot be
    extended to the left, and is a maximal repeat. Yields (starts of all occurrences, size).
    """
    if not len(data):
        return
    string = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    left = ends[string] - np.arange(len(data))
    at = np.flatnonzero(left >= length)
    if len(at) < 2:
        return
    width = -(-int(left.max()) // 8)
    padded = np.concatenate([data, np.zeros(8 * width, np.uint8)])
    blocks = np.zeros((width, len(at)), np.uint64)
    for k in range(8 * width):
        # bytes after a suffix's end count as zeros; sizes are compared below
        byte = np.where(left[at] > k, padded[at + k], 0).astype(np.uint64)
        blocks[k // 8] |= byte << np.uint64(56 - 8 * (k % 8))
    order = np.lexsort(blocks[::-1])
    at, blocks = at[order], blocks[:, order]
    common = np.zeros(len(at) - 1, np.int64)
    going = np.ones(len(at) - 1, bool)
    for block in blocks:
        differ = block[1:] ^ block[:-1]
        for k in range(8):
            going &= (differ >> np.uint64(56 - 8 * k)) & np.uint64(255) == 0
            common += going
        if not going.any():
            break
    common = np.minimum(common, np.minimum(left[at[1:]], left[at[:-1]]))
    begins = np.concatenate([[0], ends[:-1]])
    before = np.where(np.isin(at, begins), -1 - np.arange(len(at)), data[at - 1].astype(np.int64))
    # only runs of neighbours with a long common prefix hold repeats
    long = np.concatenate([[False], common >= length, [False]])
    edges = np.flatnonzero(long[1:] != long[:-1])
    sizes, letters = common.tolist(), before.tolist()
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        stack: list[list] = []  # common prefix, first suffix, letter before all of them (None: different ones)
        for i in range(a, b + 1):
            size = sizes[i] if i < b else 0
            first, letter = i, letters[i]
            while stack and stack[-1][0] > size:
                top = stack.pop()
                if top[2] is not None and top[2] != letter:
                    top[2] = None
                if top[2] is None:
                    yield at[top[1] : i + 1], top[0]
                first, letter = top[1], top[2]
            if stack and stack[-1][0] == size:
                if stack[-1][2] != letter:
                    stack[-1][2] = None
            elif size >= length:
                stack.append([size, first, letter])


def _repeats(length: int):
    """Of open stretches as bytes, sorted by anchor: the places that a document repeats from a smaller one."""

    def run(batches):
        for table in runs(batches, 1):
            raw = table["bytes"].combine_chunks()
            offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            ends = (offsets[1:] - offsets[0]).astype(np.int64)
            doc, place = table["doc"].to_numpy(), table["place"].to_numpy()
            longest = np.zeros(len(data), np.int64)
            string = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
            owner = doc[string]
            for starts, size in maximal_repeats(data, ends, length):
                own = owner[starts]
                later = starts[own > own.min()]
                longest[later] = np.maximum(longest[later], size)
            hit = np.flatnonzero(longest)
            first = np.concatenate([[0], ends[:-1]])[string[hit]]
            yield pa.RecordBatch.from_arrays([pa.array(owner[hit]), pa.array((place[string[hit]] + hit - first) << 8 | longest[hit])], names=["doc", "place"])

    return run


def _bytes_of(batches):
    for batch in batches:
        for row in range(len(batch)):
            anchors, places = batch.column(1).slice(row, 1).flatten().to_numpy(), batch.column(2).slice(row, 1).flatten().to_numpy()
            text = batch.column(3)[row].as_py().encode()
            parts = [text[p >> 8 : (p >> 8) + (p & 255)] for p in places.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors), pa.array(np.full(len(places), batch.column(0)[row].as_py(), np.int64)), pa.array(places >> 8), pa.array(parts, pa.binary())],
                names=["anchor", "doc", "place", "bytes"],
            )


def _cut(batches):
    for batch in batches:
        rows = []
        for text, places in zip(batch.column(1).to_pylist(), batch.column(2)):
            raw = text.encode()
            if not places.is_valid or not len(places):
                rows.append((len(raw), [], raw))
                continue
            marks = np.sort(places.values.to_numpy())
            start, reach = marks >> 8, np.minimum(np.maximum.accumulate((marks >> 8) + (marks & 255)), len(raw))
            new = np.concatenate([[True], start[1:] > reach[:-1]])
            spans = list(zip(start[new].tolist(), reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1].tolist()))
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            rows.append((len(raw), [{"start": a, "end": b} for a, b in spans], b"".join([*kept, raw[at:]])))
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(span)), pa.array([r[2] for r in rows], pa.binary())],
            names=["_id", "n_bytes", "removed", "kept"],
        )


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Texts as UTF-8 without the bytes of any ``length``-byte string that also starts in a row with a smaller id.

    Returns per row: ``id_col``, n_bytes, removed (array of start and end, maximal runs) and kept (binary: the other bytes, one
    after another). Strings are judged on the input, overlaps count, matches never cross texts. ``length`` is 20 to 130.
    Null texts are empty. A row without an id is neither cut nor a source. Repeated rows are cut alike, as none is smaller than the
    other; of an id with several texts each text is cut where any of them is. Other columns are not read.
    """
    if not ANCHOR <= length <= 130:  # a stretch's size has eight bits
        raise ValueError("length must be from 20 to 130")
    docs = df.select(F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = _stretch_rows(docs.filter("_doc IS NOT NULL"), "_doc", "_text", length)
    sorted_ = rows.repartition("anchor").sortWithinPartitions("anchor", "whole", "doc", "place")
    met = materialize(sorted_.mapInArrow(_settle, "settled boolean, anchor long, doc long, place long").distinct(), "stretches")
    open_ = met.filter("NOT settled").groupBy("doc").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("place").alias("places"))
    parts = open_.join(docs, F.col("doc") == F.col("_doc")).select("doc", "anchors", "places", "_text").mapInArrow(_bytes_of, "anchor long, doc long, place long, bytes binary")
    repeats = parts.repartition("anchor").sortWithinPartitions("anchor", "doc", "place").mapInArrow(_repeats(length), "doc long, place long")
    marks = materialize(met.filter("settled").select("doc", "place").union(repeats), "marks")
    discard(met)
    marks = marks.groupBy("doc").agg(F.collect_list("place").alias("places"))
    cut = docs.join(marks, F.col("_doc") == F.col("doc"), "left").select("_doc", "_text", "places").mapInArrow(
        _cut, "_id long, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept binary"
    )
    return cut.select(F.col("_id").cast(df.schema[id_col].dataType).alias(id_col), "n_bytes", "removed", "kept")
