"""Quartile bucket digests: counts of hashed byte triplets, as quartiles, with the length; compared by a bounded score."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowassay.llm.common import lean, map_texts, slices, text_array

BUCKETS = 256
#: Offsets of a triplet's bytes. Wide gaps tell texts of one language apart: near bytes mostly say which language it is.
#: Adjacent bytes are there for the shortest texts: every text of three bytes has a triplet.
TRIPLETS = ((0, 4, 8), (0, 5, 11), (0, 3, 7), (0, 1, 2))
#: Most that lengths add to a difference; a step of length is a tenth.
LENGTH_BOUND = BUCKETS // 8
MOST = 3 * BUCKETS + LENGTH_BOUND


def digests(raw: list[bytes]) -> np.ndarray:
    """One row of ``BUCKETS`` quartile codes (0 to 3) and a length code for each byte string."""
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    doc = np.repeat(np.arange(len(raw)), sizes)
    counts = np.zeros(len(raw) * BUCKETS, np.int64)
    for kind, (i, j, k) in enumerate(TRIPLETS):
        at = np.flatnonzero(doc[:-k] == doc[k:])
        own = doc[at] * BUCKETS
        h = data[at + i] * np.uint32(0x9E3779B1) + data[at + j] * np.uint32(0x85EBCA77) + data[at + k] * np.uint32(0xC2B2AE3D) + np.uint32(kind * 0x27D4EB2F)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        counts += np.bincount(own + (h >> np.uint32(24)), minlength=len(counts))
    counts = counts.reshape(-1, BUCKETS)
    quartiles = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, :, None] > quartiles[:, None, :]).sum(axis=2)
    length = np.minimum(255, np.round(np.log1p(sizes) / np.log(1.1)))
    return np.concatenate([codes, length[:, None]], axis=1).astype(np.uint8)


def as_text(rows: np.ndarray) -> list[str]:
    """Two hexadecimal digits of length, then four buckets a byte."""
    four = rows[:, :BUCKETS].reshape(len(rows), -1, 4)
    packed = four[:, :, 0] | four[:, :, 1] << 2 | four[:, :, 2] << 4 | four[:, :, 3] << 6
    return [bytes(r).hex() for r in np.concatenate([rows[:, BUCKETS:], packed.astype(np.uint8)], axis=1)]


def from_text(texts: list[str]) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex("".join(texts)), np.uint8).reshape(len(texts), -1)
    codes = raw[:, 1:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
    return np.concatenate([codes.reshape(len(texts), -1), raw[:, :1]], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 for a difference of ``MOST``."""
    gap = np.abs(a.astype(np.int16) - b)
    return 1 - (gap[:, :BUCKETS].sum(axis=1) + np.minimum(gap[:, BUCKETS], LENGTH_BOUND)) / MOST


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the fingerprint of every whole text, in one pass. Null is the empty text; equal texts have equal
    fingerprints; repeated rows are kept; other columns are not read."""

    def begin():
        return lambda texts: [text_array(as_text(digests([t.encode() for t in texts.to_pylist()])))]

    return map_texts(df, [id_col], text_col, "fingerprint string", begin, limit=1 << 21)


def in_turn(df: DataFrame, id_col: str, text_col: str, schema: str, work) -> DataFrame:
    """Apply ``work`` to every text and the text that follows it, by ascending id, the first following the last.

    ``work`` gets a list of n + 1 texts and returns Arrow arrays of n rows. Rows are dealt out by ranges of the id whose
    bounds are ids of the table; a bound's row also goes, as a guest, to the range before it. So the texts move once, no
    task needs more than a slice of its range, and only the bounds come to the driver. A null id comes before all others;
    of rows with the same id the smaller text comes first.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    keyed = df.select(key.alias("_k"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    least = keyed.agg(F.min("_k")).head()[0]
    if least is None:
        return df.sparkSession.createDataFrame([], f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {schema}")
    cuts = keyed.select(F.col("_k").cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.25 / parts)
    # doubles round large ids; a bound must be an id, so take the first id from each cut on
    bounds = sorted({least, *(r[0] for r in _first_from(keyed, sorted(set(cuts))))})

    def deal(batches):
        at = np.array(bounds, np.int64)
        for batch in batches:
            k = batch.column(0).to_numpy()
            bucket = np.searchsorted(at, k, "right") - 1
            guest = np.flatnonzero(at[bucket] == k)
            every = pa.array(np.concatenate([np.arange(len(k)), guest]))
            shown = batch.take(every)
            bucket = np.concatenate([bucket, (bucket[guest] - 1) % len(at)]).astype(np.int32)
            flag = np.arange(len(bucket)) >= len(k)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(flag), *shown.columns], names=["_b", "_g", "_k", "_id", "_t"])

    kind = df.schema[id_col].dataType.simpleString()
    dealt = keyed.mapInArrow(lean(deal), f"_b int, _g boolean, _k long, _id {kind}, _t string")
    dealt = dealt.repartition(max(parts, len(bounds)), "_b").sortWithinPartitions("_b", "_g", "_k", "_t")
    names = [id_col] + [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        held = None  # a range's last text so far: its bucket, id (as an array) and text
        for batch in batches:
            bucket, guest, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist()
            ids = batch.column(3)
            if held:
                bucket, guest, texts = [held[0], *bucket], [False, *guest], [held[2], *texts]
                ids = pa.concat_arrays([held[1], ids])
            for a, b in _stretches(bucket, guest):
                for p, q in slices(map(len, texts[a : b - 1]), 1 << 21):
                    yield pa.RecordBatch.from_arrays([ids.slice(a + p, q - p), *work(texts[a + p : a + q + 1])], names=names)
            held = None if guest[-1] else (bucket[-1], ids.slice(len(texts) - 1), texts[-1])

    return dealt.select("_b", "_g", "_k", "_id", "_t").mapInArrow(lean(run), f"`{id_col}` {kind}, {schema}")


def _first_from(keyed: DataFrame, cuts: list[float]):
    """The first id at or after each cut."""

    def place(batches):
        for batch in batches:
            k = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, k.astype(np.float64), "right").astype(np.int32)), pa.array(k)], names=["p", "k"])

    return keyed.select("_k").mapInArrow(place, "p int, k long").groupBy("p").agg(F.min("k")).select("min(k)").collect() if cuts else []


def _stretches(bucket: list, guest: list) -> list[tuple[int, int]]:
    """Runs of rows of one bucket up to its first guest; a run's last row only follows the others."""
    found, start = [], 0
    for i in range(1, len(bucket) + 1):
        if i == len(bucket) or bucket[i] != bucket[i - 1] or guest[i - 1]:
            if i - start > 1 and not guest[start]:
                found.append((start, i))
            start = i
    return found


def edit_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, whose last half is the next text's first as many code points.

    Returns per row: ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null is
    the empty text, which is its own edited text. A table of one row follows itself; an empty table gives no rows.
    """
    schema = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def work(texts):
        raw = [t.encode() for t in texts]
        edited = [(t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode() for t, after in zip(texts, texts[1:])]
        own, changed = digests(raw), digests(edited)
        return [
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            text_array([hashlib.sha256(e).hexdigest() for e in edited]),
            text_array(as_text(own[:-1])),
            text_array(as_text(changed)),
            pa.array(likeness(own[:-1], changed)),
            pa.array(likeness(own[:-1], own[1:])),
        ]

    return in_turn(df, id_col, text_col, schema, work)
