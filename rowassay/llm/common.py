"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; a longer text is a slice of its own.
SLICE = 1 << 21


#: Rows of an Arrow batch. Texts are long: Spark's own default would put tens of megabytes into each batch, once in the
#: JVM and once in the Python worker of every running task.
BATCH_ROWS = 2000


def tuned(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ``BATCH_ROWS``; how rows are put into batches changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, in a session tuned for long texts."""
    tuned(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; the same package is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_mod(column: str, divisor: int):
    """crc32 of a column's text, modulo a divisor; null stays null."""
    return F.crc32(F.col(column).cast("string")) % divisor


def slices(sizes: Iterable[int], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Neighbouring items put together until they reach the limit; every item is in exactly one slice."""
    first, total, end = 0, 0, 0
    for end, size in enumerate(sizes, 1):
        total += size
        if total >= limit:
            yield first, end
            first, total = end, 0
    if end > first:
        yield first, end


def lean(run: Callable) -> Callable:
    """The same function of batches; what a task has freed goes back to the machine when it ends.

    Python workers are kept for later tasks, and without this they keep the most memory that any task has needed.
    """

    def wrapped(batches):
        import ctypes

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def map_texts(df: DataFrame, keep: list[str], text: str, schema: str, begin: Callable[[], Callable], limit: int = SLICE) -> DataFrame:
    """Apply a function to whole texts, a slice of an Arrow batch at a time, without a shuffle.

    ``begin()`` runs once a task and returns a function from an Arrow string array of texts (null as "") to a list of
    Arrow arrays, which follow the columns of ``keep``. ``schema`` names and types those arrays.
    """
    kept = df.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    names = keep + [part.split()[0] for part in schema.split(", ")]
    types = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches):
        work = begin()
        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in slices(pc.binary_length(texts).to_pylist(), limit):
                made = work(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(keep))] + made, names=names)

    return kept.mapInArrow(lean(run), ", ".join(types + [schema]))


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one after another."""
    if not len(lengths):
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


def text_array(values: list) -> pa.Array:
    return pa.array(values, pa.string())


class Words:
    """Distinct words of a task and the numbers a solver has given each of them.

    ``solve`` turns a list of words into (flat int array, lengths). The store is emptied once it holds ``limit`` words, so
    its memory is bounded however many words a task sees; results do not depend on that.
    """

    def __init__(self, solve: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 150_000):
        self.solve, self.limit = solve, limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.starts = self.lengths = np.zeros(0, np.int64)

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words in a row, and how many each word has."""
        if len(self.index) > self.limit:
            self._clear()
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.index]
        if new:
            flat, lengths = self.solve(new)
            base, known = len(self.flat), len(self.index)
            self.index.update(zip(new, range(known, known + len(new))))
            self.starts = np.concatenate([self.starts, base + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, flat])
        at = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        return ragged(self.flat, self.starts[at], lengths), lengths


def sums_by_run(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes, empty runs included."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def list_array(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes() -> Words:
    """A store that gives every word one 64-bit hash, and the empty word none."""
    from xxhash import xxh3_64_intdigest

    def solve(words):
        found = np.array([xxh3_64_intdigest(w.encode()) for w in words if w], np.uint64)
        return found, np.array([bool(w) for w in words], np.int64)

    return Words(solve)


def hashed_words(texts: pa.Array, store: Words, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of anything but ASCII white space) in a row, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, said = store.numbers(lists.flatten())
    return flat.astype(np.uint64), sums_by_run(said, pc.list_value_length(lists).to_numpy())


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first ``keys`` columns, cut into tables that each hold whole runs of equal keys.

    A table holds all runs that end in a batch, so many small runs come together; only the last run waits for more.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        last = np.ones(len(table), bool)
        for k in range(keys):
            column = table.column(k)
            last &= pc.fill_null(pc.equal(column, column[len(table) - 1]), False).to_numpy()
        start = int(np.argmax(last)) if last.any() else len(table) - 1
        if start:
            yield table.slice(0, start)
        held = table.slice(start).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def run_starts(table: pa.Table, keys: int) -> np.ndarray:
    """Where runs of equal keys begin, the end of the table included."""
    new = np.zeros(len(table) + 1, bool)
    new[[0, -1]] = True
    for k in range(keys):
        column = table.column(k).to_numpy()
        new[1:-1] |= column[1:] != column[:-1]
    return np.flatnonzero(new)
