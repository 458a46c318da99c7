"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's fingerprint is the set of least k-gram hashes in each window of ``span`` consecutive words; two texts that share ``span``
words share the least hash of those words, so joining fingerprints finds every text with a benchmark passage. Only such texts
are looked at again: a hit is extended to all windows of the text that are windows of an item, compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowassay.session import discard, materialize

#: Words of a k-gram; every ``span - KGRAM + 1`` neighbouring k-grams give their least hash.
KGRAM = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits and of characters beyond ASCII, A-Z as a-z; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() reads characters beyond ASCII as well, so it serves ASCII texts only
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _hashed(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))


#: More than any array has; the largest int would overflow when added to a start.
_REST = 1 << 30


def _shifted(df: DataFrame, reach: int, keep: list[str]) -> DataFrame:
    """A row per element of ``h``: its place, the one before it as h0, itself as h1 and those after it up to h<reach>, null past
    the ends. Arrays are shifted and zipped, so that what follows is generated code on numbers, which must stay small: the JVM
    does not compile long methods."""
    shifted = [F.concat(F.array(F.lit(None).cast("long")), "h").alias("h0"), F.col("h").alias("h1")]
    shifted += [F.slice("h", i, _REST).alias(f"h{i}") for i in range(2, reach + 1)]
    places = F.sequence(F.lit(0), F.size("h")).alias("place")
    return df.select(*keep, F.inline(F.arrays_zip(places, *shifted))).filter("h1 IS NOT NULL")


def _grams(h: Column, k: int) -> Column:
    """Hashes of all ``k`` neighbours in ``h``: runs twice as long are made of two, until only a part of one is missing."""
    made, reach = h, 1
    while reach < k:
        step = min(reach, k - reach)
        made, reach = F.zip_with(made, F.slice(made, step + 1, _REST), lambda a, b: F.xxhash64(a, b)), reach + step
    return F.slice(made, 1, F.greatest(F.size(h) - (k - 1), F.lit(0)))  # beyond that, neighbours were missing


def fingerprints(df: DataFrame, keep: list[str], span: int) -> DataFrame:
    """``keep`` and print: of every ``span`` consecutive words the least k-gram hash, once while it stays the least."""
    k = min(KGRAM, span)
    wide = span - k + 1
    grams = _hashed(df, keep).select(*keep, _grams(F.col("h"), k).alias("h"))

    def least(first: int) -> Column:
        return F.least(*[f"h{first + i}" for i in range(wide)]) if wide > 1 else F.col(f"h{first}")

    rows = _shifted(grams, wide, keep).filter(F.col(f"h{wide}").isNotNull())
    return rows.filter(F.col("h0").isNull() | (least(0) != least(1))).select(*keep, least(1).alias("print"))


def _windows(df: DataFrame, keep: list[str], lengths: list[int]) -> DataFrame:
    """``keep``, place, length and hash of all runs of words of the given lengths."""
    runs = [F.when(F.col(f"h{m}").isNotNull(), F.xxhash64(*[f"h{i}" for i in range(1, m + 1)])) for m in lengths]
    structs = [F.struct(F.lit(m).alias("length"), run.alias("hash")) for m, run in zip(lengths, runs)]
    return _shifted(_hashed(df, keep), max(lengths), keep).select(*keep, "place", F.inline(F.array(*structs))).filter("hash IS NOT NULL")


def contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", span: int = 10
) -> DataFrame:
    """Words of each document that lie in a passage of a benchmark item, and the items.

    A window is ``span`` consecutive words of an item; an item of fewer words is one window. A document's word is hit if it lies
    in any occurrence of a window. Returns one row per row of ``docs``: doc_id, n_words, n_hit, items (ids of the items with an
    occurring window as text, sorted as text, each once) and spans (array of start and end: runs of hit words).

    Null and empty texts, and those without a word, have no words; such items have no window. Items of one id are one item; an
    item without an id marks words but is not listed. Repeated documents each get their row; documents may lack an id. Other
    columns are not read.
    """
    # One key a row, whatever its id; tokenised once. The written table is what every later step reads.
    told = docs.select(F.col(doc_id).alias("_id"), words_of(F.col(text)).alias("words"))
    kept = materialize(told.select(F.monotonically_increasing_id().alias("key"), "_id", F.size("words").cast("long").alias("n_words"), "words"), "words")
    said = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).filter(F.size("words") > 0)
    said = materialize(said.select("item", "words", F.least(F.size("words"), F.lit(span)).alias("size")), "items")
    # at most ``span`` numbers, whatever the size of the benchmark
    lengths = sorted(r["size"] for r in said.select("size").distinct().collect()) or [span]
    shorter = [m for m in lengths if m < span]

    # An item of ``span`` words or more is found by its winnowed hashes, a shorter one by the hash of the whole.
    prints = fingerprints(said.filter(F.col("size") == span), ["item"], span)
    if shorter:
        whole = _windows(said.filter(F.col("size") < span), ["item", "size"], shorter)
        prints = prints.union(whole.filter(F.col("length") == F.col("size")).select("item", "hash"))
    prints = materialize(prints.select("print").distinct(), "prints")
    long_enough = kept.filter(F.col("n_words") >= lengths[0])
    own = fingerprints(long_enough, ["key"], span)
    if shorter:
        own = own.union(_windows(long_enough, ["key"], shorter).select("key", "hash"))
    near = materialize(own.join(prints, "print", "left_semi").select("key").distinct(), "near")
    # Words travel as one line each: as an array a word takes three times its bytes in a shuffle.
    suspects = materialize(kept.select("key", F.array_join("words", " ").alias("line")).join(near, "key", "left_semi"), "suspects")
    discard(near)
    spoken = F.split("line", " ")

    # Windows of items, each once: a hash to find it by, its words to be sure. Who has it comes later, for those that occur.
    of_items = _windows(said, ["item", "words", "size"], lengths).filter(F.col("length") == F.col("size"))
    passage = F.slice("words", F.col("place") + 1, F.col("length")).alias("passage")
    of_items = materialize(of_items.select("item", "length", "hash", passage).distinct(), "passages")
    found = _windows(suspects.select("key", spoken.alias("words")), ["key"], lengths)
    found = materialize(found.join(of_items.select("length", "hash", "passage").distinct(), ["length", "hash"]), "found")
    checked = suspects.join(found, "key").filter(F.slice(spoken, F.col("place") + 1, F.col("length")) == F.col("passage"))
    hits = materialize(checked.select("key", "place", "length", "hash", "passage"), "hits")
    discard(suspects)
    discard(found)

    # Hit words of a document: runs of windows that overlap or touch.
    before = Window.partitionBy("key").orderBy("place", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = hits.select("key", "place", (F.col("place") + F.col("length")).alias("end")).distinct().withColumn("reach", F.max("end").over(before))
    order = Window.partitionBy("key").orderBy("place", "end")
    parts = reach.withColumn("run", F.sum(F.when(F.col("place") <= F.col("reach"), 0).otherwise(1)).over(order))
    runs = parts.groupBy("key", "run").agg(F.min("place").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("key").agg(
        F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")
    )
    named = hits.select("key", "length", "hash", "passage").distinct().join(of_items, ["length", "hash", "passage"]).filter("item IS NOT NULL")
    named = named.select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    result = kept.select("key", "_id", "n_words").join(spans, "key", "left").join(named, "key", "left")
    return result.select(
        F.col("_id").alias(doc_id),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )

