"""How far the term distributions of the sources of a language lie apart, audited exactly.

The price of a term between two sources depends on its two counts only. So for each pair of sources the joint table of count
levels is enough: how many terms have count x in one and y in the other. All these tables come from matrix products: a block of
terms is a matrix of indicator columns, one for each (source, count level), and its transpose times itself holds every joint
table of the block. Tables are priced in exact integers where they are made, and only sums per pair leave the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowassay.llm.common import lean, run_starts, runs, slices, tuned
from rowassay.session import discard, materialize

#: Shares are counted in units of one in so many.
UNITS = 1_000_000_000
#: About so many counts of a language come into one block of terms.
BLOCK = 1 << 18
#: Sources in one tile of a matrix, and its most columns; a block of terms with more levels is halved.
TILE, COLUMNS = 32, 1024
#: Bytes as terms see them: A-Z as a-z, other letters and everything beyond ASCII as they are, the rest as spaces.
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[:128] = [b | 32 if chr(b).isalpha() else 32 for b in range(128)]


def letters_only(texts: pa.Array) -> pa.Array:
    """The texts with every byte replaced by ``LETTERS``; only ASCII changes, so they stay valid UTF-8."""
    texts = pa.concat_arrays([texts])  # a slice of its own, which begins at its buffers' beginning
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    ends = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4)
    lower = LETTERS[np.frombuffer(data, np.uint8)[: ends[-1]]]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.tobytes()), pa.py_buffer(lower.tobytes()))


def _counted(batches):
    """(lang, source, term, occurrences, documents) of each slice of (lang, source, text), summed over its documents."""
    for batch in batches:
        for a, b in slices(pc.binary_length(batch.column(2)).to_pylist()):
            part = batch.slice(a, b - a)
            langs, sources = part.column(0).dictionary_encode(), part.column(1).dictionary_encode()
            wide = len(sources.dictionary)
            group = langs.indices.to_numpy().astype(np.int64) * wide + sources.indices.to_numpy()
            lists = pc.ascii_split_whitespace(letters_only(part.column(2)))
            flat, owner = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
            coded, owner = flat.filter(pa.array(real)).dictionary_encode(), owner[real]
            kinds = max(len(coded.dictionary), 1)
            inside, said = np.unique(owner * kinds + coded.indices.to_numpy(), return_counts=True)
            keys, at, docs = np.unique(group[inside // kinds] * kinds + inside % kinds, return_inverse=True, return_counts=True)
            names = langs.dictionary.take(pa.array(keys // kinds // wide)), sources.dictionary.take(pa.array(keys // kinds % wide))
            occurrences = pa.array(np.bincount(at, said, len(keys)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*names, coded.dictionary.take(pa.array(keys % kinds)), occurrences, pa.array(docs)], names=["lang", "source", "term", "n", "docs"]
            )


def priced(levels: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Sums of prices over terms for every pair of sources.

    ``levels[t, g]`` names the count level of term t in source g (equal counts, equal names; 0 for none) and ``shares[t, g]``
    is its share, an integer that follows from g and the level. The price of shares p, q is floor((p - q)^2 / (p + q)).
    """
    sources = levels.shape[1]
    total = np.zeros((sources, sources), np.int64)
    starts = range(0, sources, TILE)
    todo = [(0, len(levels))]
    while todo:
        a, b = todo.pop()
        tiles, crowded = [], False
        for s in starts:
            tile = _columns(levels[a:b, s : s + TILE], shares[a:b, s : s + TILE])
            if len(tile[1]) > COLUMNS and b - a > 32:
                crowded = True
                break
            tiles.append(tile)
        if crowded:
            middle = (a + b) // 2
            todo += [(a, middle), (middle, b)]
            continue
        for i, (hot_i, share_i, cut_i) in enumerate(tiles):
            for j in range(i, len(tiles)):
                hot_j, share_j, cut_j = tiles[j]
                joint = (hot_i.T @ hot_j).astype(np.int64)  # counts of at most the block's terms: exact in float32
                apart = share_i[:, None] - share_j[None, :]
                joint *= apart * apart // (share_i[:, None] + share_j[None, :])
                sums = np.add.reduceat(np.add.reduceat(joint, cut_i, 0), cut_j, 1)
                si, sj = starts[i], starts[j]
                total[si : si + len(cut_i), sj : sj + len(cut_j)] += sums
                if j > i:
                    total[sj : sj + len(cut_j), si : si + len(cut_i)] += sums.T
    return total


def _columns(levels: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indicator matrix of (source, level) for a tile of sources, the share of each column, and where sources begin."""
    terms, sources = levels.shape
    key = levels + np.arange(sources) * (int(levels.max(initial=0)) + 1)
    distinct, first, column = np.unique(key, return_index=True, return_inverse=True)
    hot = np.zeros((terms, len(distinct)), np.float32)
    hot[np.repeat(np.arange(terms), sources), column.ravel()] = 1
    source = first % sources
    return hot, shares.ravel()[first], np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))


def _joint(batches):
    """Rows (lang, block, term, source, n, share), sorted by lang, block, source; a source's row without a term tells its
    share of terms that it lacks. Gives (lang, source, item, value)."""
    for table in runs(batches, 2):
        bounds = run_starts(table, 2)
        for a, b in zip(bounds[:-1], bounds[1:]):
            part = table.slice(a, b - a).combine_chunks()
            empty = pc.is_null(part["term"]).to_numpy()
            sources = part["source"].filter(pa.array(empty))
            said = part.filter(pa.array(~empty))
            if not len(said) or len(sources) < 2:
                continue
            none = part["share"].filter(pa.array(empty)).to_numpy()
            coded = said["term"].combine_chunks().dictionary_encode()
            term, source = coded.indices.to_numpy(), pc.index_in(said["source"], sources.combine_chunks()).to_numpy()
            count = said["n"].to_numpy()
            whole = np.bincount(term, count, len(coded.dictionary))
            place = np.empty(len(whole), np.int64)
            place[np.argsort(whole, kind="stable")] = np.arange(len(whole))  # terms of like counts share their levels
            names, level = np.unique(count, return_inverse=True)
            levels = np.zeros((len(whole), len(sources)), np.int64)
            shares = np.tile(none, (len(whole), 1))
            levels[place[term], source] = level + 1
            shares[place[term], source] = said["share"].to_numpy()
            sums = priced(levels, shares)
            i, j = np.nonzero(~np.eye(len(sources), dtype=bool))
            lang = pa.array([part["lang"][0].as_py()]).take(pa.array(np.zeros(len(i), np.int64)))
            names = sources.combine_chunks()
            yield pa.RecordBatch.from_arrays([lang, names.take(pa.array(i)), names.take(pa.array(j)), pa.array(sums[i, j])], names=["lang", "source", "item", "value"])


def _share(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(UNITS * (n + 2) / (total + 2 * kinds)), exact at any size."""
    above = F.lit(UNITS).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")
    return 1 + F.call_function("div", above, (total + 2 * kinds).cast("decimal(19,0)"))


def _price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(df: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group of texts, and texts that have it."""
    docs = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = docs.mapInArrow(lean(_counted), "lang string, source string, term string, n bigint, docs bigint")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def divergence(
    df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 10, top: int = 10
) -> DataFrame:
    """Divergence of the sources of each language, and the terms that mark each source.

    Terms are runs of ASCII letters (A-Z as a-z) and characters beyond ASCII. A language keeps the V terms that at least
    ``least_docs`` of its texts have. A source of a language with n occurrences of a term and N of all kept terms has the share
    p = 1 + floor(10^9 (n + 2) / (N + 2 V)) of it, a language likewise; the price of two shares is floor((p - q)^2 / (p + q)).

    Returns lang, source, part, item, value, rank. Part ``pair``: item is every other source of the language, value the sum of
    prices over all kept terms. Part ``term``: item is a kept term that the source has with a larger share than the language,
    value its price; the first ``top``. Ranks from 1 by value, the largest first, then by item.

    Null language, source and text are ''. Texts without terms still make their source occur; a source whose language keeps no
    term has value 0 with every other. Repeated rows count each time. Other columns are not read.
    """
    tuned(df.sparkSession)
    groups = materialize(
        df.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct(),
        "groups",
    )
    counts = materialize(term_counts(df, lang, source, text), "counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).filter(F.col("docs") >= least_docs)
    kept = materialize(counts.join(terms.drop("docs"), ["lang", "term"]), "kept")
    discard(counts)
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
    langs = totals.groupBy("lang").agg(F.sum("total").alias("all"), F.sum("cells").alias("cells"))
    kinds = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kinds"))
    blocks = F.ceil(F.col("cells") / BLOCK).cast("int").alias("blocks")
    langs = langs.join(kinds, "lang").select("lang", "all", "kinds", blocks)
    sized = materialize(groups.join(totals.select("lang", "source", "total"), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total"]), "sizes")
    discard(groups)

    known = kept.join(sized, ["lang", "source"])
    share = _share(F.col("n"), F.col("total"), F.col("kinds"))
    cells = known.select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "term", "source", "n", share.alias("share"))
    lacking = sized.filter("kinds > 0").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"),
        "source", F.lit(0).cast("long").alias("n"), _share(F.lit(0).cast("long"), F.col("total"), F.col("kinds")).alias("share"),
    )
    dealt = cells.union(lacking).repartition("lang", "block").sortWithinPartitions("lang", "block", "source")
    sums = dealt.mapInArrow(lean(_joint), "lang string, source string, item string, value bigint")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = sized.select("lang", F.col("source").alias("item"))
    pairs = sized.select("lang", "source").join(other, "lang").filter(F.col("source") != F.col("item"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").fillna(0, ["value"])

    p, q = share, _share(F.col("whole"), F.col("all"), F.col("kinds"))
    marking = known.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    marking = marking.select("lang", "source", "item", _price(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    return ranked(pairs, "pair").union(ranked(marking, "term").filter(F.col("rank") <= top))
