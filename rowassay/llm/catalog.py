"""The registered queries of the operators in this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowassay.llm import contamination, divergence, fingerprints, jaccard, language, neighbours, packing, pagetext, passages, periods, quality, sentencepieces, substrings
from rowassay.llm.common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_substrings(spark, sf_dir):
    done = substrings.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_html(spark, sf_dir):
    return pagetext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op3_passages(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op4_fingerprints(spark, sf_dir):
    return fingerprints.edit_likeness(table(spark, sf_dir, "documents"))


@query
def op5_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op6_jaccard(spark, sf_dir):
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


@query
def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = language.train(docs.filter(~held))
    return language.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op9_sentencepiece(spark, sf_dir):
    done = sentencepieces.round_trip(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("piece_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = quality.train(docs, labels.filter(~held), "quality")
    done = quality.score(docs, model).select("doc_id", held.alias("held_out"), "score")
    return done.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op11_divergence(spark, sf_dir):
    """Divergence of the sources of each language and the terms that mark each source, over all documents."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE["op11_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*)::HUGEINT AS kinds, sum(whole)::HUGEINT AS everything FROM kept GROUP BY lang),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * v.kinds) AS p,
        1 + (1000000000::HUGEINT * (whole + 2)) // (v.everything + 2 * v.kinds) AS q
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query
def op12_contamination(spark, sf_dir):
    """Words of every document that lie in a passage of a benchmark item."""
    done = contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLACES = "unnest(range(1, len(w) - m + 2)) AS s"
ORACLE["op12_contamination"] = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w, least(len(w), 10) AS m FROM benchmark),
iw AS (SELECT item_id, m, array_to_string(w[s : s + m - 1], ' ') AS passage FROM (SELECT *, {_PLACES} FROM i WHERE m > 0)),
dw AS (SELECT k, s, m, array_to_string(w[s : s + m - 1], ' ') AS passage
      FROM (SELECT *, {_PLACES} FROM d, (SELECT DISTINCT m FROM i WHERE m > 0))),
hit AS (SELECT k, s, m, passage FROM dw SEMI JOIN iw USING (m, passage)),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + m)) AS p FROM hit) GROUP BY k),
items AS (SELECT k, list(DISTINCT item_id::VARCHAR) AS items FROM hit JOIN iw USING (m, passage) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""


@query
def op13_periods(spark, sf_dir):
    """Periodic runs of every document, after every tenth one's words have been made to repeat; digests of runs and of kept words."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", periods.looped(F.col("text"), F.col("doc_id")).alias("text"))
    done, best = periods.periodic_runs(docs), F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return done.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.call_function("div", best["length"] * 1000, best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
