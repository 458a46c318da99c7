"""Divergence of sources, benchmark contamination and periodic runs, each against a plain version."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SMALL

from rowassay.llm import catalog, contamination, divergence, periods


def lowered(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# -- divergence -----------------------------------------------------------------


def plain_divergence(rows, least_docs=10, top=10):
    rows = [{k: r[k] or "" for k in ("lang", "source", "text")} for r in rows]
    said = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(r["text"])) for r in rows]
    docs, groups, langs = Counter(), {}, {}
    for r, words in zip(rows, said):
        groups.setdefault((r["lang"], r["source"]), Counter())
        docs.update((r["lang"], w) for w in set(words))
    kept = {}
    for (lang, w), n in docs.items():
        if n >= least_docs:
            kept.setdefault(lang, set()).add(w)
    for r, words in zip(rows, said):
        mine = [w for w in words if w in kept.get(r["lang"], ())]
        groups[r["lang"], r["source"]].update(mine)
        langs.setdefault(r["lang"], Counter()).update(mine)

    def share(counts, w, v):
        return 1 + 10**9 * (counts[w] + 2) // (sum(counts.values()) + 2 * v)

    out = set()
    for (lang, source), counts in groups.items():
        terms = kept.get(lang, set())
        p = {w: share(counts, w, len(terms)) for w in terms}
        values = []
        for (other_lang, other), theirs in groups.items():
            if other_lang == lang and other != source:
                q = {w: share(theirs, w, len(terms)) for w in terms}
                values.append(("pair", other, sum((p[w] - q[w]) ** 2 // (p[w] + q[w]) for w in terms)))
        for w in terms:
            q = share(langs[lang], w, len(terms))
            if counts[w] > 0 and p[w] > q:
                values.append(("term", w, (p[w] - q) ** 2 // (p[w] + q)))
        for part, limit in (("pair", None), ("term", top)):
            ordered = sorted((v for v in values if v[0] == part), key=lambda v: (-v[2], v[1].encode()))
            out |= {(lang, source, part, item, value, i + 1) for i, (_, item, value) in enumerate(ordered[:limit])}
    return out


def test_divergence_of_the_small_tables(spark, small):
    rows = catalog.QUERIES["op11_divergence"](spark, SMALL).collect()
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == plain_divergence(small)


def test_divergence_of_odd_rows(spark, odd, empty):
    rows = [r.asDict() for r in odd.collect()]
    for least, top in ((1, 3), (2, 10), (50, 10)):
        got = divergence.divergence(odd, least_docs=least, top=top).collect()
        assert {tuple(r) for r in got} == plain_divergence(rows, least, top) and len(got) == len(set(got))
    assert divergence.divergence(empty).count() == 0
    texts = [("en", "a", "Tie tie"), ("en", "b", "tie"), ("en", "c", None), (None, None, "tie ÄÖ äö"), ("en", "a", "Tie tie"), ("en", "", "x9y")]
    frame = spark.createDataFrame([(*t, 1, "z") for t in texts], "lang string, source string, text string, term int, value string")
    got = divergence.divergence(frame, least_docs=1).collect()
    assert {tuple(r) for r in got} == plain_divergence([dict(zip(("lang", "source", "text"), t)) for t in texts], 1)


def test_prices_by_matrix_equal_prices_by_term(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "COLUMNS", 40)
    for sources in (2, 3, 8):
        levels = rng.integers(0, 60, (300, sources))
        by_level = rng.integers(1, 10**9, (sources, 60))
        shares = by_level[np.arange(sources), levels]
        p, q = shares[:, :, None], shares[:, None, :]
        want = ((p - q) ** 2 // (p + q)).sum(0)
        assert (divergence.priced(levels, shares) == want).all()


# -- contamination --------------------------------------------------------------


def plain_contamination(docs, items, span=10):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))

    windows = {}
    for item, text in items:
        w = words(text)
        m = min(span, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    sizes, out = {len(w) for w in windows}, []
    for doc, text in docs:
        w, hit, met = words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                found = windows.get(tuple(w[i : i + m]))
                if found:
                    hit |= set(range(i, i + m))
                    met |= found
        out.append((doc, len(w), len(hit), sorted(str(i) for i in met if i is not None)))
    return sorted(out, key=repr)


def test_contamination_of_the_small_tables(spark, small):
    rows = catalog.QUERIES["op12_contamination"](spark, SMALL).collect()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    want = plain_contamination([(r["doc_id"], r["text"]) for r in small], items)
    digests = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in want]
    assert sorted((tuple(r) for r in rows), key=repr) == sorted(digests, key=repr)
    assert any(r["contaminated"] for r in rows) and not all(r["contaminated"] for r in rows)


def test_contamination_of_odd_rows(spark, odd, empty):
    items = [
        (1, "one two"), (2, "the"), (3, None), (4, ""), (5, "!!"), (None, "lead and trail"), (1, "12 345 6 7"), (7, "tie tie tie tie"),
        (10, "word " * 14), (11, "Word " * 10), (12, "a b c d e f g h i j k l"), (12, "one two"), (13, "É é"),
    ]
    bench = spark.createDataFrame([(*i, "x", 2) for i in items], "item_id long, text string, words string, key int")
    texts = [("y", "x a b c d e f g h i j k"), ("y", "b c d e f g h i j x a b"), ("y", "c d e f g h i j k l b c d e f g h i j k l"), ("z", "é é É"), ("z", "tie tie tie tie tie")]
    more = spark.createDataFrame([(i, t, "l", s, 1, "x", [1]) for i, (s, t) in enumerate(texts, 900)], odd.schema)
    docs = odd.union(more)
    for span in (10, 3):
        got = contamination.contaminated(docs, bench, span=span).collect()
        want = plain_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], items, span)
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=repr) == want
        assert all(r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in got)
    assert contamination.contaminated(empty, bench).count() == 0
    none = contamination.contaminated(docs, bench.limit(0)).collect()
    assert len(none) == docs.count() and all(r["n_hit"] == 0 and r["items"] == [] for r in none)


def test_contamination_plan_is_native(spark, documents):
    plan = catalog.QUERIES["op12_contamination"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- periodic runs ----------------------------------------------------------------


def plain_runs(words, least=24, times=3):
    """(start, length, period), by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_random_rows():
    rng = np.random.default_rng(5)
    for _ in range(400):
        kinds, row, want = int(rng.integers(1, 5)), [0], []
        for _ in range(int(rng.integers(1, 5))):
            n = int(rng.integers(0, 70))
            words = rng.integers(1, kinds + 1, n).tolist()
            if n > 6 and rng.random() < 0.6:
                p, a = int(rng.integers(1, n // 2)), int(rng.integers(0, n // 3))
                for i in range(a, n):
                    words[i] = words[a + (i - a) % p]
            want += [(s + len(row), s + n + len(row), q) for s, n, q in plain_runs(words, 6, 3)]
            row += words + [0]
        assert sorted(zip(*(x.tolist() for x in periods.runs_of(np.array(row), 6, 3)))) == sorted(want)


def test_grammar_gives_how_far_places_agree():
    rng = np.random.default_rng(8)
    words = np.concatenate([np.tile(rng.integers(1, 4, 7), 40), rng.integers(1, 3, 500), np.ones(90, np.int64)])
    row = np.concatenate([[0], words, [0], words[:300], [0]])
    grammar = periods.Grammar(row)
    assert len(grammar.parent) > 8
    a = rng.integers(1, len(words) - 1, 2000)
    b = a + rng.integers(1, len(words) - a)
    for forward, sign in ((True, 1), (False, -1)):
        got = grammar.agreement(a, b, forward)
        for x, y, n in zip(a.tolist(), b.tolist(), got.tolist()):
            k = 0
            while row[x + sign * k] == row[y + sign * k]:
                k += 1
            assert n == k


def test_periods_of_the_small_tables(spark, small):
    got = {r["doc_id"]: tuple(r)[1:] for r in catalog.QUERIES["op13_periods"](spark, SMALL).collect()}
    for r in small:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else (None,) * 3
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert got[r["doc_id"]] == (
            len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
        )


@pytest.mark.parametrize("limit", [1, 1 << 21])
def test_periods_of_odd_rows(spark, odd, empty, limit):
    for least, times in ((24, 3), (2, 2)):
        for r in periods.periodic_runs(odd, ("doc_id", "text"), least=least, times=times, limit=limit).collect():
            words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
            runs = [(s, n, q) for s, n, q in plain_runs(words, least, times)] if len(words) < 200 else [(0, len(words), 1)]
            assert [tuple(x) for x in r["runs"]] == runs and r["n_words"] == len(words)
            assert r["collapsed"] == collapsed(words, runs)
    assert periods.periodic_runs(empty).count() == 0


def test_letters_only():
    texts = pa.array(["skipped", "Az-09 É_ß|x", "", None, "\x7f\x80A"]).slice(1)
    assert divergence.letters_only(texts.fill_null("")).to_pylist() == ["az    É ß x", "", "", " \x80a"]
