"""Pages, fingerprints, quality and language."""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
from conftest import SMALL

from rowassay.llm import catalog, fingerprints, language, pagetext, quality


def test_articles_of_the_pages():
    for page in pq.read_table(f"{SMALL}/pages.parquet").to_pylist():
        article = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert pagetext.main_text(page["html"]) == "\n".join(b for b in blocks if b)


def test_page_without_an_article_element():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
    <div class="page"><div id="text"><h2>Tom &amp; Ann</h2><p>The  first
    paragraph says a number of things in a row.</p><p>Short.</p><ul><li>one<li>two</ul>
    <div class="cookie-notice">We use cookies, and say so at length here.</div><div class="ad-box ad">Buy!</div>
    <script>var x = "</p>";</script><p>The last one <b>also</b> has <a href=y>a link</a> and enough words.</p></div>
    <div class="more"><ul><li><a>x</a><li><a>y</a></ul></div></div>
    <section id="comments"><p>A reader writes a rather long remark on all of this.</p></section>
    <form><p>Name <input></form><footer>Imprint</footer></body></html>"""
    assert pagetext.main_text(page).split("\n") == [
        "Tom & Ann", "The first paragraph says a number of things in a row.", "Short.", "one", "two",
        "The last one also has a link and enough words.",
    ]


def test_odd_pages(spark):
    pages = [None, "", "plain &lt;text", "<p>a<b>c</p><!-- no --><p hidden>z</p>q<", "<nav>only a menu</nav>", "<article><p>x</article><article><p>longer one here</article>", "<br>" * 2000 + "<div>" * 3000 + "deep"]
    frame = spark.createDataFrame([(i, "u", p, "t") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    found = [r["text"] for r in sorted(pagetext.extract(frame).collect())]
    assert found == ["", "", "plain <text", "ac\nq<", "", "longer one here", "deep"]
    assert pagetext.extract(frame.limit(0)).count() == 0


def _edited(texts, i):
    own, after = texts[i], texts[(i + 1) % len(texts)]
    return own[: len(own) - len(own) // 2] + after[: len(own) // 2]


def test_fingerprints(spark, small):
    rows = catalog.QUERIES["op4_fingerprints"](spark, SMALL).collect()
    texts = [r["text"] or "" for r in sorted(small, key=lambda r: r["doc_id"])]
    assert len(rows) == len(texts)
    for i, r in enumerate(sorted(rows)):
        edited = _edited(texts, i)
        own, changed, after = fingerprints.digests([texts[i].encode(), edited.encode(), texts[(i + 1) % len(texts)].encode()])
        assert r["n_chars"] == len(texts[i]) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert [r["fingerprint"], r["edited_fingerprint"]] == fingerprints.as_text(np.stack([own, changed]))
        assert r["near_edited"] == fingerprints.likeness(own[None], changed[None])[0]
        assert r["near_next"] == fingerprints.likeness(own[None], after[None])[0]
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.97


def test_digest_text_round_trip():
    rows = fingerprints.digests([b"", b"abc", b"some bytes of a text " * 40])
    assert (fingerprints.from_text(fingerprints.as_text(rows)) == rows).all()
    assert (fingerprints.likeness(rows, rows) == 1).all()
    assert 0 <= fingerprints.likeness(rows[:1], rows[2:])[0] < 1


def test_short_texts_have_digests_of_their_content():
    texts = [b"abc", b"abd", b"one word", b"two word", b"hello world", b"jello world"]
    rows = fingerprints.digests(texts)
    assert len({r.tobytes() for r in rows}) == len(texts)
    end = fingerprints.digests([b"some bytes of a text abcdefgh", b"some bytes of a text abcdefgx"])
    assert (end[0] != end[1]).any()


def test_odd_fingerprints(odd, empty):
    texts = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in odd.collect())
    rows = fingerprints.edit_likeness(odd).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows)
    only = [t for _, t in texts]
    assert got == sorted((d, len(t), hashlib.sha256(_edited(only, i).encode()).hexdigest()) for i, (d, t) in enumerate(texts))
    same = {}
    for r in fingerprints.fingerprint(odd).collect():
        same.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert same[7] == same[8] and same[0] == same[1] and all(len(x) == 1 for x in same.values())
    assert fingerprints.edit_likeness(empty).count() == 0 and fingerprints.fingerprint(empty).count() == 0


def test_quality_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    rows = catalog.QUERIES["op10_quality"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r["doc_id"] in labels and r["held_out"]]
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    good, bad = ([r["score"] for r in held if labels[r["doc_id"]] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([g >= 0.3 for g in good]) > 0.97


def test_dual_coordinate_descent_separates():
    rows = [np.array([1, 2]), np.array([1, 3]), np.array([5, 2]), np.array([5, 3])] * 5
    labels = np.array([1, 1, 0, 0] * 5)
    model = quality.fit(rows, labels)
    assert model.score(np.array([1, 3])) > 0.5 > model.score(np.array([5, 3]))
    one = quality.fit(rows, np.ones(20, int))
    assert one.score(rows[0]) > 0.99 and quality.fit([], np.zeros(0, int)).score(rows[0]) == 0.5


def test_indicators():
    assert len(quality.indicators(b"")) == 0
    assert set(quality.indicators(b"ab")) < set(quality.indicators(b"abc"))
    assert (quality.indicators(b"go go go") >= 1 << quality.BITS).sum() == 2


def test_odd_quality(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (5, 0), (8, 1), (9, None), (None, 1), (10, 0), (77, 1), (3, 7)], "doc_id long, quality int")
    model = quality.train(odd, labels, "quality")
    rows = quality.score(odd, model, keep=tuple(odd.columns), into="_s").collect()
    assert len(rows) == odd.count() and all(0 <= r["_s"] <= 1 for r in rows)
    assert quality.score(empty, quality.train(empty, labels, "quality")).count() == 0


def test_language_on_held_out_documents(spark, small):
    known = {r["doc_id"]: r["lang"] for r in small}
    rows = catalog.QUERIES["op8_language"](spark, SMALL).collect()
    assert len(rows) == len(small) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in rows if r["held_out"]]) > 0.97


def test_forward_pass_sums_all_segmentations():
    pieces = sorted(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba"])
    logs = np.log(np.random.default_rng(1).random((len(pieces) + 1, 2)))
    lattice, number = language.Lattice(pieces), {p: i for i, p in enumerate(pieces)}

    def total(text, column):
        if not text:
            return 1.0
        return sum(np.exp(logs[number.get(text[:n], len(pieces) if n == 1 else -1), column]) * total(text[n:], column) for n in range(1, len(text) + 1) if n == 1 or text[:n] in number)

    words = ["a", "abab", "baab", "axb", "ababababab", ""]
    found = language.log_likelihoods(words, lattice, logs)
    for word, row in zip(words, found):
        for column in (0, 1):
            assert np.isclose(row[column], np.log(total("▁" + word, column)))
    # expected counts: every character is in one piece of each segmentation
    counts = language._expected(words, np.ones(len(words)), lattice, logs[:, :1])
    sizes = np.array([len(p) for p in pieces] + [1])
    assert np.isclose((counts * sizes).sum(), sum(len(w) + 1 for w in words))


def test_odd_language(odd, empty):
    model = language.train(odd)
    rows = language.identify(odd, model, keep=tuple(odd.columns), into=("_l", "_p")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r["_l"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["_p"] <= 1
    unlearned = language.train(empty)
    assert {r["lang_pred"] for r in language.identify(odd.drop("score"), unlearned).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0
