"""Joins, repeats, passages, neighbours and the pipeline beside brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from rowassay.llm import catalog, jaccard, neighbours, passages, substrings
from rowassay.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def shingles(text, width):
    words = words_of(text)
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute_components(rows, width, percent):
    sets = {doc: shingles(text, width) for doc, text in rows}
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {doc: (len(sets[doc]), find(doc)) for doc in ids}


def test_components_of_links(spark, small):
    rows = catalog.QUERIES["op6_jaccard"](spark, SMALL).collect()
    expected = brute_components([(r["doc_id"], r["text"]) for r in small], 3, 90)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == expected and len(rows) == len(small)


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_links_at_the_threshold(spark, width, percent):
    """Families with more and more edits, around the threshold and across bands of sizes, with many copies."""
    pick, rows = random.Random(width), []
    for family in range(12):
        base = [f"w{pick.randint(0, 400)}" for _ in range(pick.choice([4, 9, 10, 19, 20, 29, 30, 60, 150]))]
        for _ in range(pick.choice([2, 5, 30])):
            text = list(base)
            for _ in range(pick.randint(0, max(1, len(text) // 12))):
                at = pick.randrange(len(text))
                text[at : at + pick.randint(0, 1)] = [f"e{pick.randint(0, 99)}"] * pick.randint(0, 1)
            rows.append((len(rows), " ".join(text)))
    pick.shuffle(rows)
    found = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows, width, percent)


def test_blocks_of_a_family(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    pick = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(w if pick.random() > 0.012 else f"e{i}" for w in base)) for i in range(25)]
    found = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows, 3, 90)


def test_odd_links(odd, empty):
    rows = jaccard.similar_components(odd).collect()
    assert len(rows) == odd.count()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert found[0] == (0, 0) and found[2] == (0, 2) and found[5] == (1, 4) and found[8] == (1, 7) and found[19] == (1, 18)
    assert found[None] == (1, None)
    assert jaccard.similar_components(empty).count() == 0


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7), (300, 300)] + [(500, 501 + i) for i in range(200)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and found[150] == found[200] == 100 and found[300] == 300
    assert all(found[501 + i] == 500 for i in range(200))


def brute_cut(rows, length):
    first, out = {}, {}
    raw = sorted(((d, (t or "").encode()) for d, t in rows), key=lambda r: r[0])
    for doc, data in raw:
        for i in range(len(data) - length + 1):
            first.setdefault(data[i : i + length], doc)
    for doc, data in raw:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < doc:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_substrings(spark, small):
    rows = catalog.QUERIES["op1_substrings"](spark, SMALL).collect()
    expected = brute_cut([(r["doc_id"], r["text"]) for r in small], 50)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == expected
    assert len(rows) == len(small) and any(r["n_removed"] for r in rows)


@pytest.mark.parametrize("letters, length", [("ab", 20), ("abcdefgh ", 25), ("aé\x00", 50)])
def test_substrings_of_few_letters(spark, letters, length):
    pick = random.Random(length)
    pool = ["".join(pick.choice(letters) for _ in range(pick.randint(1, 90))) for _ in range(8)]
    rows = [(i, "".join(pick.choice(pool)[pick.randint(0, 9) :] for _ in range(pick.randint(0, 6)))) for i in range(60)]
    rows += [(100, letters[0] * 700), (101, letters[0] * 300), (102, ""), (103, None)]
    found = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length=length).collect()
    got = {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in found}
    assert got == brute_cut(rows, length)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.text("ab", max_size=30), min_size=1, max_size=6), st.integers(2, 5))
def test_maximal_repeats(strings, length):
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    begins = ends - [len(s) for s in strings]
    found = {(size, tuple(sorted(starts.tolist()))) for starts, size in substrings.maximal_repeats(data, ends, length)}
    places: dict[str, list] = {}
    for k, s in enumerate(strings):
        for i in range(len(s)):
            for j in range(i + length, len(s) + 1):
                places.setdefault(s[i:j], []).append((k, i))
    expected = set()
    for repeat, at in places.items():
        before = {strings[k][i - 1] if i else (k,) for k, i in at}
        after = {strings[k][i + len(repeat)] if i + len(repeat) < len(strings[k]) else (k,) for k, i in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            expected.add((len(repeat), tuple(sorted(int(begins[k]) + i for k, i in at))))
    # an end of a string also ends a repeat, so a string that holds another one's end may be listed at both sizes
    assert expected <= found
    assert all(len({"".join(strings)[a : a + size] for a in at}) == 1 for size, at in found)


def test_odd_substrings(odd, empty):
    rows = substrings.without_repeats(odd).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd.collect()}
    assert all(r["n_bytes"] == len(texts[r["doc_id"]]) for r in rows)
    assert substrings.without_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        substrings.without_repeats(odd, length=10)


def test_settling_does_not_depend_on_batches():
    import pyarrow as pa

    pick = np.random.default_rng(2)
    rows = sorted({(int(a), int(w) + 10 * int(a), int(d), int(p)) for a, w, d, p in pick.integers(0, [6, 4, 5, 6], (300, 4))})

    def settle(size):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + size]], pa.int64()) for k in range(4)], names=list("awdp")) for i in range(0, len(rows), size)]
        return {tuple(r.values()) for b in substrings._settle(batches) for r in b.to_pylist()}

    whole = settle(len(rows))
    assert {(d, p) for s, _, d, p in whole if s} == {(d, p) for a, w, d, p in rows if d > min(x[2] for x in rows if x[:2] == (a, w))}
    for size in (1, 2, 7, 50):
        part = settle(size)
        assert {x for x in part if x[0]} == {x for x in whole if x[0]} and {x for x in part if not x[0]} == {x for x in whole if not x[0]}


def planted(seed=9):
    """Documents of random words; passages of 60 words that others repeat exactly, with edits, or many times."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefghijklmnop") for _ in range(5))
    docs = [[word() for _ in range(pick.randint(80, 200))] for _ in range(40)]
    passage = [word() for _ in range(60)]
    exact, edited = [5, 9, 11, 30, 31, 32], [20, 21]
    for d in exact:
        docs[d][30:30] = passage
    for d in edited:
        own = list(passage)
        for at in (12, 25, 41):
            own[at] = word()
        docs[d][10:10] = own
    return [(i, " ".join(d)) for i, d in enumerate(docs)], exact, edited


def test_planted_passages(spark):
    rows, exact, edited = planted()
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    by = {r["doc_id"]: r for r in found}
    assert sorted(by) == sorted(exact[1:] + edited) and len(found) == len(by)
    for d in exact[1:]:
        assert (by[d]["source_id"], by[d]["start_word"], by[d]["end_word"], by[d]["source_start"], by[d]["similarity"]) == (5, 30, 90, 30, 1.0)
    for d in edited:
        assert by[d]["source_id"] == 5 and 58 <= by[d]["n_words"] <= 60 and 0.9 < by[d]["similarity"] < 1


def test_exact_runs_are_covered(spark, small):
    """Every word of a 40-word run that an earlier document has is in a passage, but for a few at edges."""
    rows = sorted((r["doc_id"], words_of(r["text"])) for r in small)
    first, expected = {}, {}
    for doc, words in rows:
        for i in range(len(words) - 39):
            if first.setdefault(tuple(words[i : i + 40]), doc) < doc:
                expected.setdefault(doc, set()).update(range(i, i + 40))
    got: dict = {}
    for r in catalog.QUERIES["op3_passages"](spark, SMALL).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        assert r["source_id"] < r["doc_id"] and r["similarity"] >= 0.8 and r["n_words"] >= 40
    assert set(expected) <= set(got)
    assert sum(len(expected[d] - got[d]) for d in expected) <= 0.02 * sum(map(len, expected.values()))


def test_chains_bridge_gaps_and_split():
    place = np.array([0, 6, 12, 30, 36, 120, 126])
    found = passages.chains(place, place + 3)
    assert sorted(x.tolist() for x in found) == [[0, 1, 2, 3, 4], [5, 6]]
    crossing = passages.chains(np.array([0, 5, 10, 15]), np.array([10, 15, 0, 5]))
    assert sorted(x.tolist() for x in crossing) == [[0, 1], [2, 3]]


def test_passages_between_unlike_words(spark):
    """Exact passages that only a line of unlike words parts: the whole stretch is under the similarity, each is not."""
    pick = random.Random(6)
    word = lambda: "".join(pick.choice("abcdefghijklmnop") for _ in range(6))
    shared = [[word() for _ in range(42)] for _ in range(10)]
    rows = [(i, " ".join(w for part in shared for w in part + [word() for _ in range(16)])) for i in range(4)]
    got: dict = {}
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["source_id"] < r["doc_id"] and r["similarity"] >= 0.8 and r["n_words"] >= 40
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    expected = {58 * k + i for k in range(10) for i in range(42)}
    assert all(expected <= got[d] for d in (1, 2, 3))


def test_parts_of_an_alignment():
    half = [(0, 0, 40), (52, 52, 40)]
    assert passages.parts(np.array(half), 40, 0.8) == [(0, 40, 0, 40, 1.0), (52, 92, 52, 92, 1.0)]
    unlike = np.array([(0, 0, 40), (60, 60, 40), (103, 105, 30), (160, 160, 30)])
    assert passages.parts(unlike, 40, 0.8) == [(0, 40, 0, 40, 1.0), (60, 133, 60, 135, 70 / 75)]
    assert passages.parts(np.array([(0, 0, 30), (50, 50, 30)]), 40, 0.8) == []


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("n, changed", [(40, 8), (40, 6), (50, 10)])
def test_changed_passages_at_the_similarity(spark, n, changed):
    """Random words changed, down to the similarity itself: at every one brute force finds a common passage."""
    pick = random.Random(n + changed)
    word = lambda: "".join(pick.choice("abcdefghijklmnop") for _ in range(6))
    rows, cases = [], 60
    for case in range(cases):
        passage = [word() for _ in range(n)]
        own = list(passage)
        for at in pick.sample(range(n), changed):
            own[at] = word()
        assert longest_common(passage, own) >= 0.8 * n
        rows += [(i, " ".join([word() for _ in range(70)] + p + [word() for _ in range(70)])) for i, p in ((case, passage), (1000 + case, own))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_words"] >= 40 and r["similarity"] >= 0.8 and r["doc_id"] == 1000 + r["source_id"] for r in found)
    assert {r["source_id"] for r in found} == set(range(cases))
    texts = {d: t.split() for d, t in rows}
    for r in found:
        a, b = texts[r["doc_id"]][r["start_word"] : r["end_word"]], texts[r["source_id"]][r["source_start"] : r["source_end"]]
        assert longest_common(a, b) >= 0.8 * max(len(a), len(b)) - 1e-9


@pytest.mark.parametrize("pieces", [[(0, 20), (20, 40), (40, 60)], [(0, 30), (24, 54), (46, 60)]])
def test_passages_whose_lines_are_frequent(spark, pieces):
    """Every line of the passage is in an earlier document by itself, in the second case with the words around its ends."""
    pick = random.Random(len(pieces[0]) + pieces[1][0])
    word = lambda: "".join(pick.choice("abcdefghijklmnop") for _ in range(6))
    rows, cases = [], 20
    for case in range(cases):
        passage = [word() for _ in range(60)]
        parts = [passage[a:b] for a, b in pieces] + [passage, passage]
        rows += [(10 * case + i, " ".join([word() for _ in range(50)] + p + [word() for _ in range(50)])) for i, p in enumerate(parts)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["source_id"]): (r["start_word"], r["end_word"], r["similarity"]) for r in found}
    assert got == {(10 * case + 4, 10 * case + 3): (50, 110, 1.0) for case in range(cases)}


def test_passages_never_shuffle_their_matches_twice_in_one_job(spark, monkeypatch):
    own, written = passages.materialize, {}

    def recorded(df, name):
        written[name] = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning(doc")
        return own(df, name)

    monkeypatch.setattr(passages, "materialize", recorded)
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} {shared} c{i}") for i in range(4)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_id"]) for r in found if r["source_id"] == 0} == {(1, 0), (2, 0), (3, 0)}
    assert max(written.values()) == 1


def test_cutting_words(spark, odd, empty):
    assert passages.cut_words(" a b\nc  d ", [(1, 3)]) == " a d "
    assert passages.cut_words("a b", [(0, 9)]) == "" and passages.cut_words("a b c d", [(0, 2), (1, 3)]) == "d"
    found = passages.repeated_passages(odd)
    assert found.count() == 0
    assert passages.without_passages(odd, found).count() == odd.count()
    assert passages.repeated_passages(empty).count() == 0


def test_neighbours(spark):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SMALL}/embeddings.parquet")
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(float)
    rows = catalog.QUERIES["op5_neighbours"](spark, SMALL).collect()
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        near = x @ x[i]
        near[i] = -np.inf
        true = ids[np.lexsort((ids, -near))[:20]]
        own = sorted((r for r in rows if r["query_id"] == ids[i]), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and ids[i] not in {r["vec_id"] for r in own}
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        assert all(np.isclose(r["score"], x[i] @ x[np.flatnonzero(ids == r["vec_id"])[0]], atol=1e-12) for r in own)
        hit, total = hit + len(set(true.tolist()) & {r["vec_id"] for r in own}), total + 20
    assert hit >= 0.9 * total


def test_isolated_vectors_get_all_neighbours(spark):
    """Few probes suffice in dense clusters; vectors far from them still get k rows, few rows give all there are."""
    from pyspark.sql import functions as F

    pick = np.random.default_rng(3)
    centres = pick.normal(size=(8, 32))
    dense = np.repeat(centres, 100, axis=0) + 0.01 * pick.normal(size=(800, 32))
    x = np.concatenate([dense, pick.normal(size=(12, 32))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = lambda c: (c % 10 == 0) | (c >= 800)
    found = neighbours.search(frame, asked(F.col("vec_id")), k=20).toPandas()
    ids = [i for i in range(len(x)) if i % 10 == 0 or i >= 800]
    assert found.groupby("query_id").size().to_dict() == dict.fromkeys(ids, 20)
    assert not found.duplicated(["query_id", "vec_id"]).any() and (found["query_id"] != found["vec_id"]).all()
    few = neighbours.search(frame.filter("vec_id >= 800"), F.col("vec_id") >= 800, k=20).toPandas()
    assert few.groupby("query_id").size().to_dict() == dict.fromkeys(range(800, 812), 11)


def test_odd_vectors(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 0.0]), (4, [nan, 1.0, 0.0]), (5, [inf, 1.0, 0.0]), (6, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(20, [3.0, 0.0, 0.0])] + [(21 + i, [2.0, 0.0, 0.0]) for i in range(40)] + [(70, [0.0, 1.0, 0.0]), (80, [-1.0, 0.0, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(frame, F.col("vec_id") % 20 == 0, k=5).collect()
    of = lambda q: [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert of(0) == [(20, 3.0), (21, 2.0), (22, 2.0), (23, 2.0), (24, 2.0)]
    assert of(20)[0] == (21, 6.0) and of(40) == [(20, 6.0), (21, 4.0), (22, 4.0), (23, 4.0), (24, 4.0)]
    assert {r["query_id"] for r in found} == {0, 20, 40, 60, 80}
    assert neighbours.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.search(frame.filter("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_stages(spark, documents, small):
    docs, ids = documents, {r["doc_id"] for r in small}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), documents.schema)
        rows = docs.collect()
        assert docs.columns == documents.columns and {r["doc_id"] for r in rows} <= ids, name
        ids = {r["doc_id"] for r in rows}
        kept.append(len(rows))
        if name == "near_duplicates":
            groups = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert ids == {doc for doc, (_, least) in groups.items() if doc == least}
        if name == "passages":
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
            assert passages.repeated_passages(docs).count() <= 1
    assert kept == sorted(kept, reverse=True) and kept[0] > 150
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r["doc_id"] for r in packed} == ids


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty):
    for frame in (odd, empty):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            if name != "packing":
                assert out.columns == docs.columns, name
                docs = spark.createDataFrame(out.collect(), frame.schema)
            else:
                out.count()


def test_edited_copies_whose_seeds_all_have_earlier_owners(spark):
    """Every four words of a passage stand in earlier documents, apart from each other; a later copy with changed words is
    still tied to the document that has the passage."""
    rng = np.random.default_rng(11)
    fresh = iter(range(10**6))

    def words(n):
        return [f"w{next(fresh)}" for _ in range(n)]

    docs, pairs = [], []
    for _ in range(60):
        passage = words(50)
        copy = list(passage)
        for i in rng.choice(50, 6, replace=False):
            copy[i] = words(1)[0]
        for text in (passage, copy):  # each run of four words, its own document's, with other words between
            docs += [" ".join(sum((text[i : i + 4] + words(6) for i in range(start, 47, 5)), [])) for start in range(5)]
        pairs.append((passage, copy))
    owners = len(docs)
    docs += [" ".join(words(30) + p + words(30)) for p, _ in pairs] + [" ".join(words(30) + c + words(30)) for _, c in pairs]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {(r["doc_id"], r["source_id"]) for r in passages.repeated_passages(frame).collect()}
    assert sum((owners + 60 + i, owners + i) in found for i in range(60)) >= 54
    assert all(s >= owners for _, s in found)


def test_least_seeds():
    assert [passages.least_seeds(40, s) for s in (0.8, 0.9, 1.0)] == [5, 21, 37] and passages.least_seeds(10, 0.5) == 1


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_key(percent):
    """The pigeonhole bound, with no keys for the empty pieces of most sets."""
    rng = np.random.default_rng(percent)
    without = 0
    for _ in range(1500):
        union = int(rng.integers(1, 260))
        common = -(-percent * union // 100)
        extra = rng.integers(0, 2**63, union, dtype=np.uint64)
        mine = rng.random(union - common) < rng.choice([0, 0.5, 1])
        a, b = (np.unique(np.concatenate([extra[:common], extra[common:][side]])) for side in (mine, ~mine))
        keys = [jaccard.piece_keys(x, percent) for x in (a, b)]
        assert len(np.intersect1d(*keys))
        without += len(keys[0]) < sum(jaccard._pieces(band, percent)[0] for band in (jaccard._band(len(a)), jaccard._band(len(a)) + 1))
    assert without > 750


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 60), st.integers(0, 3), st.integers(1, 25)), max_size=40))
def test_needed_matches_cover_the_same_words(found):
    """What goes is tied to the same place of the source by what stays; short matches all stay."""
    pair, place, other, size = (np.array([f[k] for f in found], np.int32) for k in range(4))
    keep = passages._needed(pair, place, other, size, 10)
    assert keep[size < 10].all()

    def covered(on):
        return {(p, o, x) for p, s, o, n in zip(pair[on].tolist(), place[on].tolist(), other[on].tolist(), size[on].tolist()) if n >= 10 for x in range(s, s + n)}

    assert covered(keep) == covered(np.ones(len(keep), bool))


def test_a_repeating_text_needs_few_matches(spark):
    """Texts that say one word on and on, tied from the third on: rows grow with the words over the least, not with the words."""
    own = [" ".join([f"{c}{i}" for i in range(30)] + ["spam"] * n) for c, n in (("a", 900), ("b", 700), ("c", 600))]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    rows = [r for r in passages.repeated_passages(docs).collect() if r["doc_id"] == 2]
    assert set().union(*(range(r["start_word"], r["end_word"]) for r in rows)) >= set(range(30, 630))
    assert len(rows) <= 2 * 600 / 40 + 2


def test_language_stage_decides_by_its_score(spark, documents):
    """Letter junk and scripts that were not learned go; texts of every learned language stay, and columns may have any name."""
    rng = random.Random(5)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)) for _ in range(5)]
    junk += ["Москва столица России большой город", "中文字符很多", "123 456", None]
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(junk)], "doc_id long, text string")
    docs = documents.unionByName(odd, allowMissingColumns=True).withColumn("Gain", documents["lang"])
    kept = corpus_pipeline.language_stage(spark, docs, SMALL)
    assert kept.columns == docs.columns
    kept = {r["doc_id"] for r in kept.collect()}
    assert not any(i < 0 for i in kept)
    assert kept >= {r["doc_id"] for r in documents.filter("text rlike '[A-Za-z]{3}'").collect()}


def test_matches_of_copies_move_a_row_a_bucket(spark, monkeypatch):
    """Seeds and ties travel as a row a bucket: how many there are does not follow the words or the size of a group of copies."""
    own, rows = passages.materialize, {}

    def recorded(df, name):
        table = own(df, name)
        rows[name] = rows.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(passages, "materialize", recorded)
    rng = np.random.default_rng(5)
    shared = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(200):  # near copies: each changes three words
        text = list(shared)
        for k in rng.choice(200, 3, replace=False):
            text[k] = f"x{i}_{k}"
        docs.append((i, " ".join(text)))
    found = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    assert {r["doc_id"] for r in found} == set(range(1, 200))
    assert rows["matches"] <= passages.ROUNDS * passages.BUCKETS[0] * spark.sparkContext.defaultParallelism
    assert rows["whole"] <= passages.BUCKETS[0] * spark.sparkContext.defaultParallelism


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text("aAbB \t\n\x0b\x0c\r\x1f\u00a0\u00e9\u00c9", max_size=12), max_size=6), st.integers(1, 9))
def test_word_codes_tell_words_apart(texts, block):
    every = ["x", *texts]
    before, passages._BLOCK = passages._BLOCK, block
    try:
        codes, counts = passages.word_codes(pa.array(every, pa.string()).slice(1))
        seen = [passages.word_codes(pa.array([w], pa.string()))[0].tolist() for t in texts for w in words_of(t)]
    finally:
        passages._BLOCK = before
    words = [w for t in texts for w in words_of(t)]
    assert counts.tolist() == [len(words_of(t)) for t in texts] and [[c] for c in codes.tolist()] == seen
    assert len(set(codes.tolist())) == len(set(words))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-2, 4), st.integers(0, 5)), max_size=30))
def test_ties_are_the_first_document_and_the_one_before(rows):
    seed, doc, place = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.uint64, np.int64, np.int32)))
    made = passages._ties(seed, doc, place)
    wanted = []
    for s, d, p in rows:
        earlier = sorted((e, q) for t, e, q in rows if t == s and e < d)
        if earlier:
            last = min(q for e, q in earlier if e == earlier[-1][0])
            wanted.append((d, p, s, *earlier[0], earlier[-1][0], last))
    assert sorted(zip(*(v.tolist() for v in made.values()))) == sorted(wanted)


@pytest.mark.parametrize("seed", [7, 8])
def test_changed_passages_whose_lines_have_other_owners(spark, seed):
    """Each line of the later copy is in a document before the source and in one after it, so no seed is tied to the source."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefghijklmnop") for _ in range(6))
    texts, wanted = [], set()
    for _ in range(10):
        passage = [word() for _ in range(50)]
        changed = list(passage)
        for k in pick.sample(range(50), 6):
            changed[k] = word()
        pieces = [[word() for _ in range(30)] + changed[i : i + 10] + [word() for _ in range(30)] for i in range(0, 50, 7)]
        wanted.add((len(texts) + 2 * len(pieces) + 1, len(texts) + len(pieces)))
        texts += [*pieces, [word() for _ in range(40)] + passage + [word() for _ in range(40)]]
        texts += [*pieces, [word() for _ in range(40)] + changed + [word() for _ in range(40)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = passages.repeated_passages(docs, every_source=True).collect()
    assert {(r["doc_id"], r["source_id"]) for r in found} >= wanted


@pytest.mark.parametrize("piece", [4, 7, 1 << 13])
def test_a_frequent_line_is_compared_by_pieces(monkeypatch, piece):
    """A line in all texts: the words around it tell the one pair with a passage, however many occurrences are held at once."""
    pick = random.Random(3)
    word = lambda: "".join(pick.choice("abcdefghijklmnop") for _ in range(6))
    line, passage = [word() for _ in range(12)], [word() for _ in range(40)]
    texts = [[word() for _ in range(100)] + line + [word() for _ in range(100)] for _ in range(20)]
    for i, changed in ((5, ()), (17, (3, 9, 21, 33))):
        texts[i][112:152] = [word() if k in changed else w for k, w in enumerate(passage)]
    seed = passages.word_seeds(passages.word_codes(pa.array([" ".join(line)]))[0])[:1]
    one = [np.array([100], np.int32).tobytes(), seed.tobytes(), b"\1", b"", b""]
    rows = [[i, *one, " ".join(t)] for i, t in enumerate(texts)]
    kinds = [pa.int64(), *[pa.binary()] * 5, pa.string()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["who", "places", "seeds", "frees", "begins", "ends", "text"])
    monkeypatch.setattr(passages, "PIECE", piece)
    turns = [list(passages._around(40, 0.8, turn, 256)([batch])) for turn in range(passages.AROUND)]
    ties = pa.Table.from_batches([b for t in turns if t for b in passages._compared(5, 40, 0.8, 256)(t)])
    assert set(passages._values(ties, "doc", np.int64).tolist()) == {17} and set(passages._values(ties, "source", np.int64).tolist()) == {5}
    assert set(passages._values(ties, "place", np.int32).tolist()) >= set(range(100, 112))
