"""Variants on disk: whole or as deltas, read back through their manifest and judged there."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from rowassay import ROW_ID
from rowassay.operators.inject import Injection, injector, mixed, single
from rowassay.operators.rules import rule
from rowassay.catalog.views import frame
from rowassay.plans import run
from rowassay.plans.injection import injection_grid
from rowassay.plans.judge import Suite
from rowassay.plans.run import DELTA, WHOLE, _Stored, read_variants, score_manifest, write_injections
from rowassay.session import fresh_path
from rowassay.sources.scan import scan_manifest
from rowassay.sources.sinks import write_manifest

PARTS = [
    injector("missing_value", column="amount"), injector("type_or_format_error", column="code"), injector("duplicate_row"),
    injector("out_of_range", column="amount"), injector("referential_integrity", column="fk"),
]
SUITES = [
    Suite("a", "x", 0, (
        rule("expect_column_values_to_not_be_null", column="amount"), rule("expect_column_values_to_be_between", column="fk", min_value=0),
        rule("expect_column_values_to_be_unique", column="text"), rule("expect_column_max_to_be_between", column="amount", max_value=200),
    )),
    Suite("b", "x", 0, (
        rule("expect_column_values_to_be_between", column="fk", min_value=0), rule("expect_column_values_to_be_of_type", column="code", type_="int32"),
        rule("expect_column_mean_to_be_between", column="amount", max_value=60), rule("expect_column_values_to_not_be_null", column="gone"),
        rule("expect_compound_columns_to_be_unique", column_list=["start", "fk"], mostly=0.97),
    )),
    Suite("c", "y", 1, ()),
]


@pytest.fixture(scope="module")
def stored(spark, synthetic):
    """The same variants whole and as deltas, with their manifests read back."""
    base = synthetic.drop("a", "b", "total")
    variants = [single(p, r, s, 1000) for p in PARTS for r, s in ((0.01, 1), (0.05, 2))] + [single(PARTS[0], 0.0, 9, 1000)]
    variants.append(mixed([(p, 0.02) for p in PARTS], 3, 1000))
    injection = Injection(base, variants, "synth")
    out = {}
    for storage in (WHOLE, DELTA):
        root = fresh_path(spark, storage)
        write_manifest(write_injections({"synth": injection}, root, storage), f"{root}/manifest")
        out[storage] = root, scan_manifest(spark, f"{root}/manifest")
    return injection, out


def _classes(manifest):
    groups = {}
    for line in manifest.collect():
        groups.setdefault(line["schema"], []).append(line)
    return list(groups.values())


def _size(path: str, under: str = "") -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(os.path.join(path, under)) for f in names if f.endswith(".parquet"))


def test_deltas_read_back_as_whole_variants(spark, stored):
    injection, out = stored
    rows = []
    for storage, (_, manifest) in out.items():
        found = Counter()
        for lines in _classes(manifest):
            df = read_variants(spark, lines)
            found.update(tuple(map(str, r)) for r in df.select("_variant", "_label", ROW_ID, *sorted(c for c in df.columns if c not in ("_variant", "_label", ROW_ID))).collect())
        rows.append(found)
    assert rows[0] == rows[1] and sum(rows[0].values()) == 12 * 1000 + 10 + 50 + 20


def test_the_manifest_tells_what_is_stored(spark, stored):
    for storage, (_, manifest) in stored[1].items():
        for lines in _classes(manifest):
            counted = {r["_variant"]: r for r in read_variants(spark, lines).groupBy("_variant").agg(F.count("*").alias("n"), F.count("_label").alias("k")).collect()}
            for r in lines:
                name = f"{r['error_type']}|{'' if r['rate'] is None else r['rate']}|{r['seed']}"
                assert (counted[name]["n"], counted[name]["k"]) == (r["n_rows"], r["n_labels"])
                stored_rows = spark.read.parquet(r["data_path"]).count() if r["n_stored"] else 0
                assert stored_rows == r["n_stored"] == (r["n_rows"] if storage == WHOLE else r["n_labels"])


def test_what_deltas_take_grows_with_the_rows_they_change(stored):
    (whole, _), (delta, manifest) = stored[1][WHOLE], stored[1][DELTA]
    assert _size(delta, "data") + _size(delta, "clean") < _size(whole, "data") / 2
    sums = {r["rate"]: r["n_stored"] for r in manifest.filter("error_type = 'missing_value'").collect()}
    assert sums == {0.01: 10, 0.05: 50, 0.0: 0}


def test_scores_do_not_depend_on_storage(stored):
    facts = [sorted(map(str, score_manifest(manifest, {"synth": SUITES}).collect())) for _, manifest in stored[1].values()]
    assert facts[0] == facts[1] and len(facts[0]) > 100


def test_scores_equal_those_of_one_suite_and_one_variant_at_a_time(spark, stored):
    from rowassay.operators.bind import bind_rules
    from rowassay.operators.validate import flagged_rows, outcomes

    injection, out = stored
    facts = {
        (r["method"], r["error_type"], r["rate"], r["seed"], r["metric"]): r["value"] for r in score_manifest(out[DELTA][1], {"synth": SUITES}).collect()
    }
    for line in out[WHOLE][1].collect():
        if line["rate"] not in (0.05, None):
            continue
        df, labels = spark.read.parquet(line["data_path"]), spark.read.parquet(line["labels_path"])
        for suite in SUITES[:2]:
            bound = bind_rules(list(suite.rules), df)
            hit = {r[ROW_ID] for r in flagged_rows(df, bound).collect()}
            bad = {r[ROW_ID] for r in labels.collect()}
            key = suite.method, line["error_type"], line["rate"], line["seed"]
            assert facts[*key, "precision"] == (len(hit & bad) / len(hit) if hit else None)
            assert facts[*key, "recall"] == len(hit & bad) / len(bad)
            assert facts[*key, "dataset_detected"] == any(r["success"] is False for r in outcomes(df, bound).collect())


def test_suites_share_one_pass(spark, stored):
    lines = _classes(stored[1][WHOLE][1])[0]
    data = read_variants(spark, lines)

    def scans(suites):
        return _Stored(data, suites)._marked()._jdf.queryExecution().executedPlan().toString().count("Location: ")

    assert scans(SUITES) == scans([Suite(f"m{i}", "x", 0, SUITES[i % 2].rules) for i in range(6)])


def test_lines_without_a_schema_are_refused(spark, stored):
    bare = stored[1][WHOLE][1].withColumn("schema", F.lit(None).cast("string"))
    with pytest.raises(ValueError):
        score_manifest(bare, {"synth": SUITES}).count()


def test_whole_variants_are_written_one_by_one_and_judged_before_they_are_shuffled(spark, tmp_path, monkeypatch):
    """No task sorts all variants of its rows, and keys and labels join verdicts, not the columns of all variants."""
    base, frames, write = frame(spark, SMALL, "customer"), [], run.write_variants
    monkeypatch.setattr(run, "write_variants", lambda data, *rest: frames.extend(data) or write(data, *rest))
    plan = [injector("missing_value", column="c_name"), injector("duplicate_row")]
    manifest = run.write_injections({"c": injection_grid(base, plan, [0.05], [1], "c")}, str(tmp_path))
    assert len(frames) == 3 and all(f.select("variant_type").distinct().count() == 1 for f in frames)
    suites = [Suite("a", "x", 0, (rule("expect_column_values_to_not_be_null", column="c_name"), rule("expect_column_values_to_be_unique", column="c_custkey")))]
    lines = manifest.collect()
    rows, labels = run._stored(spark, lines)
    judged = _Stored(rows, suites, labels)
    assert not {*base.columns} & {*judged._marked().columns}
    assert judged.tallies() == _Stored(read_variants(spark, lines), suites).tallies()
