from __future__ import annotations

import pytest
from conftest import SMALL

from pyspark.sql import functions as F

from rowassay.catalog.injections import RATES, SEEDS
from rowassay.catalog.views import frame
from rowassay.operators import report
from rowassay.operators.bind import bind_rules
from rowassay.operators.inject import injector
from rowassay.operators.metrics import detection_scores, recall_by_type
from rowassay.operators.profile import profile_rules
from rowassay.operators.rules import rule
from rowassay.operators.validate import flagged_rows, outcomes
from rowassay.plans.grid import CROSS_ROW, Grid, _Frame
from rowassay.plans.judge import Suite, facts_frame
from rowassay.plans.injection import injection_grid
from rowassay.plans.suites import hand_written
from rowassay.sources.sinks import manifest_of, write_manifest, write_variants
from rowassay.sources.scan import scan_manifest

# Targets chosen so that keys collide, types change, and ranges move.
PLAN = [
    injector("missing_value", column="c_name"), injector("out_of_range", column="c_acctbal"), injector("duplicate_row"),
    injector("referential_integrity", column="c_custkey"), injector("invalid_category", column="c_nationkey", invalid_value="ZZ"),
    injector("distribution_shift", column="c_acctbal"),
]
EXTRA = [
    rule("expect_column_min_to_be_between", column="c_acctbal", min_value=-5000, max_value=0),
    rule("expect_column_max_to_be_between", column="c_acctbal", max_value=9000),
    rule("expect_column_mean_to_be_between", column="c_acctbal", min_value=4000, max_value=5000),
    rule("expect_column_distinct_values_to_be_in_set", column="c_nationkey", value_set=list(range(25))),
    rule("expect_table_row_count_to_be_between", min_value=1, max_value=150),
    rule("expect_column_values_to_be_in_set", column="c_mktsegment", value_set=["BUILDING"], mostly=0.2),
    rule("expect_column_values_to_be_unique", column="c_nationkey", mostly=0.01),
    rule("expect_compound_columns_to_be_unique", column_list=["c_mktsegment", "c_nationkey"]),
    rule("expect_column_values_to_be_unique", column="c_acctbal"),
    rule("expect_column_values_to_be_of_type", column="c_nationkey", type_="int32"),
    rule("expect_column_values_to_be_between", column="zip", max_value=3),
]


@pytest.mark.parametrize("cap", [None, 60])
def test_grid_equals_brute_force(spark, cap):
    """Deltas over the clean table give what validating every full variant gives."""
    base = frame(spark, SMALL, "customer")
    injection = injection_grid(base, PLAN if cap is None else PLAN[1:4:2], [0.05], [1], "c")
    suites = [Suite("stats", "baseline", 0, tuple(profile_rules(base))), Suite("extra", "a", 0, tuple(EXTRA))]
    grid = Grid(injection, suites, "c", cap, 7)
    facts = grid.detection_facts()
    assert len(grid.clean_facts()) == 10
    for vi, variant in enumerate(injection.variants):
        rows, labels = injection.rows([vi]).select(*base.columns), injection.labels([vi])
        if cap is not None and variant.error_type not in CROSS_ROW:
            rows, labels = rows.filter(grid.within), labels.filter(grid.within)
        rows = rows.cache()
        for s, suite in enumerate(suites):
            bound = bind_rules(list(suite.rules), rows)
            flagged = flagged_rows(rows, bound)
            scores = detection_scores(flagged, labels).first()
            out = outcomes(rows, bound).collect()
            got = {f["metric"]: f["value"] for f in facts
                   if f["method"] == suite.method and f["error_type"] == variant.error_type and f["metric"] != "recall_by_type"
                   and (f["rate"], f["seed"]) == (variant.rate, variant.seed)}
            assert got == {
                "precision": scores["precision"], "recall": scores["recall"], "f1": scores["f1"],
                "dataset_detected": int(any(r["success"] is False for r in out)),
            }, (variant.error_type, suite.method)
            want = {r["error_type"]: r["recall"] for r in recall_by_type(flagged, labels).collect()}
            tally = grid.tallies[vi]
            assert {e: tally.found[e, s] / k for e, k in tally.labelled.items()} == want
            for r in out:
                number = grid.suite_rules[s][r["rule_index"]]
                assert grid.passed[vi][number] == r["success"], (variant.error_type, suite.rules[r["rule_index"]])
                if r["unexpected_count"] is not None:
                    assert tally.unexpected[number] == r["unexpected_count"]
        rows.unpersist()


def test_number_of_facts(spark):
    """5 facts per clean suite; 4 and one per error type for each variant."""
    base = frame(spark, SMALL, "orders")
    from rowassay.plans.injection import plan_for

    plan = plan_for("tpch_orders")
    suites = [Suite("human", "baseline", 0, tuple(hand_written("tpch_orders")))]
    grid = Grid(injection_grid(base, plan, RATES, SEEDS, "tpch_orders"), suites, "tpch_orders")
    assert len(grid.clean_facts()) == 5
    assert len(grid.detection_facts()) == len(plan) * 4 * 5 + 2 * (4 + len(plan))


def test_fact_arithmetic_of_the_default_run():
    single, mixed = 96 * 11 * 5, 2 * 11 * ((4 + 7) + (4 + 5) + (4 + 6) + (4 + 6))
    assert 4 * (2 * 5 + 9 * 14) + single + mixed == 6704


def test_reports_skip_undefined_values(spark):
    rows = [
        ("llm:x", "a", "executability", "overall", 0.5), ("llm:x", "b", "executability", "overall", None),
        ("llm:x", "a", "recall_by_type", "missing_value", 1.0), ("llm:x", "a", "recall_by_type", "missing_value", None),
        ("stats", "baseline", "precision", "missing_value", 0.5), ("stats", "baseline", "precision", "mixed", 0.0),
        ("stats", "baseline", "recall_by_type", "missing_value", 0.25), ("llm:y", "c", "executability", "overall", 0.9),
    ]
    facts = facts_frame(spark, [
        {"model": m, "method": m, "condition": c, "repetition": 0, "dataset": "d", "metric": k, "error_type": e, "value": v}
        for m, c, k, e, v in rows
    ])
    tables = report.report_tables(facts)
    assert [r["model"] for r in tables["models_by_executability"].collect()] == ["llm:y", "llm:x"]
    assert tables["executability_by_model"].columns == ["model", *report.MODEL_METRICS]
    recall = tables["recall_by_error_type"].first()
    assert (recall["llm:x"], recall["stats"]) == (1.0, 0.25)
    assert tables["detection_overall"].first()["precision"] == 0.5
    assert [(r[0], r[1], r[2]) for r in tables["condition_comparison"].collect()] == [("a", 0.5, 1.0), ("c", 0.9, None)]


def test_variants_and_manifest_round_trip(spark, tmp_path):
    from rowassay.catalog.injections import variant_columns

    base = frame(spark, SMALL, "customer")
    injection = injection_grid(base, PLAN[:3], [0.05], [1], "c")
    rows = injection.rows().select(*variant_columns(injection, "c"), *base.columns)
    labels = injection.labels().select(*variant_columns(injection, "c"), "_row_id", "column", "error_type", "rate", "seed", "original_value", "corrupted_value")
    root = str(tmp_path / "v")
    write_variants(rows, labels, root)
    # a second table under the same root, written twice, leaves the first one alone
    for _ in range(2):
        write_variants(*(f.withColumn("table_id", F.lit("d")) for f in (rows, labels)), root)
    lines = rows.selectExpr("table_id", "variant_type AS error_type", "variant_rate AS rate", "variant_seed AS seed").distinct()
    write_manifest(manifest_of(lines, root), str(tmp_path / "m"))
    entries = {r["error_type"]: r for r in scan_manifest(spark, str(tmp_path / "m")).collect()}
    assert set(entries) == {"missing_value", "out_of_range", "duplicate_row", "mixed"}
    mix = spark.read.parquet(entries["mixed"]["labels_path"])
    assert {r["label_type"] for r in mix.select("label_type").distinct().collect()} == {"missing_value", "out_of_range", "duplicate_row"}
    assert mix.filter("label_rate IS NULL OR label_seed IS NULL").count() == 0
    assert spark.read.parquet(f"{root}/data").groupBy("table_id").count().select("count").distinct().count() == 1
    n = base.count()
    assert spark.read.parquet(entries["duplicate_row"]["data_path"]).count() == n + round(n * 0.05)
    assert spark.read.parquet(entries["mixed"]["data_path"]).count() == n + round(n * 0.02)
    assert spark.read.parquet(entries["missing_value"]["labels_path"]).count() == round(n * 0.05)


def test_suites_without_row_rules(spark):
    base = frame(spark, SMALL, "customer")
    injection = injection_grid(base, [injector("out_of_range", column="c_acctbal")], [0.05], [1], "c")
    top = rule("expect_column_max_to_be_between", column="c_acctbal", max_value=10000)
    grid = Grid(injection, [Suite("top", "a", 0, (top,)), Suite("none", "a", 0, ())], "c")
    values = {(f["method"], f["error_type"], f["metric"]): f["value"] for f in grid.detection_facts()}
    assert values["top", "out_of_range", "dataset_detected"] == 1 and values["none", "out_of_range", "dataset_detected"] == 0
    assert values["top", "out_of_range", "recall"] == 0 and values["top", "out_of_range", "precision"] is None


def test_grid_is_evaluated_in_methods_that_are_compiled(spark, monkeypatch):
    """Spark's default lets methods grow that the JVM only interprets; the session's own setting is back afterwards."""
    limit, seen = "spark.sql.codegen.hugeMethodLimit", []
    before, clean = spark.conf.get(limit), _Frame.clean
    monkeypatch.setattr(_Frame, "clean", lambda self: seen.append(int(spark.conf.get(limit))) or clean(self))
    base = frame(spark, SMALL, "customer")
    Grid(injection_grid(base, PLAN[:1], [0.05], [1], "c"), [Suite("extra", "a", 0, tuple(EXTRA[:5]))], "c")
    assert seen and max(seen) <= 8000 and spark.conf.get(limit) == before


def test_only_keys_and_verdicts_of_the_clean_table_are_shuffled(spark, monkeypatch):
    """However wide the table, its other columns stay out of the joins with repeated keys."""
    base, seen, mark = frame(spark, SMALL, "customer"), [], _Frame._mark
    monkeypatch.setattr(_Frame, "_mark", lambda self, df, *a: seen.append(set(df.columns)) or mark(self, df, *a))
    rules = [rule("expect_column_values_to_be_unique", column="c_nationkey"), rule("expect_column_values_to_not_be_null", column="c_name")]
    Grid(injection_grid(base, PLAN[2:3], [0.05], [1], "c"), [Suite("two", "a", 0, tuple(rules))], "c")
    assert seen and not any(columns & {*base.columns, "_old"} for columns in seen)
