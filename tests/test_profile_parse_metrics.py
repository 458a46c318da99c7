from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rowassay.operators import metrics
from rowassay.operators.bind import bind_rules
from rowassay.operators.inject import inject, injector
from rowassay.operators.parse import (
    answered_requests, open_requests, parse_rules, request_key, status_counts, suite_summary, valid_rules,
)
from rowassay.operators.profile import profile_rules
from rowassay.operators.validate import flagged_rows, outcomes, suite_outcomes
from rowassay.plans.suites import hand_written, has_suite


@pytest.fixture(scope="module")
def clean(spark):
    return spark.range(200).selectExpr(
        "id AS _row_id", "1 + (id * 7919 % 9900) / 100D AS amount", "CAST(id % 3 + 1 AS INT) AS code",
        "if(id % 2 = 0, 'Y', 'N') AS flag", "if(id = 5, NULL, id) AS once_missing", "if(id < 2, NULL, id) AS twice_missing",
        "id % 2 = 0 AS truth", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(CAST(id % 2 AS INT)) AS day",
    )


def test_profile_kinds(clean):
    rules = [(r.expectation_type.removeprefix("expect_column_"), r.kwargs) for r in profile_rules(clean)]
    by = lambda c: [k for k, kw in rules if kw.get("column") == c]
    assert by("_row_id") == []
    assert by("amount") == ["values_to_not_be_null", "values_to_be_between", "values_to_be_unique"]
    assert by("code") == ["values_to_not_be_null", "values_to_be_between", "values_to_be_in_set"]
    assert by("flag") == ["values_to_not_be_null", "values_to_be_in_set", "value_lengths_to_be_between"]
    assert by("once_missing") == ["values_to_be_between", "values_to_be_unique"]
    assert by("twice_missing") == ["values_to_be_between"]
    assert by("truth") == ["values_to_not_be_null", "values_to_be_in_set"]
    assert dict((k, kw) for k, kw in rules if kw.get("column") == "day")["values_to_be_in_set"]["value_set"] == [
        "2024-01-01 00:00:00", "2024-01-02 00:00:00",
    ]


def test_profile_never_fires_on_its_own_table_and_finds_what_leaves_it(clean):
    suite = profile_rules(clean)
    report = suite_outcomes(outcomes(clean, bind_rules(suite, clean))).first()
    assert (report["n_failed"], report["n_runtime_errors"]) == (0, 0)
    corrupted, labels = inject(clean, injector("out_of_range", column="amount"), 0.05, 1)
    flagged = flagged_rows(corrupted, bind_rules(suite, corrupted))
    assert labels.join(flagged, "_row_id", "left_anti").count() == 0


def test_hand_written_suites():
    sizes = {t: len(hand_written(t)) for t in ("nyc_taxi", "tpch_customer", "tpch_orders", "tpch_lineitem")}
    assert list(sizes.values()) == [12, 5, 6, 9] and not has_suite("nope")
    with pytest.raises(FileNotFoundError):
        hand_written("nope")


GOOD = {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "amount"}, "rationale": "required"}
BAD = {"expectation_type": GOOD["expectation_type"], "kwargs": {"bad": 1}}
TEXTS = {
    "plain": (json.dumps([GOOD, GOOD]), ["valid", "valid"]),
    "fenced": ("The suite for this table follows.\n```json\n" + json.dumps([GOOD]) + "\n```\nIt has one rule.", ["valid"]),
    "prose": ("Rules: " + json.dumps([GOOD]) + " (end of rules)", ["valid"]),
    "unknown": (json.dumps([{"expectation_type": "expect_rain_on_sunday", "kwargs": {}}]), ["unknown_expectation"]),
    "kwargs": (json.dumps([BAD]), ["invalid_kwargs"]),
    "not_object": (json.dumps([{**GOOD, "kwargs": "column=amount"}]), ["invalid_kwargs"]),
    "null_kwargs": (json.dumps([{**GOOD, "kwargs": None}]), ["invalid_kwargs"]),
    "unknown_and_not_object": (json.dumps([{"expectation_type": "expect_rain_on_sunday", "kwargs": "column=amount"}]), ["invalid_kwargs"]),
    "element": (json.dumps(["amount is positive", GOOD, None, [GOOD]]), ["json_error", "valid", "json_error", "json_error"]),
    "no_type": (json.dumps([{"kwargs": {"column": "x"}}, {"expectation_type": 7}, {"expectation_type": ""}]), ["json_error"] * 3),
    "refusal": ("The table has no column to check.", ["json_error"]),
    "broken": ("[{]", ["json_error"]),
    "backwards": ("] nothing [", ["json_error"]),
    "empty": ("[]", []),
    "all": (json.dumps([GOOD, {"expectation_type": "expect_rain_on_sunday", "kwargs": {}}, BAD]), ["valid", "unknown_expectation", "invalid_kwargs"]),
}


@pytest.fixture(scope="module")
def parsed(spark):
    answers = spark.createDataFrame([(n, t, 3) for n, (t, _) in TEXTS.items()], "name string, text string, tokens int")
    return answers, parse_rules(answers).cache()


def test_every_rule_gets_its_status(parsed):
    rows = parsed[1].orderBy("name", "rule_index").collect()
    got = {n: [r["status"] for r in rows if r["name"] == n] for n in TEXTS}
    assert got == {n: s for n, (_, s) in TEXTS.items()}
    ok = {r["name"]: r["json_ok"] for r in rows}
    assert [n for n, v in ok.items() if not v] == ["backwards", "broken", "refusal"]
    assert all((r["error"] is None) == (r["status"] == "valid") for r in rows)


def test_counts_and_summary(parsed):
    answers, rules = parsed
    counts = {r["name"]: r.asDict() for r in status_counts(rules, ["name"]).collect()}
    assert counts["all"] == {"name": "all", "valid": 1, "json_error": 0, "unknown_expectation": 1, "invalid_kwargs": 1, "runtime_error": 0}
    summary = {r["name"]: r for r in suite_summary(answers, rules, ["name"], ["tokens"]).collect()}
    assert summary["empty"]["n_rules_total"] == 0 and summary["all"]["n_rules_total"] == 3 and summary["all"]["tokens"] == 3
    assert valid_rules(rules).filter("name = 'all'").count() == 1


def test_requests_are_keyed_by_content(spark):
    df = spark.createDataFrame([("m", "p", "{}", "0"), ("m", "q", "{}", "0"), ("m", "p", "{}", "1")], "m string, p string, a string, s string")
    keyed = df.withColumn("request_key", request_key(*[F.col(c) for c in "mpas"]))
    assert keyed.select("request_key").distinct().count() == 3
    answers = keyed.filter("p = 'q'").select("request_key", F.lit("yes").alias("answer"))
    assert open_requests(keyed, answers).count() == 2 and answered_requests(keyed, answers).count() == 1


# -- metrics: values worked out by hand ---------------------------------------------------------------


def test_executability(spark):
    counts = spark.createDataFrame([("x", 13, 1, 4, 2, 0), ("y", 0, 0, 0, 0, 0)], "m string, valid int, json_error int, unknown_expectation int, invalid_kwargs int, runtime_error int")
    errors = spark.createDataFrame([("x", 3)], "m string, n_runtime_errors int")
    got = {r["m"]: r["executability"] for r in metrics.executability(counts, errors, ["m"]).collect()}
    assert got == {"x": 0.5, "y": None}


def test_false_positive_rates(spark):
    out = spark.createDataFrame([(False,), (True,), (True,), (True,)], "success boolean")
    assert metrics.rule_false_positive_rate(out).first()[0] == 1 / 4
    assert metrics.rule_false_positive_rate(out.filter("false")).first()[0] is None
    ids = spark.createDataFrame([(17,), (2,), (17,), (40,), (2,), (8,)], "_row_id bigint")
    assert metrics.row_false_positive_rate(spark.range(50), ids).first()[0] == 4 / 50


def test_detection(spark):
    flagged = spark.createDataFrame([(11,), (12,), (13,), (14,), (30,)], "_row_id bigint")
    labels = spark.createDataFrame([(12, "missing_value"), (14, "missing_value"), (15, "missing_value"), (11, "duplicate_row")], "_row_id bigint, error_type string")
    d = metrics.detection_scores(flagged, labels).first()
    assert (d["true_positives"], d["precision"], d["recall"], d["f1"]) == (3, 3 / 5, 3 / 4, pytest.approx(2 / 3))
    assert {r["error_type"]: r["recall"] for r in metrics.recall_by_type(flagged, labels).collect()} == {"missing_value": 2 / 3, "duplicate_row": 1.0}
    assert {r[0] for r in metrics.true_positives(flagged, labels).collect()} == {11, 12, 14}
    nothing = metrics.detection_scores(flagged.filter("false"), labels.filter("false")).first()
    assert (nothing["precision"], nothing["recall"], nothing["f1"]) == (None, None, None)
    apart = metrics.detection_scores(flagged.filter("_row_id = 30"), labels).first()
    assert apart["f1"] == 0.0


def test_redundancy_and_size(spark):
    rules = spark.createDataFrame([("n", '{"column":"p"}')] * 3 + [("u", '{"column":"p"}'), ("n", '{"column":"q"}')], "expectation_type string, kwargs string")
    assert metrics.redundancy(rules).first()[0] == 2
    assert metrics.suite_size(rules).first()[0] == 5


def test_redundancy_deals_rules_out_before_it_counts(spark):
    kind = "response_id long, expectation_type string, kwargs string"
    rules = spark.createDataFrame([(1, "n", "a"), (1, "n", "a"), (1, None, "a"), (1, "n", None), (None, "n", "a"), (None, "n", "a"), (2, "u", "b")], kind)
    counted = metrics.redundancy(rules, ["response_id"])
    assert {r[0]: r[1] for r in counted.collect()} == {1: 3, None: 1, 2: 0}
    assert metrics.redundancy(rules.limit(0)).first()[0] == 0
    plan = counted._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    first = plan[plan.rindex("HashAggregate"):]
    assert "REPARTITION_BY_COL" in first


def test_parsed_rules_are_not_dealt_out_by_type(spark):
    answers = spark.createDataFrame([(1, '[{"expectation_type":"expect_column_values_to_not_be_null","kwargs":{"column":"a"}}]')], "response_id long, text string")
    parsed = parse_rules(answers)
    assert [(r["status"], r["kwargs"]) for r in parsed.collect()] == [("valid", '{"column":"a"}')]
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_long_facts(spark):
    wide = spark.createDataFrame([("s", 0.5, None)], "method string, precision double, recall double")
    rows = metrics.long_facts(wide, ["precision", "recall"]).collect()
    assert rows[0].asDict().keys() == set(metrics.FACT_COLUMNS) and {(r["metric"], r["value"], r["error_type"]) for r in rows} == {
        ("precision", 0.5, "overall"), ("recall", None, "overall")}


def test_profiles_of_other_types(spark):
    from rowassay.operators.bind import bind_rules
    from rowassay.operators.profile import profile_length, profile_range, profile_rules, profile_value_set
    from rowassay.operators.validate import outcomes

    df = spark.range(60).selectExpr(
        "id AS _row_id", "date_add(DATE '2024-02-27', CAST(id % 4 AS int)) AS day", "CAST(id % 3 AS decimal(10,2)) AS price",
        "TIMESTAMP '2024-03-01 10:00:00' + make_interval(0, 0, 0, CAST(id % 5 AS int)) AS moment", "id % 2 = 0 AS even",
    )
    rules = profile_rules(df)
    sets = {r.kwargs["column"]: r.kwargs["value_set"] for r in rules if "value_set" in r.kwargs}
    assert sets["day"] == ["2024-02-27", "2024-02-28", "2024-02-29", "2024-03-01"] and sets["price"] == [0, 1, 2]
    assert len(sets["moment"]) == 5 and sets["even"] == [False, True]
    assert all(r["success"] for r in outcomes(df, bind_rules(rules, df)).collect())
    only = df.select("_row_id", "even")
    assert profile_range(only).count() == profile_length(only).count() == 0
    assert profile_value_set(df.select("_row_id")).count() == 0


def test_a_late_repeat_is_found(spark):
    """No estimate and no first look decides: the only repeat and the 21st category come last."""
    from rowassay.operators.profile import profile_rules

    df = spark.range(0, 20_000, 1, 4).selectExpr("id AS _row_id", "if(id = 19999, 0, id) AS nearly", "if(id >= 19990, id, id % 20) AS kind", "id AS key")
    kinds = {(r.expectation_type, r.kwargs["column"]) for r in profile_rules(df)}
    assert ("expect_column_values_to_be_unique", "key") in kinds and ("expect_column_values_to_be_unique", "nearly") not in kinds
    assert not any(t == "expect_column_values_to_be_in_set" for t, _ in kinds)


def test_a_profile_is_two_jobs_however_many_columns(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from rowassay.operators.profile import _per_value, profile_ndv, profile_rules, profile_unique

    df = spark.range(500).selectExpr("id AS _row_id", *[f"id % {i + 1} AS c{i}" for i in range(15)], *[f"id * {i} AS k{i}" for i in range(15)])
    jobs = []
    for name in ("first", "collect", "count", "take", "toPandas"):
        monkeypatch.setattr(DataFrame, name, lambda self, *a, f=getattr(DataFrame, name), n=name: jobs.append(n) or f(self, *a))
    assert len(profile_rules(df)) > 60
    assert jobs[0] == "first" and len([j for j in jobs if j == "collect"]) <= 2 and "count" not in jobs  # first() itself collects
    monkeypatch.undo()
    fields = [f for f in df.schema if f.name != "_row_id"]
    text = _per_value(df, fields)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and text.count("Range (") == 1
    assert {r["column"] for r in profile_unique(df).collect() if r["is_unique"]} == {f"k{i}" for i in range(1, 15)}
    assert {r["column"]: r["n_distinct"] for r in profile_ndv(df, ["c3", "k0"]).collect()} == {"c3": 4, "k0": 1}
    gone = profile_unique(df.limit(0), ["c1"]).first()
    assert gone["is_unique"] and profile_ndv(df.limit(0), ["c1"]).first()["n_distinct"] == 0


def test_equal_values_of_any_type_count_as_one(spark):
    from rowassay.operators.profile import profile_ndv, profile_unique

    df = spark.sql(
        "SELECT * FROM VALUES (0.0D, TIMESTAMP '2024-01-01', '1', CAST(NULL AS int)), (-0.0D, TIMESTAMP '2024-01-01', '1.0', 1), "
        "(double('NaN'), NULL, NULL, NULL), (double('NaN'), TIMESTAMP '2024-01-02', '', 2) AS t(d, t, s, i)"
    )
    assert {r["column"]: r["n_distinct"] for r in profile_ndv(df).collect()} == {"d": 2, "t": 2, "s": 3, "i": 2}
    assert {r["column"]: r["is_unique"] for r in profile_unique(df).collect()} == {"d": False, "t": False, "s": True, "i": False}


def test_requests_do_not_depend_on_key_order(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"d": 2, "c": [3]}}',), ('{"b":{"c":[3],"d":2},"a":1}',), ("no json",)], "p string")
    keyed = df.withColumn("k", request_key(F.lit("m"), F.lit("q"), F.col("p"), F.lit("")))
    assert keyed.select("k").distinct().count() == 2
