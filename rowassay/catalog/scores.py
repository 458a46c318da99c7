"""Queries: metrics, the grid of suites and variants, and the report tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowassay import ROW_ID
from rowassay.catalog import sqltext
from rowassay.catalog.gridsql import SqlRule, SqlSuite, grid_sql, human_rules, profiled_rules
from rowassay.catalog.injections import _MIX, _MIX_SLICES, COLUMNS, PLANNED, planned
from rowassay.catalog.registry import ORACLE, query
from rowassay.catalog.responses import _SPECS as SPECS
from rowassay.catalog.rules import _MIXED_BAG, view
from rowassay.catalog.suites import FLAGGED, FRAMES, hit_counts
from rowassay.catalog.views import SQL, frame
from rowassay.operators import metrics, report
from rowassay.operators.bind import bind_rules
from rowassay.operators.inject import inject, inject_mixed, injector
from rowassay.operators.parse import parse_rules, status_counts
from rowassay.operators.profile import profile_rules
from rowassay.operators.rules import STATUSES, build_rules, rule
from rowassay.operators.validate import flagged_rows, outcomes, suite_outcomes
from rowassay.plans.grid import Grid
from rowassay.plans.judge import Suite, facts_frame
from rowassay.plans.run import DELTA, score_manifest, write_injections
from rowassay.plans.suites import hand_written
from rowassay.session import fresh_path, materialize
from rowassay.sources.scan import scan_manifest, scan_results
from rowassay.sources.sinks import write_manifest, write_report, write_results

# -- single metrics ------------------------------------------------------------------------------


@query("fp_rate_rules", f"SELECT count(*) FILTER (NOT success) / CAST(count(*) AS DOUBLE) AS fp_rate_rules FROM ({ORACLE['validate_suite']})")
def q_fp_rate_rules(spark, sf):
    df = view(spark, sf, "orders_gap")
    return metrics.rule_false_positive_rate(outcomes(df, bind_rules(_MIXED_BAG, df)))


@query("fp_rate_rows", f"SELECT count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM lineitem) AS fp_rate_rows FROM ({ORACLE['flagged_rows']})")
def q_fp_rate_rows(spark, sf):
    df = frame(spark, sf, "lineitem_rcv")
    return metrics.row_false_positive_rate(df, flagged_rows(df, bind_rules(hand_written("tpch_lineitem"), df)))


@query("suite_size", " UNION ALL ".join(
    f"SELECT '{t}' AS suite_id, count(*) AS suite_size FROM ({hit_counts(t, SQL[v])})" for t, v in FRAMES.items()))
def q_suite_size(spark, sf):
    parts = []
    for t, v in FRAMES.items():
        df = frame(spark, sf, v)
        size = metrics.suite_size(outcomes(df, bind_rules(hand_written(t), df)))
        parts.append(size.select(F.lit(t).alias("suite_id"), "suite_size"))
    return functools.reduce(DataFrame.unionByName, parts)


@query("long_facts", " UNION ALL ".join(
    f"SELECT 'human' AS model, suite_id AS dataset, 'baseline' AS condition, CAST(NULL AS INTEGER) AS repetition, 'human' AS method, "
    f"'overall' AS error_type, CAST(NULL AS DOUBLE) AS rate, NULL AS seed, '{m}' AS metric, CAST({m} AS DOUBLE) AS value "
    f"FROM ({ORACLE['suite_outcomes']})" for m in ("n_rules", "n_failed", "n_runtime_errors")))
def q_long_facts(spark, sf):
    parts = []
    for t, v in FRAMES.items():
        df = frame(spark, sf, v)
        wide = suite_outcomes(outcomes(df, bind_rules(hand_written(t), df)))
        parts.append(wide.select(
            F.lit("human").alias("model"), F.lit(t).alias("dataset"), F.lit("baseline").alias("condition"),
            F.lit("human").alias("method"), "*",
        ))
    wide = functools.reduce(DataFrame.unionByName, parts)
    return metrics.long_facts(wide, ["n_rules", "n_failed", "n_runtime_errors"])


# A missing-value variant of orders, found by a completeness rule beside one that also fires wrongly.
_MISSING = injector("missing_value", column="o_orderstatus")
_FINDERS = [
    rule("expect_column_values_to_not_be_null", column="o_orderstatus"),
    rule("expect_column_values_to_be_between", column="o_totalprice", max_value=495000),
]
_FOUND = (
    f"{sqltext.ranked(SQL['orders'], [1])}, s AS (SELECT *, r1 <= {sqltext.count_of(0.05)} AS lab FROM r), "
    "f AS (SELECT _row_id, lab, lab OR o_totalprice > 495000 AS hit FROM s)"
)


def _found(spark, sf):
    corrupted, labels = inject(frame(spark, sf, "orders"), _MISSING, 0.05, 1, "orders")
    return flagged_rows(corrupted, bind_rules(_FINDERS, corrupted)), labels


_F1 = "CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1"


@query(
    "detection",
    f"WITH {_FOUND}, c AS (SELECT count(*) FILTER (hit) AS n_flagged, count(*) FILTER (lab) AS n_injected, "
    "count(*) FILTER (hit AND lab) AS true_positives FROM f), "
    "d AS (SELECT *, true_positives / CAST(n_flagged AS DOUBLE) AS p, true_positives / CAST(n_injected AS DOUBLE) AS r FROM c) "
    f"SELECT n_flagged, n_injected, true_positives, p AS precision, r AS recall, {_F1} FROM d",
)
def q_detection(spark, sf):
    return metrics.detection_scores(*_found(spark, sf))


@query("true_positives", f"WITH {_FOUND} SELECT _row_id FROM f WHERE hit AND lab")
def q_true_positives(spark, sf):
    return metrics.true_positives(*_found(spark, sf))


def _mixed_found_sql() -> str:
    items, last = sqltext.chain("v", _MIX_SLICES)
    lab = "CASE " + " ".join(
        f"WHEN {sqltext._hit(s)} THEN '{s.injector.error_type}'" for s in _MIX_SLICES if s.injector.column) + " END"
    cols = ", ".join(f'"{c}"' for c in COLUMNS["events_trip"])
    copy = next(s for s in _MIX_SLICES if s.injector.column is None)
    hit = " OR ".join(f"coalesce({p}, false)" for p in FLAGGED["events_trip"])
    return (
        f"WITH {', '.join([sqltext.ranked(SQL['events_trip'], [5, 1005]), *items])}, "
        f"fr AS (SELECT {cols}, {lab} AS lab FROM {last} UNION ALL SELECT {cols}, 'duplicate_row' FROM {last} WHERE {sqltext._hit(copy)}) "
        f"SELECT lab AS error_type, count(*) AS n_injected, count(*) FILTER ({hit}) AS n_found, "
        f"count(*) FILTER ({hit}) / CAST(count(*) AS DOUBLE) AS recall FROM fr WHERE lab IS NOT NULL GROUP BY lab"
    )


@query("recall_by_type", _mixed_found_sql())
def q_recall_by_type(spark, sf):
    corrupted, labels = inject_mixed(frame(spark, sf, "events_trip"), _MIX, 5, "events_trip")
    return metrics.recall_by_type(flagged_rows(corrupted, bind_rules(hand_written("events_trip"), corrupted)), labels)


# -- generated suites for the customer table -----------------------------------------------------------


def _r(t: str, kwargs: str) -> str:
    return f'{{"expectation_type":"{t}","kwargs":{kwargs}}}'


# Answers of two models under three conditions. @LO @HI @MEAN @N stand for measures of the table.
_ANSWERS = {
    ("llm:small", "a"): "[" + ",".join([
        _r("expect_column_values_to_not_be_null", '{"column":"c_custkey"}'),
        _r("expect_column_values_to_be_between", '{"column":"c_acctbal","max_value":@HI,"min_value":@MEAN}'),
        _r("expect_sensible_values", "{}"), _r("expect_column_values_to_be_unique", '{"columns":["c_custkey"]}'),
    ]) + "]",
    ("llm:small", "b"): "Here are the rules:\n```json\n[" + ",".join([
        _r("expect_column_values_to_be_unique", '{"column":"c_custkey"}'),
        _r("expect_column_values_to_be_between", '{"column":"c_nationkey","max_value":24,"min_value":0}'),
        _r("expect_column_values_to_not_be_null", '{"column":"zip"}'),
    ]) + "]\n```",
    ("llm:small", "c"): "I would rather not.",
    ("llm:large", "a"): "[" + ",".join([
        _r("expect_column_values_to_not_be_null", '{"column":"c_name"}'),
        _r("expect_column_values_to_be_between", '{"column":"c_acctbal","max_value":@HI,"min_value":@LO}'),
        _r("expect_column_values_to_be_in_set", '{"column":"c_mktsegment","value_set":["AUTOMOBILE","BUILDING","FURNITURE","HOUSEHOLD","MACHINERY"]}'),
        _r("expect_column_max_to_be_between", '{"column":"c_acctbal","max_value":@HI}'),
    ]) + "]",
    ("llm:large", "b"): "[" + ",".join([
        _r("expect_column_values_to_be_unique", '{"column":"c_name"}'),
        _r("expect_column_values_to_not_be_null", '{"column":"c_name"}'),
        _r("expect_column_values_to_not_be_null", '{"column":"c_name"}'),
        _r("expect_table_row_count_to_be_between", '{"max_value":@N,"min_value":1}'),
        _r("expect_column_mean_to_be_between", '{"column":"c_acctbal","max_value":@HI,"min_value":0}'),
        _r("expect_column_min_to_be_between", '{"column":"c_acctbal","min_value":@LO}'),
        _r("expect_column_distinct_values_to_be_in_set", '{"column":"c_mktsegment","value_set":["AUTOMOBILE","BUILDING","FURNITURE","HOUSEHOLD","MACHINERY"]}'),
    ]) + "]",
    ("llm:large", "c"): "[" + ",".join([
        _r("expect_column_values_to_be_in_set", '{"column":"c_mktsegment","value_set":["BUILDING","MACHINERY"]}'),
        _r("expect_column_values_to_match_regex", '{"column":"c_name","regex":"^Customer#[0-9]+$"}'),
        _r("expect_column_value_lengths_to_be_between", '{"column":"c_mktsegment","max_value":10,"min_value":8}'),
        _r("expect_compound_columns_to_be_unique", '{"column_list":["c_name","c_acctbal"]}'),
        _r("expect_column_values_to_be_of_type", '{"column":"c_acctbal","type_":"float64"}'),
    ]) + "]",
}
_SEGMENTS = "('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')"
_LO, _HI, _MEAN = (f"(SELECT {a}(c_acctbal) FROM b)" for a in ("min", "max", "avg"))
_OUT = f"c_acctbal < {_LO} OR c_acctbal > {_HI}"
_GENERATED_SQL = [
    SqlSuite("llm:large", "a", (
        SqlRule("c_name IS NULL"), SqlRule(_OUT), SqlRule(f"c_mktsegment NOT IN {_SEGMENTS}"),
        SqlRule(holds=f"max(c_acctbal) <= {_HI}"),
    ), counts=(4, 0, 0, 0)),
    SqlSuite("llm:large", "b", (
        SqlRule("c_name IS NOT NULL AND count(*) OVER (PARTITION BY vid, c_name) > 1"), SqlRule("c_name IS NULL"), SqlRule("c_name IS NULL"),
        SqlRule(holds="count(*) BETWEEN 1 AND (SELECT count(*) FROM b)"), SqlRule(holds=f"avg(c_acctbal) BETWEEN 0 AND {_HI}"),
        SqlRule(holds=f"min(c_acctbal) >= {_LO}"),
        SqlRule(holds=f"count(*) FILTER (c_mktsegment NOT IN {_SEGMENTS}) = 0"),
    ), redundancy=1, counts=(7, 0, 0, 0)),
    SqlSuite("llm:large", "c", (
        SqlRule("c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"), SqlRule("NOT regexp_matches(c_name, '^Customer#[0-9]+$')"),
        SqlRule("length(c_mktsegment) NOT BETWEEN 8 AND 10"),
        SqlRule("count(*) OVER (PARTITION BY vid, c_name, c_acctbal) > 1"), SqlRule(holds="true"),
    ), counts=(5, 0, 0, 0)),
    SqlSuite("llm:small", "a", (SqlRule("c_custkey IS NULL"), SqlRule(f"c_acctbal < {_MEAN} OR c_acctbal > {_HI}")), counts=(2, 0, 1, 1)),
    SqlSuite("llm:small", "b", (
        SqlRule("count(*) OVER (PARTITION BY vid, c_custkey) > 1"), SqlRule("c_nationkey NOT BETWEEN 0 AND 24"), SqlRule(),
    ), counts=(3, 0, 0, 0)),
    SqlSuite("llm:small", "c", (), counts=(0, 1, 0, 0)),
]
_GENERATED_SQL = [
    SqlSuite(s.method, s.condition, s.rules, s.redundancy, s.counts, ("(SELECT count(*) FROM b)", str(sum(s.counts)), "NULL"))
    for s in _GENERATED_SQL
]


def customer_answers(spark, sf) -> DataFrame:
    """Generated answers about the customer table, with bounds measured on it."""
    measures = frame(spark, sf, "customer").agg(
        F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.avg("c_acctbal").alias("mean"), F.count("*").alias("n")
    )
    rows = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(c).alias("condition"), F.lit(t).alias("text")) for (m, c), t in _ANSWERS.items()
    ])
    text = F.col("text")
    for mark, c in (("@LO", "lo"), ("@HI", "hi"), ("@MEAN", "mean"), ("@N", "n")):
        text = F.replace(text, F.lit(mark), F.col(c).cast("string"))
    answers = measures.select("*", F.inline(rows))
    return answers.select("model", "condition", text.alias("text"), F.col("n").alias("prompt_tokens"))


def customer_suites(spark, sf) -> list[Suite]:
    """Suites parsed from the answers: a handful of rules each."""
    parsed = materialize(parse_rules(customer_answers(spark, sf)), "parsed")
    by: dict[tuple, dict] = {}
    for r in parsed.orderBy("model", "condition", "rule_index").collect():
        suite = by.setdefault((r["model"], r["condition"]), {"records": [], "counts": dict.fromkeys(STATUSES, 0), "n": r["prompt_tokens"]})
        suite["counts"][r["status"]] += 1
        if r["status"] == "valid":
            suite["records"].append({"expectation_type": r["expectation_type"], "kwargs": r["kwargs"]})
    return [
        Suite(model, condition, 0, tuple(build_rules(s["records"])), s["counts"],
              {"prompt_tokens": s["n"], "completion_tokens": sum(s["counts"].values())})
        for (model, condition), s in sorted(by.items())
    ]


def _executability_sql() -> str:
    """Rules that are valid and whose columns the table has, over all rules of an answer: read from the answers in SQL."""
    marks = {"@LO": _LO, "@HI": _HI, "@MEAN": _MEAN, "@N": "(SELECT count(*) FROM b)"}
    answers = []
    for (model, condition), text in _ANSWERS.items():
        sql = "'" + text.replace("'", "''") + "'"
        for mark, value in marks.items():
            sql = f"replace({sql}, '{mark}', CAST({value} AS VARCHAR))"
        answers.append(f"SELECT '{model}' AS model, '{condition}' AS condition, {sql} AS text")
    needed = "['column', 'column_list', 'columns']"
    return (
        f"WITH b AS (SELECT * FROM customer), {SPECS}, a AS ({' UNION ALL '.join(answers)}), "
        "e AS (SELECT model, condition, json_extract(regexp_extract(text, '(?s)\\[.*\\]', 0), '$[*]') AS items FROM a WHERE contains(text, '[')), "
        "i AS (SELECT model, condition, unnest(items) AS item FROM e), "
        "k AS (SELECT model, condition, spec.t IS NOT NULL AND len(list_filter(json_keys(item, '$.kwargs'), lambda x: NOT list_contains(accepted, x))) = 0 AS valid, "
        f"flatten(list_transform({needed}, lambda n: CASE json_type(item, '$.kwargs.' || n) WHEN 'VARCHAR' THEN [item->>('$.kwargs.' || n)] "
        "WHEN 'ARRAY' THEN CAST(item->('$.kwargs.' || n) AS VARCHAR[]) ELSE [] END)) AS used "
        "FROM i LEFT JOIN spec ON spec.t = item->>'$.expectation_type'), "
        "c AS (SELECT list(column_name) AS columns FROM (DESCRIBE customer)), "
        "s AS (SELECT model, condition, count(*) AS n, count(*) FILTER (valid AND list_has_all(columns, used)) AS good FROM k, c GROUP BY ALL) "
        "SELECT model, condition, coalesce(good / CAST(n AS DOUBLE), 0) AS executability FROM a LEFT JOIN s USING (model, condition)"
    )


@query("executability", _executability_sql())
def q_executability(spark, sf):
    """Executable share of the generated suites, runtime errors taken from a run on the table."""
    customer = frame(spark, sf, "customer")
    counts = status_counts(parse_rules(customer_answers(spark, sf)), ["model", "condition"])
    parts = []
    for s in customer_suites(spark, sf):
        errors = suite_outcomes(outcomes(customer, bind_rules(list(s.rules), customer))).select("n_runtime_errors")
        parts.append(errors.select(F.lit(s.method).alias("model"), F.lit(s.condition).alias("condition"), "n_runtime_errors"))
    errors = functools.reduce(DataFrame.unionByName, parts)
    return metrics.executability(counts, errors, ["model", "condition"])


# -- the grid ------------------------------------------------------------------------------------


_written: dict[tuple[str, str, str], DataFrame] = {}


def baseline_suites(spark, sf, table: str) -> list[Suite]:
    base = frame(spark, sf, PLANNED[table]).select(ROW_ID, *COLUMNS[PLANNED[table]])
    return [
        Suite("stats", "baseline", 0, tuple(profile_rules(base))),
        Suite("human", "baseline", 0, tuple(hand_written(table))),
    ]


def grid(spark, sf, table: str, cap: int | None = None) -> Grid:
    suites = baseline_suites(spark, sf, table)
    if table == "tpch_customer":
        suites += customer_suites(spark, sf)
    return Grid(planned(spark, sf, table), suites, table, cap, 7)


def grid_facts(spark, sf, table: str) -> DataFrame:
    """Metric facts of a table's grid, evaluated and written by this run."""
    g = grid(spark, sf, table)
    root = fresh_path(spark, f"facts-{table}")
    write_results(facts_frame(spark, g.clean_facts() + g.detection_facts()), root)
    return scan_results(spark, f"{root}/facts.parquet")


def stored_facts(spark, sf, table: str) -> DataFrame:
    """The facts that reports read: those of the first run in this application."""
    key = (spark.sparkContext.applicationId, sf, table)
    if key not in _written:
        _written[key] = grid_facts(spark, sf, table)
    return _written[key]


def sql_suites(table: str) -> list[SqlSuite]:
    suites = [
        SqlSuite("stats", "baseline", profiled_rules(PLANNED[table])),
        SqlSuite("human", "baseline", human_rules(table)),
    ]
    return suites + _GENERATED_SQL if table == "tpch_customer" else suites


_OVERALL = "error_type = 'overall'"


@query("clean_facts", grid_sql("tpch_customer", sql_suites("tpch_customer"), "clean"))
def q_clean_facts(spark, sf):
    return grid_facts(spark, sf, "tpch_customer").filter(_OVERALL)


@query("detection_facts", grid_sql("tpch_customer", sql_suites("tpch_customer"), "detection"))
def q_detection_facts(spark, sf):
    return grid_facts(spark, sf, "tpch_customer").filter(f"NOT {_OVERALL}")


for _table in ("tpch_orders", "tpch_lineitem", "events_trip"):
    @query(f"validate_grid_{_table}", grid_sql(_table, sql_suites(_table)))
    def q_validate_table(spark, sf, table=_table):
        return grid_facts(spark, sf, table)


_ALL = " UNION ALL ".join(f"SELECT * FROM ({grid_sql(t, sql_suites(t))})" for t in PLANNED)


def all_facts(spark, sf) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, [stored_facts(spark, sf, t) for t in PLANNED])


@query("validate_grid", _ALL)
def q_validate_grid(spark, sf):
    """Every suite on every variant of every table."""
    return functools.reduce(DataFrame.unionByName, [grid_facts(spark, sf, t) for t in PLANNED])


@query("validate_manifest", f"SELECT * FROM ({grid_sql('tpch_orders', sql_suites('tpch_orders'), 'detection')})")
def q_validate_manifest(spark, sf):
    """Variants of orders written to disk, found through their manifest and scored there."""
    root = fresh_path(spark, "written")
    manifest = write_injections({"tpch_orders": planned(spark, sf, "tpch_orders")}, root)
    write_manifest(manifest, f"{root}/manifest")
    return score_manifest(scan_manifest(spark, f"{root}/manifest"), {"tpch_orders": baseline_suites(spark, sf, "tpch_orders")})


@query("validate_deltas", f"SELECT * FROM ({grid_sql('tpch_customer', sql_suites('tpch_customer'), 'detection')})")
def q_validate_deltas(spark, sf):
    """Variants of customers stored as deltas, all eight suites judged on them in one pass a schema."""
    root = fresh_path(spark, "deltas")
    manifest = write_injections({"tpch_customer": planned(spark, sf, "tpch_customer")}, root, DELTA)
    write_manifest(manifest, f"{root}/manifest")
    suites = baseline_suites(spark, sf, "tpch_customer") + customer_suites(spark, sf)
    return score_manifest(scan_manifest(spark, f"{root}/manifest"), {"tpch_customer": suites})


@query("scan_results", f"SELECT dataset, method, metric, count(*) AS n_facts, count(value) AS n_defined FROM ({_ALL}) GROUP BY ALL")
def q_scan_results(spark, sf):
    root = fresh_path(spark, "results")
    write_results(all_facts(spark, sf), root)
    facts = scan_results(spark, f"{root}/facts.parquet")
    return facts.groupBy("dataset", "method", "metric").agg(F.count("*").alias("n_facts"), F.count("value").alias("n_defined"))


# -- reports -------------------------------------------------------------------------------------

_REPORT_METHODS = ["human", "llm:large", "llm:small", "stats"]


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    """Averages to six places: the order of summation is not fixed."""
    return df.withColumns({c: F.round(f"`{c}`", 6) for c in columns})


def _mean(where: str) -> str:
    return f"round(avg(value) FILTER ({where}), 6)"


_R1 = (
    "SELECT model, " + ", ".join(f"{_mean(f'metric = {m!r}')} AS {m}" for m in report.MODEL_METRICS)
    + f" FROM facts WHERE metric IN ({', '.join(map(repr, report.MODEL_METRICS))}) GROUP BY model"
)
_R2 = (
    "SELECT error_type, " + ", ".join(f"{_mean(f'method = {m!r}')} AS \"{m}\"" for m in _REPORT_METHODS)
    + " FROM facts WHERE metric = 'recall_by_type' GROUP BY error_type"
)
_R3 = (
    "SELECT method, " + ", ".join(f"{_mean(f'metric = {m!r}')} AS {m}" for m in report.OVERALL_METRICS)
    + " FROM facts WHERE metric IN ('precision', 'recall', 'f1') AND error_type <> 'mixed' GROUP BY method"
)
_R4 = (
    f"SELECT condition, {_mean(chr(39).join(['metric = ', 'executability', '']))} AS executability, "
    f"{_mean(chr(39).join(['metric = ', 'recall_by_type', '']))} AS recall "
    "FROM facts WHERE starts_with(method, 'llm:') GROUP BY condition"
)
_R5 = "SELECT model, round(avg(value), 6) AS executability FROM facts WHERE metric = 'executability' GROUP BY model"


def _over_facts(select: str) -> str:
    return f"WITH facts AS MATERIALIZED ({_ALL}) {select}"


@query("report_executability", _over_facts(_R1))
def q_report_executability(spark, sf):
    return _rounded(report.table_executability(all_facts(spark, sf)), report.MODEL_METRICS)


@query("report_recall_by_type", _over_facts(_R2))
def q_report_recall_by_type(spark, sf):
    facts = all_facts(spark, sf)
    methods = report.method_names(facts)
    return _rounded(report.table_recall_by_type(facts, methods), methods)


@query("report_overall", _over_facts(_R3))
def q_report_overall(spark, sf):
    return _rounded(report.table_overall(all_facts(spark, sf)), report.OVERALL_METRICS)


@query("report_condition", _over_facts(_R4))
def q_report_condition(spark, sf):
    return _rounded(report.table_condition(all_facts(spark, sf)), ["executability", "recall"])


@query("rank_models", _over_facts(_R5))
def q_rank_models(spark, sf):
    return _rounded(report.rank_models(all_facts(spark, sf)), ["executability"])


@query("report_all", _over_facts(
    f"SELECT 'executability_by_model' AS report, model AS row_name, 'executability' AS measure, executability AS value FROM ({_R1}) "
    f"UNION ALL SELECT 'recall_by_error_type', error_type, 'human', human FROM ({_R2}) "
    f"UNION ALL SELECT 'detection_overall', method, 'f1', f1 FROM ({_R3}) "
    f"UNION ALL SELECT 'condition_comparison', condition, 'recall', recall FROM ({_R4}) "
    f"UNION ALL SELECT 'models_by_executability', model, 'executability', executability FROM ({_R5})"))
def q_report_all(spark, sf):
    """All report tables written as CSV and read back, one measure of each."""
    tables = report.report_tables(all_facts(spark, sf))
    root = fresh_path(spark, "report")
    write_report(tables, root)
    shown = {
        "executability_by_model": ("model", "executability"), "recall_by_error_type": ("error_type", "human"),
        "detection_overall": ("method", "f1"), "condition_comparison": ("condition", "recall"),
        "models_by_executability": ("model", "executability"),
    }
    parts = []
    for name, (row, measure) in shown.items():
        read = spark.read.csv(f"{root}/{name}.csv", header=True)
        parts.append(read.select(
            F.lit(name).alias("report"), F.col(row).alias("row_name"), F.lit(measure).alias("measure"),
            F.round(F.col(f"`{measure}`").cast("double"), 6).alias("value"),
        ))
    return functools.reduce(DataFrame.unionByName, parts)
