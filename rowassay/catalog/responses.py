"""Queries: rule suites read out of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowassay.catalog.registry import query
from rowassay.catalog.views import raw
from rowassay.operators.metrics import redundancy
from rowassay.operators.parse import extract_array, parse_rules, status_counts, suite_summary, valid_rules
from rowassay.operators.rules import RULE_SPECS, STATUSES
from rowassay.session import fresh_path
from rowassay.sources.sinks import write_suite_summary

_TICKS = "```"


def _rule_text(t: str, kwargs: str) -> str:
    return f'{{"expectation_type":"{t}","kwargs":{kwargs},"rationale":"event @E"}}'


_NOT_NULL = _rule_text("expect_column_values_to_not_be_null", '{"column":"@T"}')
_BETWEEN = _rule_text("expect_column_values_to_be_between", '{"column":"value","max_value":@U,"min_value":0}')
# The same arguments in another order.
_SWAPPED = _rule_text("expect_column_values_to_be_between", '{"min_value":0,"max_value":@U,"column":"value"}')

# Answers in every shape a reader may meet. @T, @U and @E stand for the event's type, user and id.
SHAPES = [
    f"[{_NOT_NULL},{_BETWEEN}]",
    f"Suite of event @E, as JSON:\n{_TICKS}json\n[{_NOT_NULL}]\n{_TICKS}\nEnd of the suite [one rule].",
    f"User @U asked for [{_BETWEEN}] and nothing else.",
    '[{"expectation_type":"expect_@T","kwargs":{}}]',
    "[" + _rule_text("expect_column_values_to_not_be_null", '{"bad":@U}') + "]",
    "[" + _rule_text("expect_column_values_to_not_be_null", '"@T"') + "]",
    f'["@T is a word",{_NOT_NULL},@U,null,[]]',
    '[{"kwargs":{"column":"@T"}},{"expectation_type":"","kwargs":{}},{"expectation_type":@U}]',
    "Event @E has no values to check.",
    "[]",
    '[{"expectation_type": @T}]',
    f"[{_NOT_NULL},{_NOT_NULL},{_BETWEEN},{_SWAPPED},"
    + _rule_text("expect_column_values_to_be_between", '{"column":"value","max_value":null,"min_value":null}') + ","
    + _rule_text("expect_column_values_to_be_between", '{"column":"value","max_value":null,"min_value":@U}') + ","
    + _rule_text("expect_column_values_to_not_be_null", "null") + ","
    + '{"expectation_type":"expect_column_values_to_not_be_null"},'
    + _rule_text("expect_column_pair_values_a_to_be_greater_than_b", '{"column_A":"@T","column_B":"value","or_equal":true}') + "]",
    f"{_TICKS}\nno array here\n{_TICKS}\n[{_NOT_NULL}]",
]


def responses(spark, sf):
    """One generated answer per event."""
    shape = F.element_at(F.array(*[F.lit(s) for s in SHAPES]), (F.col("event_id") % len(SHAPES) + 1).cast("int"))
    text = F.replace(F.replace(F.replace(shape, F.lit("@T"), F.col("event_type")),
                               F.lit("@U"), F.col("user_id").cast("string")),
                     F.lit("@E"), F.col("event_id").cast("string"))
    model = F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string"))
    condition = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("user_id") % 7 % 3 + 1).cast("int"))
    return raw(spark, sf, "events").select(
        F.col("event_id").alias("response_id"), model.alias("model"), condition.alias("condition"), text.alias("text"),
        F.char_length("props").cast("bigint").alias("prompt_tokens"), F.char_length(text).cast("bigint").alias("completion_tokens"),
        F.col("value").alias("latency_s"),
    )


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SHAPE_LIST = "[" + ", ".join(_quoted(s) for s in SHAPES) + "]"
_RESPONSES = (
    f"resp0 AS (SELECT *, replace(replace(replace(({_SHAPE_LIST})[event_id % {len(SHAPES)} + 1], '@T', event_type), "
    "'@U', CAST(user_id AS VARCHAR)), '@E', CAST(event_id AS VARCHAR)) AS txt FROM events), "
    "resp AS (SELECT event_id AS response_id, 'm' || user_id % 3 AS model, (['a', 'b', 'c'])[user_id % 7 % 3 + 1] AS condition, "
    "txt AS text, length(props) AS prompt_tokens, length(txt) AS completion_tokens, value AS latency_s FROM resp0)"
)
_FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def _extract(source: str, key: str) -> str:
    return (
        f"body AS (SELECT *, CASE WHEN regexp_matches(text, '{_FENCE}') THEN regexp_extract(text, '{_FENCE}', 1) ELSE text END AS body FROM {source}), "
        "spans AS (SELECT *, instr(body, '[') AS i, CASE WHEN instr(reverse(body), ']') = 0 THEN 0 ELSE length(body) - instr(reverse(body), ']') + 1 END AS j FROM body), "
        "arrays AS (SELECT *, CASE WHEN i > 0 AND j > i THEN substr(body, i, j - i + 1) END AS found FROM spans)"
    )


@query("extract_array", f"WITH {_RESPONSES}, {_extract('resp', 'response_id')} SELECT response_id, found FROM arrays")
def q_extract_array(spark, sf):
    return responses(spark, sf).select("response_id", extract_array(F.col("text")).alias("found"))


@query(
    "extract_array_pages",
    f"WITH resp AS (SELECT page_id, html AS text FROM pages), {_extract('resp', 'page_id')} SELECT page_id, found FROM arrays",
)
def q_extract_array_pages(spark, sf):
    return raw(spark, sf, "pages").select("page_id", extract_array(F.col("html")).alias("found"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


_SPECS = "spec AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS t, {_list(s.required)} AS required, {_list(s.accepted)} AS accepted, {_list(s.any_of)} AS any_of"
    for t, s in RULE_SPECS.items()
) + ")"

_PARSED = (
    f"{_RESPONSES}, {_extract('resp', 'response_id')}, {_SPECS}, "
    "checked AS (SELECT *, coalesce(json_valid(found), false) AS json_ok FROM arrays), "
    "good AS (SELECT response_id, model, condition, try_cast(found AS JSON) AS doc, unnest(range(CAST(json_array_length(try_cast(found AS JSON)) AS BIGINT))) AS rule_index "
    "FROM checked WHERE json_ok), "
    "items AS (SELECT response_id, model, condition, true AS json_ok, rule_index, doc->('$[' || rule_index || ']') AS item FROM good "
    "UNION ALL SELECT response_id, model, condition, false, 0, NULL FROM checked WHERE NOT json_ok), "
    "fields AS (SELECT *, coalesce(json_type(item) = 'OBJECT', false) AS is_object, "
    "CASE WHEN json_type(item, '$.expectation_type') = 'VARCHAR' THEN item->>'$.expectation_type' END AS expectation_type, "
    "json_type(item, '$.kwargs') AS kt, item->'$.kwargs' AS kw, item->>'$.rationale' AS rationale FROM items), "
    "typed AS (SELECT *, kt IS NULL OR kt = 'OBJECT' AS kwargs_ok, "
    "CASE WHEN kt = 'OBJECT' THEN json_keys(kw) ELSE [] END AS keys FROM fields), "
    "joined AS (SELECT * FROM typed LEFT JOIN spec ON expectation_type = t), "
    "fitted AS (SELECT *, len(list_filter(keys, lambda k: NOT list_contains(accepted, k))) = 0 "
    "AND len(list_filter(required, lambda k: NOT list_contains(keys, k))) = 0 "
    "AND (len(any_of) = 0 OR coalesce(json_type(kw, '$.min_value'), 'NULL') <> 'NULL' "
    "OR coalesce(json_type(kw, '$.max_value'), 'NULL') <> 'NULL') AS fits FROM joined), "
    "parsed AS (SELECT response_id, model, condition, json_ok, rule_index, expectation_type, "
    "CASE WHEN NOT json_ok OR NOT is_object OR coalesce(expectation_type, '') = '' THEN 'json_error' "
    "WHEN NOT kwargs_ok THEN 'invalid_kwargs' WHEN t IS NULL THEN 'unknown_expectation' "
    "WHEN NOT fits THEN 'invalid_kwargs' ELSE 'valid' END AS status, "
    "CASE WHEN kwargs_ok THEN '{' || array_to_string(list_transform(list_sort(keys), "
    "lambda k: '\"' || k || '\":' || CAST(kw->('$.' || k) AS VARCHAR)), ',') || '}' END AS kwargs, rationale FROM fitted)"
)


@query(
    "parse_rules",
    f"WITH {_PARSED} SELECT response_id, json_ok, rule_index, status, expectation_type, kwargs, rationale FROM parsed",
)
def q_parse_rules(spark, sf):
    return parse_rules(responses(spark, sf)).select(
        "response_id", "json_ok", "rule_index", "status", "expectation_type", "kwargs", "rationale"
    )


# Texts that Python's JSON reader accepts and a strict one does not; the last is accepted by none.
_LENIENT = [
    '[{"expectation_type":"expect_column_values_to_be_between","kwargs":{"min_value":NaN,"column":"value","max_value":@U}}]',
    'Rules: [{"expectation_type":"first","expectation_type":"expect_column_values_to_not_be_null","kwargs":{"column":"x","column":"@T"},"rationale":NaN}]',
    '[{"expectation_type":NaN,"kwargs":{}}, NaN, {"expectation_type":"expect_column_values_to_not_be_null","kwargs":-Infinity}]',
    '[{"expectation_type":"expect_column_max_to_be_between","kwargs":{"column":"\\"NaN\\" of @T","max_value":Infinity,"min_value":-Infinity}}]',
    '[{"expectation_type":"expect_column_values_to_be_in_set","kwargs":{"column":"@T","value_set":[NaN,-1,"-Infinity",{"a":1,"a":@U}]}}]',
    "[Nope of @T, NaN]",
]
_LENIENT_SQL = """
SELECT event_id AS response_id, true AS json_ok, 0 AS rule_index, 'valid' AS status, 'expect_column_values_to_be_between' AS expectation_type,
  '{"column":"value","max_value":' || user_id || ',"min_value":NaN}' AS kwargs, NULL AS rationale FROM events WHERE event_id % 6 = 0
UNION ALL SELECT event_id, true, 0, 'valid', 'expect_column_values_to_not_be_null', '{"column":"' || event_type || '"}', 'NaN' FROM events WHERE event_id % 6 = 1
UNION ALL SELECT event_id, true, 0, 'json_error', NULL, '{}', NULL FROM events WHERE event_id % 6 = 2
UNION ALL SELECT event_id, true, 1, 'json_error', NULL, '{}', NULL FROM events WHERE event_id % 6 = 2
UNION ALL SELECT event_id, true, 2, 'invalid_kwargs', 'expect_column_values_to_not_be_null', NULL, NULL FROM events WHERE event_id % 6 = 2
UNION ALL SELECT event_id, true, 0, 'valid', 'expect_column_max_to_be_between',
  '{"column":"\\"NaN\\" of ' || event_type || '","max_value":Infinity,"min_value":-Infinity}', NULL FROM events WHERE event_id % 6 = 3
UNION ALL SELECT event_id, true, 0, 'valid', 'expect_column_values_to_be_in_set',
  '{"column":"' || event_type || '","value_set":[NaN,-1,"-Infinity",{"a":' || user_id || '}]}', NULL FROM events WHERE event_id % 6 = 4
UNION ALL SELECT event_id, false, 0, 'json_error', NULL, '{}', NULL FROM events WHERE event_id % 6 = 5
"""


@query("parse_lenient", _LENIENT_SQL)
def q_parse_lenient(spark, sf):
    """Repeated keys, NaN and infinities, as Python reads them."""
    shape = F.element_at(F.array(*[F.lit(s) for s in _LENIENT]), (F.col("event_id") % len(_LENIENT) + 1).cast("int"))
    text = F.replace(F.replace(shape, F.lit("@T"), F.col("event_type")), F.lit("@U"), F.col("user_id").cast("string"))
    answers = raw(spark, sf, "events").select(F.col("event_id").alias("response_id"), text.alias("text"))
    return parse_rules(answers).select("response_id", "json_ok", "rule_index", "status", "expectation_type", "kwargs", "rationale")


@query(
    "classify_rules",
    f"WITH {_PARSED} SELECT model, condition, status, json_ok, count(*) AS n_rules FROM parsed GROUP BY ALL",
)
def q_classify_rules(spark, sf):
    return parse_rules(responses(spark, sf)).groupBy("model", "condition", "status", "json_ok").agg(F.count("*").alias("n_rules"))


@query("valid_rules", f"WITH {_PARSED} SELECT response_id, rule_index, expectation_type, kwargs FROM parsed WHERE status = 'valid'")
def q_valid_rules(spark, sf):
    return valid_rules(parse_rules(responses(spark, sf))).select("response_id", "rule_index", "expectation_type", "kwargs")


_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {{p}}{s}" for s in STATUSES)


@query("status_counts", f"WITH {_PARSED} SELECT model, condition, {_COUNTS.format(p='')} FROM parsed GROUP BY ALL")
def q_status_counts(spark, sf):
    return status_counts(parse_rules(responses(spark, sf)), ["model", "condition"])


@query(
    "suite_summary",
    f"WITH {_PARSED}, c AS (SELECT response_id, count(*) AS n, {_COUNTS.format(p='n_')} FROM parsed GROUP BY ALL) "
    "SELECT response_id, model, condition, coalesce(n, 0) AS n_rules_total, "
    + ", ".join(f"coalesce(n_{s}, 0) AS n_{s}" for s in STATUSES[:-1])
    + ", prompt_tokens, completion_tokens, latency_s FROM resp LEFT JOIN c USING (response_id)",
)
def q_suite_summary(spark, sf):
    """One flat row per answer, through its sink."""
    answers = responses(spark, sf)
    summary = suite_summary(
        answers, parse_rules(answers), ["response_id", "model", "condition"],
        ["prompt_tokens", "completion_tokens", "latency_s"],
    )
    path = fresh_path(spark, "generation")
    write_suite_summary(summary, path)
    return spark.read.parquet(path)


@query(
    "redundancy",
    f"WITH {_PARSED} SELECT response_id, count(*) - count(DISTINCT expectation_type || kwargs) AS redundancy "
    "FROM parsed WHERE status = 'valid' GROUP BY response_id",
)
def q_redundancy(spark, sf):
    return redundancy(valid_rules(parse_rules(responses(spark, sf))), ["response_id"])
