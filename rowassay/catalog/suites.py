"""Queries: hand-written suites, profiling, outcomes and flags."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowassay.catalog.registry import query
from rowassay.catalog.views import SQL, frame, raw
from rowassay.operators.bind import bind_rules
from rowassay.operators.profile import (
    profile_length, profile_ndv, profile_nulls, profile_range, profile_rules, profile_unique, profile_value_set,
    rules_frame,
)
from rowassay.operators.rules import build_rules
from rowassay.operators.validate import flagged_rows, outcomes, suite_outcomes
from rowassay.plans.suites import hand_written
from rowassay.session import fresh_path
from rowassay.sources.scan import scan_rules

# Hand-written suites and the frames they run on.
FRAMES = {
    "tpch_customer": "customer", "tpch_orders": "orders", "tpch_lineitem": "lineitem_rcv", "events_trip": "events_trip",
}

# SQL for a flagged row, per hand-written rule, in suite order.
FLAGGED = {
    "tpch_customer": [
        "c_custkey IS NULL", "count(*) OVER (PARTITION BY c_custkey) > 1", "c_nationkey NOT BETWEEN 0 AND 24",
        "c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')", "c_name IS NULL",
    ],
    "tpch_orders": [
        "o_orderkey IS NULL", "count(*) OVER (PARTITION BY o_orderkey) > 1", "o_custkey IS NULL",
        "o_orderstatus NOT IN ('O', 'F', 'P')", "o_totalprice NOT BETWEEN 0 AND 100000000",
        "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')",
    ],
    "tpch_lineitem": [
        "l_orderkey IS NULL", "count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1",
        "l_quantity NOT BETWEEN 1 AND 50", "l_discount NOT BETWEEN 0.0 AND CAST(0.1 AS DOUBLE)",
        "l_tax NOT BETWEEN 0.0 AND CAST(0.08 AS DOUBLE)", "l_extendedprice NOT BETWEEN 0 AND 100000000",
        "l_returnflag NOT IN ('R', 'A', 'N')", "l_linestatus NOT IN ('O', 'F')", "NOT l_receiptdate >= l_shipdate",
    ],
    "events_trip": [
        '"start" IS NULL', '"end" IS NULL', 'NOT "end" > "start"', "value NOT BETWEEN 0 AND 100000",
        "event_type NOT IN ('click', 'error', 'purchase', 'signup', 'view')", "user_id NOT BETWEEN 0 AND 100000000",
    ],
}


def union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def hit_counts(table: str, source: str) -> str:
    """SQL: flagged rows per hand-written rule."""
    hits = ", ".join(f"coalesce({p}, false) AS h{i}" for i, p in enumerate(FLAGGED[table]))
    rules = hand_written(table)
    return " UNION ALL ".join(
        f"SELECT '{table}' AS suite_id, {i} AS rule_index, '{rules[i].expectation_type}' AS expectation_type, "
        f"count(*) FILTER (h{i}) = 0 AS success, count(*) FILTER (h{i}) AS unexpected_count, count(*) AS element_count "
        f"FROM (SELECT {hits} FROM ({source}))"
        for i in range(len(rules))
    )


@query("human_suite", " UNION ALL ".join(hit_counts(t, SQL[v]) for t, v in FRAMES.items()))
def q_human_suite(spark, sf):
    """Every hand-written suite over its table."""
    parts = []
    for table, v in FRAMES.items():
        df = frame(spark, sf, v)
        out = outcomes(df, bind_rules(hand_written(table), df))
        parts.append(out.select(
            F.lit(table).alias("suite_id"), "rule_index", "expectation_type", "success", "unexpected_count", "element_count"
        ))
    return union(parts)


@query(
    "suite_outcomes",
    f"WITH o AS ({' UNION ALL '.join(hit_counts(t, SQL[v]) for t, v in FRAMES.items())}) "
    "SELECT suite_id, count(*) AS n_rules, count(*) FILTER (NOT success) AS n_failed, 0 AS n_runtime_errors, "
    "bool_or(NOT success) AS dataset_detected FROM o GROUP BY suite_id",
)
def q_suite_outcomes(spark, sf):
    parts = []
    for table, v in FRAMES.items():
        df = frame(spark, sf, v)
        out = suite_outcomes(outcomes(df, bind_rules(hand_written(table), df)))
        parts.append(out.select(F.lit(table).alias("suite_id"), "*"))
    return union(parts)


@query(
    "flagged_rows",
    f"SELECT _row_id FROM (SELECT _row_id, {' OR '.join(f'coalesce({p}, false)' for p in FLAGGED['tpch_lineitem'])} AS hit "
    f"FROM ({SQL['lineitem_rcv']})) WHERE hit",
)
def q_flagged_rows(spark, sf):
    df = frame(spark, sf, "lineitem_rcv")
    return flagged_rows(df, bind_rules(hand_written("tpch_lineitem"), df))


# -- profiling -------------------------------------------------------------------------------------

COLUMNS = {
    "customer": [("c_custkey", "i"), ("c_name", "s"), ("c_nationkey", "i"), ("c_acctbal", "f"), ("c_mktsegment", "s")],
    "orders": [
        ("o_orderkey", "i"), ("o_custkey", "i"), ("o_orderstatus", "s"), ("o_totalprice", "f"), ("o_orderdate", "t"),
        ("o_orderpriority", "s"),
    ],
    "lineitem": [
        ("l_orderkey", "i"), ("l_partkey", "i"), ("l_suppkey", "i"), ("l_linenumber", "i"), ("l_quantity", "f"),
        ("l_extendedprice", "f"), ("l_discount", "f"), ("l_tax", "f"), ("l_returnflag", "s"), ("l_linestatus", "s"),
        ("l_shipdate", "t"),
    ],
    "events": [("event_id", "i"), ("ts", "t"), ("user_id", "i"), ("event_type", "s"), ("value", "f"), ("props", "s")],
}
_EVERY = [(t, c, k) for t, cols in COLUMNS.items() for c, k in cols]


def _profiled(spark, sf, operator, **kwargs):
    parts = [operator(raw(spark, sf, t), **kwargs).select(F.lit(t).alias("table_name"), "*") for t in COLUMNS]
    return union(parts)


def _per_column(select: str, kinds: str = "isft") -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS \"column\", {select.format(c=c)} FROM {t}"
        for t, c, k in _EVERY if k in kinds
    )


@query("profile_nulls", _per_column(
    "count(*) AS n_rows, count(*) - count({c}) AS n_missing, count(*) = count({c}) AS complete"))
def q_profile_nulls(spark, sf):
    return _profiled(spark, sf, profile_nulls)


@query("profile_range", _per_column(
    "CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value", "if"))
def q_profile_range(spark, sf):
    return _profiled(spark, sf, profile_range)


@query("profile_length", _per_column("min(length({c})) AS min_length, max(length({c})) AS max_length", "s"))
def q_profile_length(spark, sf):
    return _profiled(spark, sf, profile_length)


@query("profile_unique", _per_column(
    "count(*) = count(DISTINCT {c}) + least(1, count(*) - count({c})) AS is_unique"))
def q_profile_unique(spark, sf):
    return _profiled(spark, sf, profile_unique)


@query("profile_ndv", _per_column("count(DISTINCT {c}) AS n_distinct"))
def q_profile_ndv(spark, sf):
    return _profiled(spark, sf, profile_ndv)


@query("profile_value_set", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS \"column\", CAST(v AS VARCHAR) AS value FROM (SELECT DISTINCT {c} AS v FROM {t} "
    f"WHERE {c} IS NOT NULL) WHERE (SELECT count(DISTINCT {c}) FROM {t}) <= 20"
    for t, c, k in _EVERY if k != "f"))
def q_profile_value_set(spark, sf):
    return _profiled(spark, sf, profile_value_set)


def _number(sql: str) -> str:
    return f"CAST(CAST({sql} AS DOUBLE) + CAST(0 AS DOUBLE) AS VARCHAR)"


def profile_sql(t: str) -> str:
    """SQL that writes the same rules, in the same order, with the same JSON text."""
    rows = []
    for at, (c, k) in enumerate(COLUMNS[t]):
        name = f'"column":"{c}"'

        def add(step, kind, text, where, at=at):
            rows.append(f"SELECT {at * 10 + step} AS place, '{kind}' AS expectation_type, {text} AS kwargs, {where} AS holds FROM {t}")

        add(0, "expect_column_values_to_not_be_null", f"'{{{name}}}'", f"count(*) = count({c})")
        if k in "if":
            add(1, "expect_column_values_to_be_between",
                f"'{{{name},\"max_value\":' || {_number(f'max({c})')} || ',\"min_value\":' || {_number(f'min({c})')} || '}}'",
                f"count({c}) > 0")
        add(2, "expect_column_values_to_be_unique", f"'{{{name}}}'",
            f"count(*) = count(DISTINCT {c}) + least(1, count(*) - count({c}))")
        if k != "f":
            item = {"i": f"CAST({c} AS VARCHAR)", "s": f"'\"' || {c} || '\"'", "t": f"'\"' || strftime({c}, '%Y-%m-%d %H:%M:%S') || '\"'"}[k]
            add(3, "expect_column_values_to_be_in_set",
                f"'{{{name},\"value_set\":[' || string_agg(DISTINCT {item}, ',' ORDER BY {item}) || ']}}'"
                if k == "s" else
                f"'{{{name},\"value_set\":[' || array_to_string(list_transform(list_sort(list(DISTINCT {c})), lambda x: "
                + (f"CAST(x AS VARCHAR)" if k == "i" else "'\"' || strftime(x, '%Y-%m-%d %H:%M:%S') || '\"'") + "), ',') || ']}'",
                f"count(DISTINCT {c}) BETWEEN 1 AND 20")
        if k == "s":
            add(4, "expect_column_value_lengths_to_be_between",
                f"'{{{name},\"max_value\":' || max(length({c})) || ',\"min_value\":' || min(length({c})) || '}}'", f"count({c}) > 0")
    return (
        "SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS rule_index, expectation_type, kwargs "
        f"FROM ({' UNION ALL '.join(rows)}) WHERE holds"
    )


@query("profile_rules", " UNION ALL ".join(f"SELECT '{t}' AS suite_id, * FROM ({profile_sql(t)})" for t in COLUMNS))
def q_profile_rules(spark, sf):
    suites = {t: profile_rules(raw(spark, sf, t)) for t in COLUMNS}
    return rules_frame(spark, suites).drop("rationale")


@query("profile_suite", " UNION ALL ".join(
    f"SELECT '{t}' AS suite_id, rule_index, kwargs, true AS success, 0 AS unexpected_count, "
    f"(SELECT count(*) FROM {t}) AS element_count FROM ({profile_sql(t)})" for t in COLUMNS))
def q_profile_suite(spark, sf):
    """The profiled suite on the very table it came from: nothing may fail."""
    parts = []
    for t in COLUMNS:
        df = frame(spark, sf, t)
        out = outcomes(df, bind_rules(profile_rules(df), df))
        parts.append(out.select(
            F.lit(t).alias("suite_id"), "rule_index", "kwargs", "success", "unexpected_count", "element_count"
        ))
    return union(parts)


@query("rules_table", f"SELECT expectation_type, kwargs FROM ({profile_sql('orders')})")
def q_rules_table(spark, sf):
    """A rule file (one JSON array) written from a profile and read back."""
    rules = rules_frame(spark, {"orders": profile_rules(raw(spark, sf, "orders"))})
    record = F.concat(
        F.lit('{"expectation_type":"'), "expectation_type", F.lit('","kwargs":'), "kwargs",
        F.lit(',"rationale":"'), "rationale", F.lit('"}'),
    )
    path = fresh_path(spark, "rules")
    text = rules.coalesce(1).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ",\n"), F.lit("]")).alias("value"))
    text.write.text(path)
    return scan_rules(spark, path).drop("rationale")


@query("allowlist_check", " UNION ALL ".join(
    f"SELECT '{t}' AS suite_id, expectation_type, count(*) AS n_rules FROM ({profile_sql(t)}) GROUP BY ALL" for t in COLUMNS))
def q_allowlist_check(spark, sf):
    """Profiled rules beside as many of unknown type or with wrong arguments: only the former are built."""
    parts = []
    for t in COLUMNS:
        records = [{"expectation_type": r.expectation_type, "kwargs": r.kwargs} for r in profile_rules(raw(spark, sf, t))]
        spoiled = [{**r, "expectation_type": "expect_magic"} for r in records]
        spoiled += [{**r, "kwargs": {**r["kwargs"], "surprise": 1}} for r in records]
        parts.append(rules_frame(spark, {t: build_rules(spoiled + records)}))
    return union(parts).groupBy("suite_id", "expectation_type").agg(F.count("*").alias("n_rules"))
