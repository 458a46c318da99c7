"""Evaluate a suite of rules over a table in as few passes as the rules allow.

All row and table rules share one scan, as long as their code fits into one generated function; larger suites are dealt into
passes by the columns they read, so that each column is still read about once. Every distinct uniqueness key adds one grouped
count. Schema rules and rules that could not be bound cost nothing.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowassay import ROW_ID
from rowassay.operators.bind import ERROR, KEY, ROW, SCHEMA, TABLE, BoundRule, bind_rules
from rowassay.operators.rules import Rule
from rowassay.operators.sets import with_sets
from rowassay.session import materialize

#: What one pass may hold: Spark generates code for operators of at most 100 fields, and the JVM compiles methods of at most
#: 8,000 bytes. A comparison takes up to 70 bytes.
PASS_FIELDS, PASS_COMPARISONS = 80, 100

OUTCOME_SCHEMA = (
    "rule_index int, expectation_type string, kwargs string, success boolean, unexpected_count bigint, "
    "element_count bigint, is_row_level boolean, exception string"
)


class MissingRowId(ValueError):
    """The table carries no row id, so flagged rows could not be named."""


def require_row_id(df: DataFrame) -> None:
    if ROW_ID not in df.columns:
        raise MissingRowId(f"the table must carry {ROW_ID!r}")


def state_aggregate(rule: BoundRule, within: Column | None = None) -> Column:
    """The table statistic of a TABLE rule, over the rows where ``within`` holds."""
    value = rule.state.value if within is None else F.when(within, rule.state.value)
    how = {"min": F.min, "max": F.max, "mean": F.avg, "bad": F.sum, "rows": F.count}[rule.state.how]
    return how(value)


def passes(rule: BoundRule, unexpected: Column, counted: Column | None) -> Column:
    """Verdict of a ROW or KEY rule; an empty base passes."""
    if rule.mostly >= 1.0:
        return unexpected == 0
    return F.coalesce(1 - F.try_divide(unexpected, counted) >= F.lit(rule.mostly), F.lit(True))


def _text(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _outcome(rule: BoundRule, success: str, unexpected: str, row_level: bool) -> str:
    """SQL of an outcome over columns of counts; text, because a suite may have thousands and a Column takes a call each part."""
    return (
        f"named_struct('rule_index', {rule.index}, 'expectation_type', {_text(rule.rule.expectation_type)}, 'kwargs', {_text(rule.rule.kwargs_json)}, "
        f"'success', {success}, 'unexpected_count', CAST({unexpected} AS bigint), 'element_count', CAST(_n AS bigint), "
        f"'is_row_level', {str(row_level).lower()}, 'exception', CAST(NULL AS string))"
    )


def _verdict(rule: BoundRule, unexpected: str, counted: str) -> str:
    """SQL of ``passes``."""
    if rule.mostly >= 1.0:
        return f"{unexpected} = 0"
    return f"coalesce(1 - try_divide({unexpected}, {counted}) >= CAST({rule.mostly!r} AS double), true)"


def by_key(bound: list[BoundRule]) -> dict[tuple[str, ...], list[BoundRule]]:
    keys: dict[tuple[str, ...], list[BoundRule]] = {}
    for b in bound:
        if b.kind == KEY:
            keys.setdefault(b.key, []).append(b)
    return keys


def count_keys(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """How many rows carry each value of a key."""
    return df.groupBy(*key).agg(F.count("*").alias("_copies"))


def repeated_keys(df: DataFrame, rule: BoundRule) -> DataFrame:
    """Key values carried by more than one row, with their row counts."""
    return df.filter(rule.counted).groupBy(*rule.key).agg(F.count("*").alias("_copies")).filter("_copies > 1")


def _key_outcomes(per_key: DataFrame, rules: list[BoundRule]) -> DataFrame:
    first = rules[0]
    counts = per_key.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("_n"),
        F.coalesce(F.sum(F.when(first.counted, F.col("_copies"))), F.lit(0)).alias("_counted"),
        F.coalesce(F.sum(F.when(first.counted & (F.col("_copies") > 1), F.col("_copies"))), F.lit(0)).alias("_bad"),
    )
    rows = [_outcome(r, _verdict(r, "_bad", "_counted"), "_bad", True) for r in rules]
    return counts.select(F.expr(f"inline(array({', '.join(rows)}))"))


def _fields(b: BoundRule) -> int:
    """Buffers that the rule's aggregates take."""
    return 2 if b.mostly < 1.0 or (b.kind == TABLE and b.state.how == "mean") else 1


def _comparisons(b: BoundRule) -> int:
    """About how much code the rule's test is: pairs within a record are all compared, everything else once or twice."""
    n = len(b.columns)
    return n * n if "within_record" in b.rule.expectation_type else 1 + n


def code_passes(bound: list[BoundRule]) -> list[list[BoundRule]]:
    """Row and table rules dealt into passes whose generated code stays small; rules of a column go to one pass if they fit."""
    rules = [b for b in bound if b.kind in (ROW, TABLE)]
    parts: list[list[BoundRule]] = [[]]
    fields = comparisons = 0
    whole = sum(map(_fields, rules)) <= PASS_FIELDS and sum(map(_comparisons, rules)) <= PASS_COMPARISONS
    for b in rules if whole else sorted(rules, key=lambda b: b.columns):
        if parts[-1] and (fields + _fields(b) > PASS_FIELDS or comparisons + _comparisons(b) > PASS_COMPARISONS):
            parts.append([])
            fields = comparisons = 0
        parts[-1].append(b)
        fields, comparisons = fields + _fields(b), comparisons + _comparisons(b)
    return [p for p in parts if p]


def _pass_outcomes(df: DataFrame, rules: list[BoundRule]) -> DataFrame:
    """Outcomes of the rules of one pass, from one aggregate."""
    aggregates, verdicts, rows = [F.count("*").alias("_n")], {}, []
    for b in rules:
        if b.kind == ROW:
            aggregates.append(F.count_if(b.violated).alias(f"_u{b.index}"))
            if b.mostly < 1.0:
                aggregates.append(F.count_if(b.counted).alias(f"_c{b.index}"))
            rows.append(_outcome(b, _verdict(b, f"_u{b.index}", f"_c{b.index}"), f"_u{b.index}", True))
        else:
            aggregates.append(state_aggregate(b).alias(f"_g{b.index}"))
            verdicts[f"_p{b.index}"] = F.coalesce(b.state.holds(F.col(f"_g{b.index}")), F.lit(False))
            rows.append(_outcome(b, f"_p{b.index}", "NULL", False))
    counts = with_sets(df, rules).agg(*aggregates)
    return (counts.withColumns(verdicts) if verdicts else counts).select(F.expr(f"inline(array({', '.join(rows)}))"))


def outcomes(df: DataFrame, bound: list[BoundRule], counted: dict[tuple, DataFrame] | None = None) -> DataFrame:
    """One row per rule: its verdict and how many rows it flags. ``counted`` holds key counts there are already."""
    counted = counted or {}
    parts = [_pass_outcomes(df, rules) for rules in code_passes(bound)]
    parts += [_key_outcomes(counted.get(key, count_keys(df, key)), rules) for key, rules in by_key(bound).items()]
    settled = [
        (b.index, b.rule.expectation_type, b.rule.kwargs_json, b.passes, None, None, False, b.error)
        for b in bound
        if b.kind in (SCHEMA, ERROR)
    ]
    if settled or not parts:
        parts.append(df.sparkSession.createDataFrame(settled, OUTCOME_SCHEMA))
    return functools.reduce(DataFrame.unionByName, parts)


def _key_flags(df: DataFrame, rule: BoundRule, counted: dict[tuple, DataFrame] | None = None) -> DataFrame:
    """Ids of all rows whose key is repeated.

    Only the repeated keys meet the table again, in a semi join that AQE broadcasts when they are
    few and splits where one key is hot.
    """
    per_key = (counted or {}).get(rule.key)
    repeated = repeated_keys(df, rule) if per_key is None else per_key.filter(rule.counted & (F.col("_copies") > 1))
    repeated = repeated.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(rule.key)])
    rows = df.filter(rule.counted).select(ROW_ID, *rule.key)
    equal = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(rule.key)]
    if len(rule.key) == 1:
        equal = [F.col(f"`{rule.key[0]}`") == F.col("_k0")]
    return rows.join(repeated, functools.reduce(Column.__and__, equal), "left_semi").select(ROW_ID)


def flags(df: DataFrame, bound: list[BoundRule], counted: dict[tuple, DataFrame] | None = None) -> DataFrame:
    """One row per (row id, rule) hit."""
    parts = []
    for rules in code_passes([b for b in bound if b.kind == ROW]):
        # Filtering after the explode keeps the rules in generated code; array_compact would not.
        hits = F.array(*[F.when(b.violated, F.lit(b.index)) for b in rules])
        exploded = with_sets(df, rules).select(ROW_ID, F.explode(hits).alias("rule_index"))
        parts.append(exploded.filter("rule_index is not null"))
    for rules in by_key(bound).values():
        ids = _key_flags(df, rules[0], counted)
        parts.append(ids.select(ROW_ID, F.explode(F.array(*[F.lit(r.index) for r in rules])).alias("rule_index")))
    if not parts:
        return df.sparkSession.createDataFrame([], f"{ROW_ID} bigint, rule_index int")
    return functools.reduce(DataFrame.unionByName, parts)


def flagged_rows(df: DataFrame, bound: list[BoundRule]) -> DataFrame:
    """Ids of rows hit by at least one rule, once each."""
    parts = []
    for rules in code_passes([b for b in bound if b.kind == ROW]):
        hit = functools.reduce(Column.__or__, [b.violated for b in rules])
        parts.append(with_sets(df, rules).filter(hit).select(ROW_ID))
    parts += [_key_flags(df, rules[0]) for rules in by_key(bound).values()]
    if not parts:
        return df.sparkSession.createDataFrame([], f"{ROW_ID} bigint")
    union = functools.reduce(DataFrame.unionByName, parts)
    return union.distinct() if len(parts) > 1 else union


def validate_suite(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(outcomes, flags) of a suite over a table that carries row ids. Keys are counted once for both."""
    require_row_id(df)
    bound = bind_rules(rules, df)
    counted = {key: materialize(count_keys(df, key), "keys") for key in by_key(bound)}
    return outcomes(df, bound, counted), flags(df, bound, counted)


def suite_outcomes(outcome_table: DataFrame) -> DataFrame:
    """Counts over outcomes: rules that failed, rules that could not run, whether anything failed."""
    failed = F.coalesce(~F.col("success"), F.lit(False))
    return outcome_table.agg(
        F.count("*").alias("n_rules"),
        F.count_if(failed).alias("n_failed"),
        F.count_if(F.col("success").isNull()).alias("n_runtime_errors"),
        F.coalesce(F.bool_or(failed), F.lit(False)).alias("dataset_detected"),
    )
