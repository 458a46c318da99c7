"""Derive a suite of rules from a clean table, in two passes however many columns it has.

The first is one wide aggregate with a sketch of the number of different values of each column. The sketches rule out most
columns as keys or categories; those that remain are stacked as (column, value) and counted exactly in the second.
"""

from __future__ import annotations

import functools
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowassay import ROW_ID
from rowassay.operators.rules import Rule, rule

MAX_CATEGORIES = 20
NOTE = "holds on the clean table it was profiled from"


def _visible(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema if f.name != ROW_ID]


def _comparable(t: T.DataType) -> bool:
    return not isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def _numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def _fractional(t: T.DataType) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType))


def _plain_zero(c: Column) -> Column:
    """Zero and minus zero are equal, so which one an aggregate keeps is chance; adding zero settles it."""
    return c + F.lit(0.0)


def _rows(df: DataFrame, aggregates: list, structs: list, schema: str) -> DataFrame:
    if not structs:
        return df.sparkSession.createDataFrame([], schema)
    return df.agg(*aggregates).select(F.inline(F.array(*structs)))


def profile_nulls(df: DataFrame) -> DataFrame:
    """Per column: missing values, and whether there are none."""
    aggs, out = [F.count("*").alias("_n")], []
    for i, f in enumerate(_visible(df)):
        aggs.append(F.count(f"`{f.name}`").alias(f"_v{i}"))
        missing = F.col("_n") - F.col(f"_v{i}")
        out.append(F.struct(
            F.lit(f.name).alias("column"), F.col("_n").alias("n_rows"), missing.alias("n_missing"),
            (missing == 0).alias("complete"),
        ))
    return _rows(df, aggs, out, "column string, n_rows bigint, n_missing bigint, complete boolean")


def profile_range(df: DataFrame) -> DataFrame:
    """Per numeric column with any value: smallest and largest."""
    aggs, out = [], []
    for i, f in enumerate(f for f in _visible(df) if _numeric(f.dataType)):
        c = F.col(f"`{f.name}`").cast("double")
        aggs += [_plain_zero(F.min(c)).alias(f"_lo{i}"), _plain_zero(F.max(c)).alias(f"_hi{i}")]
        out.append(F.struct(
            F.lit(f.name).alias("column"), F.col(f"_lo{i}").alias("min_value"), F.col(f"_hi{i}").alias("max_value")
        ))
    return _rows(df, aggs, out, "column string, min_value double, max_value double").filter("min_value is not null")


def profile_length(df: DataFrame) -> DataFrame:
    """Per text column with any value: shortest and longest length."""
    aggs, out = [], []
    for i, f in enumerate(f for f in _visible(df) if isinstance(f.dataType, T.StringType)):
        length = F.char_length(f"`{f.name}`")
        aggs += [F.min(length).alias(f"_lo{i}"), F.max(length).alias(f"_hi{i}")]
        out.append(F.struct(
            F.lit(f.name).alias("column"), F.col(f"_lo{i}").alias("min_length"), F.col(f"_hi{i}").alias("max_length")
        ))
    return _rows(df, aggs, out, "column string, min_length int, max_length int").filter("min_length is not null")


# A column's values are counted in one of three slots, whatever their types: equal values have equal slots, others differ.
_SLOTS = ("_text", "_whole", "_real")


def _slots(f: T.StructField) -> list[Column]:
    """The value of a column in the slot of its type, nulls in the others."""
    c, t = F.col(f"`{f.name}`"), f.dataType
    text, whole, real = (F.lit(None).cast(kind) for kind in ("string", "bigint", "double"))
    if _fractional(t):
        real = c.cast("double")
    elif isinstance(t, (T.IntegralType, T.BooleanType)):
        whole = c.cast("bigint")
    elif isinstance(t, T.TimestampType):  # its text may say two hours alike when clocks go back
        whole = F.unix_micros(c)
    else:
        text = c.cast("string")
    return [v.alias(n) for v, n in zip((text, whole, real), _SLOTS)]


def _per_value(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Rows of every (column, value), all columns stacked: one scan and one shuffle, combined before it."""
    cells = F.array(*[F.struct(F.lit(i).alias("_column"), *_slots(f)) for i, f in enumerate(fields)])
    return df.select(F.inline(cells)).groupBy("_column", *_SLOTS).agg(F.count("*").alias("_copies"))


def _chosen(df: DataFrame, columns: list[str] | None) -> list[T.StructField]:
    return [f for f in _visible(df) if (_comparable(f.dataType) if columns is None else f.name in columns)]


_HAS_VALUE = functools.reduce(lambda a, b: f"{a} OR {b}", (f"{n} IS NOT NULL" for n in _SLOTS))


def _per_column(df: DataFrame, columns: list[str] | None, name: str, kind: str, found: str, empty: str) -> DataFrame:
    """One aggregate over the values of each column; ``empty`` is its value without rows."""
    fields = _chosen(df, columns)
    if not fields:
        return df.sparkSession.createDataFrame([], f"column string, {name} {kind}")
    names = df.sparkSession.createDataFrame([(i, f.name) for i, f in enumerate(fields)], "_column int, column string")
    counted = _per_value(df, fields).groupBy("_column").agg(F.expr(found).alias(name))
    return names.join(counted, "_column", "left").select("column", F.expr(f"coalesce({name}, {empty})").alias(name))


def profile_unique(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: is every value different? A single missing value is a value of its own."""
    return _per_column(df, columns, "is_unique", "boolean", "max(_copies) = 1", "true")


def profile_ndv(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: exact number of different values, missing ones left out."""
    return _per_column(df, columns, "n_distinct", "bigint", f"count_if({_HAS_VALUE})", "0L")


# Sketches of the number of different values say which columns are worth an exact count, with room for their error: a key's
# estimate would have to be off by ten times its standard error to be passed over, and up to some hundred values the
# estimate of so few is never larger than _MAY_BE_SET times their number.
_SKETCH_BITS, _MAY_BE_KEY, _MAY_BE_SET = 12, 0.84, 2  # 2^12 registers: a standard error of 1.6 %


def _describe(df: DataFrame) -> dict:
    """The wide aggregate: one row for the whole table."""
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(_visible(df)):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"valid{i}"))
        if _comparable(f.dataType):
            # one object a column; approx_count_distinct has hundreds of fields in the aggregate's buffer at this precision
            sketch = F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), _SKETCH_BITS)
            aggs.append(F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0)).alias(f"kinds{i}"))
        if _numeric(f.dataType):
            aggs += [_plain_zero(F.min(c.cast("double"))).alias(f"lo{i}"), _plain_zero(F.max(c.cast("double"))).alias(f"hi{i}")]
        if isinstance(f.dataType, T.StringType):
            aggs += [F.min(F.char_length(c)).alias(f"lo{i}"), F.max(F.char_length(c)).alias(f"hi{i}")]
    return df.agg(*aggs).first().asDict()


def _maybe_sets(df: DataFrame, seen: dict, limit: int) -> list[T.StructField]:
    return [
        f for i, f in enumerate(_visible(df))
        if _comparable(f.dataType) and not _fractional(f.dataType) and 0 < seen[f"kinds{i}"] <= _MAY_BE_SET * limit
    ]


def _maybe_keys(df: DataFrame, seen: dict) -> list[T.StructField]:
    n = seen["n"]
    return [
        f for i, f in enumerate(_visible(df))
        if _comparable(f.dataType) and n - seen[f"valid{i}"] <= 1 and seen[f"kinds{i}"] >= _MAY_BE_KEY * seen[f"valid{i}"]
    ]


def _shown(fields: list[T.StructField]) -> Column:
    """A counted value as text, as Spark writes its type."""
    text = F.col("_text")
    for i, f in enumerate(fields):
        here = F.col("_column") == i
        if isinstance(f.dataType, T.TimestampType):
            text = F.when(here, F.timestamp_micros("_whole").cast("string")).otherwise(text)
        elif isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            text = F.when(here, F.col("_whole").cast(f.dataType).cast("string")).otherwise(text)
    return text


def _value(text: str, t: T.DataType):
    """A value as a rule has it: numbers and flags as such, times and texts as text."""
    if isinstance(t, T.IntegralType):
        return int(text)
    if isinstance(t, T.BooleanType):
        return text == "true"
    return _json_value(Decimal(text)) if isinstance(t, T.DecimalType) else text


def _exact(df: DataFrame, keys: list[T.StructField], sets: list[T.StructField], limit: int) -> tuple[set[str], dict[str, list]]:
    """(columns that are keys, sorted values of those that have few), from one stacked count."""
    fields = keys + [f for f in sets if f not in keys]
    if not fields:
        return set(), {}
    # only columns whose sketch says few are collected; their number of values is checked on the way
    may = F.col("_column").isin([i for i, f in enumerate(fields) if f in sets])
    counted = _per_value(df, fields).groupBy("_column").agg(
        (F.max("_copies") == 1).alias("key"),
        F.count_if(F.expr(_HAS_VALUE)).alias("kinds"),
        F.collect_list(F.when(may & F.expr(_HAS_VALUE), _shown(fields))).alias("values"),
    )
    few = F.when(F.col("kinds") <= limit, F.col("values"))
    found = counted.select("_column", "key", few.alias("values")).collect()  # one row a column
    unique = {fields[r["_column"]].name for r in found if r["key"] and fields[r["_column"]] in keys}
    values = {}
    for r in found:
        f = fields[r["_column"]]
        if r["values"] and f in sets:
            values[f.name] = sorted(_value(v, f.dataType) for v in r["values"])
    return unique, values


def profile_value_set(df: DataFrame, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """Per category column: its values, one per row, as text."""
    fields = _maybe_sets(df, _describe(df), max_categories)
    if not fields:
        return df.sparkSession.createDataFrame([], "column string, value string")
    names = df.sparkSession.createDataFrame([(i, f.name) for i, f in enumerate(fields)], "_column int, column string")
    values = _per_value(df, fields).filter(_HAS_VALUE).select("_column", _shown(fields).alias("value"))
    few = values.withColumn("_n", F.count("*").over(Window.partitionBy("_column"))).filter(F.col("_n") <= max_categories)
    return few.join(names, "_column").select("column", "value")


def _json_value(value):
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    return value


def profile_rules(df: DataFrame, max_categories: int = MAX_CATEGORIES) -> list[Rule]:
    """Rules that hold on ``df``: completeness, ranges, uniqueness, categories, text lengths."""
    seen = _describe(df)
    n, fields = seen["n"], _visible(df)
    unique, sets = _exact(df, _maybe_keys(df, seen), _maybe_sets(df, seen, max_categories), max_categories)

    rules: list[Rule] = []
    for i, f in enumerate(fields):
        name, t = f.name, f.dataType
        if seen[f"valid{i}"] == n:
            rules.append(rule("expect_column_values_to_not_be_null", NOTE, column=name))
        if _numeric(t) and seen[f"lo{i}"] is not None:
            rules.append(rule(
                "expect_column_values_to_be_between", NOTE,
                column=name, min_value=seen[f"lo{i}"], max_value=seen[f"hi{i}"],
            ))
        if name in unique:
            rules.append(rule("expect_column_values_to_be_unique", NOTE, column=name))
        if name in sets:
            rules.append(rule("expect_column_values_to_be_in_set", NOTE, column=name, value_set=sets[name]))
        if isinstance(t, T.StringType) and seen[f"lo{i}"] is not None:
            rules.append(rule(
                "expect_column_value_lengths_to_be_between", NOTE,
                column=name, min_value=seen[f"lo{i}"], max_value=seen[f"hi{i}"],
            ))
    return rules


def rules_frame(spark: SparkSession, suites: dict[str, list[Rule]]) -> DataFrame:
    """Suites as a table: one row per rule, arguments as JSON text."""
    rows = [
        (suite, i, r.expectation_type, r.kwargs_json, r.rationale)
        for suite, rules in suites.items()
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(
        rows, "suite_id string, rule_index int, expectation_type string, kwargs string, rationale string"
    )
