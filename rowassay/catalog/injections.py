"""Queries: the error injectors, their labels, mixes and grids."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowassay import ROW_ID
from rowassay.catalog import sqltext
from rowassay.catalog.registry import query
from rowassay.catalog.views import LINEITEM, SQL, frame
from rowassay.functions.select import half_even, select_rows
from rowassay.operators.inject import inject, inject_mixed, injector
from rowassay.operators.metrics import labels_in
from rowassay.plans.injection import MIXED_RATE, injection_grid, plan_for
from rowassay.session import fresh_path
from rowassay.sources.scan import scan_manifest
from rowassay.sources.sinks import manifest_of, write_manifest

COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem_rcv": LINEITEM + ["l_receiptdate"],
    "lineitem_sum": LINEITEM + ["a", "b", "total"],
    "events_trip": ["event_id", "ts", "user_id", "event_type", "value", "props", "start", "end"],
}
PLANNED = {"tpch_customer": "customer", "tpch_orders": "orders", "tpch_lineitem": "lineitem_rcv", "events_trip": "events_trip"}
RATES, SEEDS = [0.01, 0.05], [1, 2]


def label_values(labels: DataFrame) -> DataFrame:
    """Label values as numbers where they are numbers, because engines write the same number differently."""
    def number(c):
        return F.col(c).try_cast("double")

    def text(c):
        return F.when(number(c).isNull(), F.col(c))

    return labels.withColumns({
        "original_number": number("original_value"), "original_text": text("original_value"),
        "corrupted_number": number("corrupted_value"), "corrupted_text": text("corrupted_value"),
    }).drop("original_value", "corrupted_value")


def _single(name: str, source: str, rate: float, seed: int, inj) -> None:
    slices = sqltext.single_slices(inj, rate, seed)
    items, select = sqltext.rows("v", slices, COLUMNS[source])
    sql = f"WITH {', '.join([sqltext.ranked(SQL[source], [seed]), *items])} {select}"

    @query(name, sql)
    def run(spark, sf):
        corrupted, _ = inject(frame(spark, sf, source).select(ROW_ID, *COLUMNS[source]), inj, rate, seed, source)
        return corrupted


_single("inject_missing", "orders", 0.05, 1, injector("missing_value", column="o_orderstatus"))
_single("inject_range_high", "orders", 0.05, 1, injector("out_of_range", column="o_totalprice", mode="high"))
_single("inject_range_low", "customer", 0.01, 2, injector("out_of_range", column="c_acctbal", mode="low"))
_single("inject_format", "events_trip", 0.05, 3, injector("type_or_format_error", column="event_type"))
_single("inject_format_typed", "orders", 0.01, 1, injector("type_or_format_error", column="o_custkey"))
_single("inject_category", "orders", 0.01, 1, injector("invalid_category", column="o_orderstatus", invalid_value="Z"))
_single("inject_category_number", "customer", 0.05, 1, injector("invalid_category", column="c_nationkey", invalid_value=99))
_single("inject_category_default", "customer", 0.05, 3, injector("invalid_category", column="c_nationkey"))
_single("inject_duplicate", "orders", 0.05, 2, injector("duplicate_row"))
_single("inject_fk", "lineitem_rcv", 0.01, 1, injector("referential_integrity", column="l_orderkey"))
_single("inject_temporal", "lineitem_rcv", 0.05, 1, injector(
    "cross_column_logic", kind="temporal", start_col="l_shipdate", end_col="l_receiptdate"))
_single("inject_sum", "lineitem_sum", 0.05, 2, injector(
    "cross_column_logic", kind="sum", total_col="total", component_cols=["a", "b"]))
_single("inject_shift", "lineitem_rcv", 0.05, 2, injector("distribution_shift", column="l_extendedprice", scale=3.0))


# Two range errors and a missing value on one column: each sees what the earlier ones left.
_MIX = [
    (injector("out_of_range", column="value", mode="high"), 0.02),
    (injector("missing_value", column="value"), 0.03),
    (injector("duplicate_row"), 0.02),
    (injector("out_of_range", column="value", mode="low"), 0.01),
    (injector("type_or_format_error", column="event_type"), 0.02),
    (injector("cross_column_logic", kind="temporal", start_col="start", end_col="end"), 0.02),
]
_MIX_SLICES = sqltext.mixed_slices(_MIX, 5)


def _mix_sql(build, *args) -> str:
    items, select = build("v", _MIX_SLICES, *args)
    return f"WITH {', '.join([sqltext.ranked(SQL['events_trip'], [5, 1005]), *items])} {select}"


@query("inject_mixed", _mix_sql(sqltext.rows, COLUMNS["events_trip"]))
def q_inject_mixed(spark, sf):
    corrupted, _ = inject_mixed(frame(spark, sf, "events_trip"), _MIX, 5, "events_trip")
    return corrupted


@query("labels_mixed", _mix_sql(sqltext.labels, "events_trip"))
def q_labels_mixed(spark, sf):
    _, labels = inject_mixed(frame(spark, sf, "events_trip"), _MIX, 5, "events_trip")
    return label_values(labels)


# Parts of one integer column that need a double, a wider integer and a fraction.
_MIX_TYPES = [
    (injector("distribution_shift", column="c_nationkey", scale=0.5), 0.05),
    (injector("referential_integrity", column="c_nationkey"), 0.05),
    (injector("invalid_category", column="c_nationkey", invalid_value=9.5), 0.05),
]
_TYPES_ITEMS, _TYPES_SELECT = sqltext.rows("v", sqltext.mixed_slices(_MIX_TYPES, 4), COLUMNS["customer"])


@query("inject_mixed_types", f"WITH {', '.join([sqltext.ranked(SQL['customer'], [4]), *_TYPES_ITEMS])} {_TYPES_SELECT}")
def q_inject_mixed_types(spark, sf):
    corrupted, _ = inject_mixed(frame(spark, sf, "customer").select(ROW_ID, *COLUMNS["customer"]), _MIX_TYPES, 4, "customer")
    return corrupted


# A mix in which the sentinel is the default, on an integer column and on a text one.
_MIX_DEFAULT = [
    (injector("invalid_category", column="o_custkey"), 0.04),
    (injector("invalid_category", column="o_orderpriority"), 0.03),
    (injector("out_of_range", column="o_custkey"), 0.02),
    (injector("duplicate_row"), 0.02),
]
_DEFAULT_ITEMS, _DEFAULT_SELECT = sqltext.rows("v", sqltext.mixed_slices(_MIX_DEFAULT, 6), COLUMNS["orders"])


@query("inject_mixed_default", f"WITH {', '.join([sqltext.ranked(SQL['orders'], [6, 1006]), *_DEFAULT_ITEMS])} {_DEFAULT_SELECT}")
def q_inject_mixed_default(spark, sf):
    corrupted, _ = inject_mixed(frame(spark, sf, "orders").select(ROW_ID, *COLUMNS["orders"]), _MIX_DEFAULT, 6, "orders")
    return corrupted


_NAMED = "o_totalprice > 400000"


@query(
    "inject_rows",
    f"WITH b AS ({SQL['orders']}) SELECT * REPLACE (CASE WHEN {_NAMED} THEN -(_row_id + 1) ELSE o_custkey END AS o_custkey) FROM b",
)
def q_inject_rows(spark, sf):
    """A foreign key broken on rows named by another table: the dearest orders."""
    orders = frame(spark, sf, "orders")
    broken = injector("referential_integrity", column="o_custkey")
    customers = frame(spark, sf, "customer").select("c_custkey")
    return inject(orders, broken, 0.0, 1, "orders", rows=orders.filter(_NAMED).select(ROW_ID), valid_keys=customers)[0]


_TEXT_SQL = " UNION ALL ".join(
    f"SELECT _row_id, '{column}' AS \"column\", {text} AS original_value FROM r WHERE r1 <= {sqltext.count_of(0.05)}"
    for column, text in (("o_custkey", "CAST(o_custkey AS VARCHAR)"), ("o_orderdate", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')"))
)


@query("labels_text", f"WITH {sqltext.ranked(SQL['orders'], [1])} {_TEXT_SQL}")
def q_labels_text(spark, sf):
    """Original values as the label has them: an integer and a time under errors that change their column's type."""
    orders = frame(spark, sf, "orders")
    errors = [injector("out_of_range", column="o_custkey", mode="high"), injector("type_or_format_error", column="o_orderdate")]
    parts = [inject(orders, e, 0.05, 1, "orders")[1].select(ROW_ID, "column", "original_value") for e in errors]
    return functools.reduce(DataFrame.unionByName, parts)


def _planned_slices(table: str) -> list[tuple[str, float | None, int, list]]:
    """(error type, rate, seed, slices) of every variant in a table's grid."""
    plan = plan_for(table)
    out = [(i.error_type, rate, seed, sqltext.single_slices(i, rate, seed)) for i in plan for rate in RATES for seed in SEEDS]
    out += [("mixed", None, seed, sqltext.mixed_slices([(i, MIXED_RATE) for i in plan], seed)) for seed in SEEDS]
    return out


def _grid_sql(table: str, build, *args) -> str:
    source = PLANNED[table]
    items, selects = [sqltext.ranked(SQL[source], SEEDS + [s + 1000 for s in SEEDS])], []
    for i, (error, rate, seed, slices) in enumerate(_planned_slices(table)):
        value = "CAST(NULL AS DOUBLE)" if rate is None else f"CAST({rate} AS DOUBLE)"
        extra = f"'{table}' AS table_id, '{error}' AS variant_type, {value} AS variant_rate, {seed} AS variant_seed, "
        more, select = build(f"v{i}", slices, *args, extra=extra)
        items += more
        selects.append(select)
    return f"WITH {', '.join(items)} {' UNION ALL '.join(selects)}"


def planned(spark, sf, table):
    source = PLANNED[table]
    base = frame(spark, sf, source).select(ROW_ID, *COLUMNS[source])
    return injection_grid(base, plan_for(table), RATES, SEEDS, table)


def variant_columns(injection, table) -> list:
    """The identity of a variant as columns, looked up by its number."""
    def pick(values, kind):
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("_variant") + 1)

    vs = injection.variants
    return [
        F.lit(table).alias("table_id"), pick([v.error_type for v in vs], "string").alias("variant_type"),
        pick([v.rate for v in vs], "double").alias("variant_rate"), pick([v.seed for v in vs], "bigint").alias("variant_seed"),
    ]


@query("inject_grid", _grid_sql("tpch_customer", sqltext.rows, COLUMNS["customer"]))
def q_inject_grid(spark, sf):
    """Every variant of a table, from one scan."""
    injection = planned(spark, sf, "tpch_customer")
    return injection.rows().select(*variant_columns(injection, "tpch_customer"), ROW_ID, *COLUMNS["customer"])


@query("labels", _grid_sql("tpch_orders", sqltext.labels, "tpch_orders"))
def q_labels(spark, sf):
    """The labels of every variant of a table."""
    injection = planned(spark, sf, "tpch_orders")
    return label_values(injection.labels().select(*variant_columns(injection, "tpch_orders"), "*")).drop("_variant")


@query("labels_all", " UNION ALL ".join(f"SELECT * FROM ({_grid_sql(t, sqltext.labels, t)})" for t in PLANNED))
def q_labels_all(spark, sf):
    """The labels of every variant of every planned table."""
    parts = []
    for table in PLANNED:
        injection = planned(spark, sf, table)
        parts.append(label_values(injection.labels().select(*variant_columns(injection, table), "*")).drop("_variant"))
    return functools.reduce(DataFrame.unionByName, parts)


def _plan_rows(table: str) -> str:
    n = f"(SELECT count(*) FROM ({SQL[PLANNED[table]]}))"
    rows = []
    for i, inj in enumerate(plan_for(table)):
        column = f"'{inj.column}'" if inj.column else "NULL"
        for rate in RATES:
            k = f"CAST(round_even({n} * CAST({rate} AS DOUBLE), 0) AS BIGINT)"
            rows.append(
                f"SELECT '{table}' AS table_id, {i} AS plan_index, '{inj.error_type}' AS error_type, {column} AS \"column\", "
                f"CAST({rate} AS DOUBLE) AS rate, {n} AS n_rows, {k} AS n_to_corrupt"
            )
    return " UNION ALL ".join(rows)


@query("injection_plan", " UNION ALL ".join(_plan_rows(t) for t in PLANNED))
def q_injection_plan(spark, sf):
    """What would be corrupted, and how much of it, per table."""
    parts = []
    for table, source in PLANNED.items():
        n = frame(spark, sf, source).count()
        rows = [
            (table, i, inj.error_type, inj.column, rate, n, half_even(n * rate))
            for i, inj in enumerate(plan_for(table)) for rate in RATES
        ]
        parts.append(spark.createDataFrame(
            rows, "table_id string, plan_index int, error_type string, column string, rate double, n_rows bigint, n_to_corrupt bigint"
        ))
    return functools.reduce(DataFrame.unionByName, parts)


def _manifest_rows(table: str) -> str:
    n = f"(SELECT count(*) FROM ({SQL[PLANNED[table]]}))"
    rows = []
    for error, rate, seed, slices in _planned_slices(table):
        value = "CAST(NULL AS DOUBLE)" if rate is None else f"CAST({rate} AS DOUBLE)"
        k = " + ".join(f"CAST(round_even({n} * CAST({s.rate} AS DOUBLE), 0) AS BIGINT)" for s in slices)
        rows.append(
            f"SELECT '{table}' AS table_id, '{error}' AS error_type, {value} AS rate, {seed} AS seed, {k} AS n_labels"
        )
    return " UNION ALL ".join(rows)


@query("manifest", " UNION ALL ".join(_manifest_rows(t) for t in ("tpch_customer", "events_trip")))
def q_manifest(spark, sf):
    """The catalogue of variants written as JSON lines and read back, with the labels of each."""
    parts = []
    for table in ("tpch_customer", "events_trip"):
        injection = planned(spark, sf, table)
        labelled = injection.labels().groupBy("_variant").agg(F.count("*").alias("n_labels"))
        parts.append(labelled.select(*variant_columns(injection, table), "n_labels"))
    lines = functools.reduce(DataFrame.unionByName, parts).withColumnsRenamed(
        {"variant_type": "error_type", "variant_rate": "rate", "variant_seed": "seed"}
    )
    root = fresh_path(spark, "variants")
    write_manifest(manifest_of(lines.drop("n_labels"), root), f"{root}/manifest")
    read = scan_manifest(spark, f"{root}/manifest").select("table_id", "error_type", "rate", "seed")
    same = (
        (F.col("m.table_id") == F.col("l.table_id")) & (F.col("m.error_type") == F.col("l.error_type"))
        & F.col("m.rate").eqNullSafe(F.col("l.rate")) & (F.col("m.seed") == F.col("l.seed"))
    )
    return read.alias("m").join(lines.alias("l"), same).select("m.*", "l.n_labels")


_MISSING = injector("missing_value", column="o_orderstatus")


@query(
    "labels_in_sample",
    f"WITH {sqltext.ranked(SQL['orders'], [1, 9])} SELECT _row_id FROM r WHERE r9 <= 3000 "
    f"AND r1 <= {sqltext.count_of(0.05)}",
)
def q_labels_in_sample(spark, sf):
    orders = frame(spark, sf, "orders")
    _, labels = inject(orders, _MISSING, 0.05, 1, "orders")
    return labels_in(labels, select_rows(orders, 3000, 9)).select(ROW_ID)
