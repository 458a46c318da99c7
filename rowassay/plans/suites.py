"""Hand-written rule suites for the documented tables."""

from __future__ import annotations

from rowassay.operators.rules import Rule, build_rules


def _not_null(column):
    return "expect_column_values_to_not_be_null", {"column": column}


def _unique(column):
    return "expect_column_values_to_be_unique", {"column": column}


def _between(column, low, high):
    return "expect_column_values_to_be_between", {"column": column, "min_value": low, "max_value": high}


def _in_set(column, *values):
    return "expect_column_values_to_be_in_set", {"column": column, "value_set": list(values)}


def _after(later, earlier, or_equal):
    return "expect_column_pair_values_a_to_be_greater_than_b", {
        "column_A": later, "column_B": earlier, "or_equal": or_equal,
    }


def _compound(*columns):
    return "expect_compound_columns_to_be_unique", {"column_list": list(columns)}


# The hand-written suites, by table.
_SUITES = {
    "nyc_taxi": [
        _not_null("tpep_pickup_datetime"),
        _not_null("tpep_dropoff_datetime"),
        _after("tpep_dropoff_datetime", "tpep_pickup_datetime", False),
        _between("passenger_count", 1, 8),
        _between("trip_distance", 0, 200),
        _between("fare_amount", 0, 100000),
        _between("total_amount", 0, 100000),
        _between("tip_amount", 0, 100000),
        _in_set("RatecodeID", 1, 2, 3, 4, 5, 6),
        _in_set("payment_type", 1, 2, 3, 4, 5, 6),
        _in_set("store_and_fwd_flag", "Y", "N"),
        _in_set("VendorID", 1, 2),
    ],
    "tpch_customer": [
        _not_null("c_custkey"),
        _unique("c_custkey"),
        _between("c_nationkey", 0, 24),
        _in_set("c_mktsegment", "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
        _not_null("c_name"),
    ],
    "tpch_orders": [
        _not_null("o_orderkey"),
        _unique("o_orderkey"),
        _not_null("o_custkey"),
        _in_set("o_orderstatus", "O", "F", "P"),
        _between("o_totalprice", 0, 100000000),
        _in_set("o_orderpriority", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
    ],
    "tpch_lineitem": [
        _not_null("l_orderkey"),
        _compound("l_orderkey", "l_linenumber"),
        _between("l_quantity", 1, 50),
        _between("l_discount", 0.0, 0.1),
        _between("l_tax", 0.0, 0.08),
        _between("l_extendedprice", 0, 100000000),
        _in_set("l_returnflag", "R", "A", "N"),
        _in_set("l_linestatus", "O", "F"),
        _after("l_receiptdate", "l_shipdate", True),
    ],
}

# A trip-like suite for the events table with derived start and end times.
_SUITES["events_trip"] = [
    _not_null("start"),
    _not_null("end"),
    _after("end", "start", False),
    _between("value", 0, 100000),
    _in_set("event_type", "click", "error", "purchase", "signup", "view"),
    _between("user_id", 0, 100000000),
]


def has_suite(table: str) -> bool:
    return table in _SUITES


def hand_written(table: str) -> list[Rule]:
    """The suite of a table; an unknown table is an error."""
    if table not in _SUITES:
        raise FileNotFoundError(f"no hand-written suite for {table!r}")
    return build_rules([{"expectation_type": t, "kwargs": k, "rationale": "hand-written"} for t, k in _SUITES[table]])
