"""From raw tables to clean, capped, numbered ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowassay import ROW_ID
from rowassay.functions.ids import add_row_ids
from rowassay.functions.select import cap_rows
from rowassay.operators.clean import Check, clean_audit, clean_rows, clean_star, hours_between
from rowassay.session import materialize


def taxi_checks() -> list[Check]:
    """The cleaning chain of the trip table, in order."""
    c = F.col
    hours = hours_between(c("tpep_pickup_datetime"), c("tpep_dropoff_datetime"))
    # Step names, limits and code sets.
    return [
        Check("valid_timestamps", "both times present, dropoff after pickup",
              c("tpep_dropoff_datetime") > c("tpep_pickup_datetime"), "dropoff > pickup"),
        Check("duration_under_24h", "at most a day long", (hours > 0) & (hours <= 24), "0 < hours <= 24"),
        Check("passenger_count_valid", "one to eight passengers",
              c("passenger_count").between(1, 8), "passenger_count in [1, 8]"),
        Check("trip_distance_valid", "zero to 200 miles",
              c("trip_distance").between(0, 200), "trip_distance in [0, 200]"),
        Check("fare_non_negative", "no negative amounts",
              (c("fare_amount") >= 0) & (c("total_amount") >= 0), "fare_amount >= 0 and total_amount >= 0"),
        Check("ratecode_valid", "documented rate codes", c("RatecodeID").isin(1, 2, 3, 4, 5, 6), "RatecodeID in 1..6"),
        Check("payment_type_valid", "documented payment types",
              c("payment_type").isin(1, 2, 3, 4, 5, 6), "payment_type in 1..6"),
    ]


# Keys of the star schema.
STAR_PRIMARY = [("orders", "o_orderkey"), ("customer", "c_custkey")]
STAR_FOREIGN = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
]


def prepare_single(
    numbered: DataFrame, checks: list[Check], n: int, seed: int, dataset: str = ""
) -> tuple[DataFrame, DataFrame]:
    """(clean, sampled and freshly numbered table, audit) from a raw table that carries row ids."""
    kept = cap_rows(clean_rows(numbered, checks), n, seed)
    written = materialize(kept, "kept")
    return add_row_ids(written.drop(ROW_ID), None), clean_audit(numbered, checks, dataset)


def prepare_star(
    numbered: dict[str, DataFrame], caps: dict[str, int], seed: int, order: dict[str, list[str]],
    primary=STAR_PRIMARY, foreign=STAR_FOREIGN, dataset: str = "",
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The same for a star of tables; capping a child keeps its keys inside the parent."""
    cleaned, audit = clean_star(numbered, primary, foreign, dataset)
    out = {}
    for name, table in cleaned.items():
        written = materialize(cap_rows(table, caps.get(name), seed), name)
        out[name] = add_row_ids(written.drop(ROW_ID), order.get(name))
    return out, audit
