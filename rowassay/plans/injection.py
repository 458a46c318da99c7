"""What to corrupt in which table. How much comes from the rates and seeds of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rowassay.operators.inject import Injection, Injector, Selection, injector, mixed, order_seeds, single

# Target columns per table, and the rate of each part of a mix.
MIXED_RATE = 0.02
_PLANS: dict[str, list[Injector]] = {
    "nyc_taxi": [
        injector("missing_value", column="passenger_count"),
        injector("out_of_range", column="trip_distance", mode="high"),
        injector("type_or_format_error", column="store_and_fwd_flag"),
        injector("invalid_category", column="RatecodeID", invalid_value=99),
        injector("duplicate_row"),
        injector("cross_column_logic", kind="temporal", start_col="tpep_pickup_datetime", end_col="tpep_dropoff_datetime"),
        injector("distribution_shift", column="fare_amount", scale=3.0),
    ],
    "tpch_customer": [
        injector("missing_value", column="c_name"),
        injector("out_of_range", column="c_acctbal", mode="high"),
        injector("invalid_category", column="c_mktsegment", invalid_value="ZZZ"),
        injector("duplicate_row"),
        injector("distribution_shift", column="c_acctbal", scale=3.0),
    ],
    "tpch_orders": [
        injector("referential_integrity", column="o_custkey"),
        injector("missing_value", column="o_orderstatus"),
        injector("invalid_category", column="o_orderstatus", invalid_value="Z"),
        injector("out_of_range", column="o_totalprice", mode="high"),
        injector("duplicate_row"),
        injector("distribution_shift", column="o_totalprice", scale=3.0),
    ],
    "tpch_lineitem": [
        injector("referential_integrity", column="l_orderkey"),
        injector("out_of_range", column="l_quantity", mode="high"),
        injector("invalid_category", column="l_returnflag", invalid_value="Z"),
        injector("cross_column_logic", kind="temporal", start_col="l_shipdate", end_col="l_receiptdate"),
        injector("duplicate_row"),
        injector("distribution_shift", column="l_extendedprice", scale=3.0),
    ],
    # Stands for the trip table where only events are at hand.
    "events_trip": [
        injector("missing_value", column="value"),
        injector("out_of_range", column="value", mode="high"),
        injector("type_or_format_error", column="event_type"),
        injector("invalid_category", column="user_id", invalid_value=-99),
        injector("duplicate_row"),
        injector("cross_column_logic", kind="temporal", start_col="start", end_col="end"),
        injector("distribution_shift", column="value", scale=3.0),
    ],
}


def plan_for(table: str) -> list[Injector]:
    if table not in _PLANS:
        raise KeyError(f"no injection plan for {table!r}")
    return _PLANS[table]


def injection_grid(
    base: DataFrame, plan: list[Injector], rates: list[float], seeds: list[int], dataset: str = "",
    mixed_rate: float = MIXED_RATE,
) -> Injection:
    """Every injector at every rate and seed, and one mix per seed, over one table."""
    selection = Selection(base, order_seeds(seeds))
    n = selection.n
    variants = [single(inj, rate, seed, n) for inj in plan for rate in rates for seed in seeds]
    variants += [mixed([(inj, mixed_rate) for inj in plan], seed, n) for seed in seeds]
    return Injection(base, variants, dataset, selection)
