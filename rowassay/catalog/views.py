"""The given tables as the queries use them, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowassay.functions.ids import add_row_ids
from rowassay.sources.scan import scan_table

LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
_ORDER = {
    "customer": ["c_custkey"], "orders": ["o_orderkey"], "events": ["event_id"], "lineitem": LINEITEM,
    "documents": ["doc_id"], "conversations": ["conv_id", "turn"], "labels": ["doc_id"],
}
_ready: dict[tuple[str, str, str], DataFrame] = {}


def raw(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return scan_table(spark, f"{sf}/{table}.parquet")


def numbered(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A table with row ids, written once per application: everything downstream reads this."""
    key = (spark.sparkContext.applicationId, sf, table)
    if key not in _ready:
        # add_row_ids has written it: the ids are a projection of what is read, without a join.
        _ready[key] = add_row_ids(raw(spark, sf, table), _ORDER[table])
    return _ready[key]


def lineitem_rcv(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a receipt date: ``l_linenumber`` days after shipping."""
    days = F.make_dt_interval(F.col("l_linenumber"))
    return numbered(spark, sf, "lineitem").withColumn("l_receiptdate", F.col("l_shipdate") + days)


def lineitem_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a total and its two components."""
    return numbered(spark, sf, "lineitem").withColumns(
        {"a": F.col("l_extendedprice"), "b": F.col("l_quantity"), "total": F.col("l_extendedprice") + F.col("l_quantity")}
    )


def trip_columns(events: DataFrame) -> DataFrame:
    minutes = (F.lit(1) + F.col("event_id") % 120).cast("int")
    return events.withColumns({
        "start": F.col("ts"), "end": F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), minutes),
    })


def events_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Events as trips: 1 to 120 minutes long."""
    return trip_columns(numbered(spark, sf, "events"))


# The same views in SQL. ``base("orders")`` is a WITH item named b.
SQL = {
    "customer": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _row_id, * FROM customer",
    "orders": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _row_id, * FROM orders",
    "events": "SELECT row_number() OVER (ORDER BY event_id) - 1 AS _row_id, * FROM events",
    "lineitem": f"SELECT row_number() OVER (ORDER BY {', '.join(LINEITEM)}) - 1 AS _row_id, * FROM lineitem",
    "documents": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS _row_id, * FROM documents",
    "conversations": "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS _row_id, * FROM conversations",
}
SQL["lineitem_rcv"] = f"SELECT *, l_shipdate + to_days(l_linenumber) AS l_receiptdate FROM ({SQL['lineitem']})"
SQL["lineitem_sum"] = (
    f"SELECT *, l_extendedprice AS a, l_quantity AS b, l_extendedprice + l_quantity AS total FROM ({SQL['lineitem']})"
)
SQL["events_trip"] = (
    'SELECT *, ts AS "start", ts + to_minutes(1 + event_id % 120) AS "end" '
    f"FROM ({SQL['events']})"
)


def frame(spark: SparkSession, sf: str, view: str) -> DataFrame:
    derived = {"lineitem_rcv": lineitem_rcv, "lineitem_sum": lineitem_sum, "events_trip": events_trip}
    return derived[view](spark, sf) if view in derived else numbered(spark, sf, view)
