"""Queries: scans, cleaning, joins, ids, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowassay import ROW_ID
from rowassay.catalog.registry import ORACLE, query
from rowassay.catalog.views import LINEITEM, SQL, events_trip, numbered, raw, trip_columns
from rowassay.functions.ids import add_row_ids
from rowassay.functions.select import Selection, cap_rows, half_even, preview_rows, select_rows
from rowassay.operators.clean import (
    Check, clean_audit, clean_rows, clean_star, dedup_first, fk_orphans, fk_semi, hours_between,
)
from rowassay.operators.parse import answered_requests, open_requests, request_key
from rowassay.plans.prepare import STAR_FOREIGN, STAR_PRIMARY, prepare_single, prepare_star
from rowassay.session import fresh_path
from rowassay.sources.scan import normalize_types, scan_table, scan_tables
from rowassay.sources.sinks import write_audit, write_clean

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

# -- scans ---------------------------------------------------------------------------------------


@query("scan_table", "SELECT * FROM orders")
def q_scan_table(spark, sf):
    return scan_table(spark, f"{sf}/orders.parquet")


@query("scan_tables", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def q_scan_tables(spark, sf):
    tables = scan_tables(spark, {t: f"{sf}/{t}.parquet" for t in TABLES})
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(
    "normalize_types",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS DOUBLE) AS price, "
    "CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS shipped FROM lineitem"
)
def q_normalize_types(spark, sf):
    stored = raw(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_extendedprice").cast("decimal(14,2)").alias("price"), F.col("l_shipdate").cast("date").alias("shipped"),
    )
    return normalize_types(stored)


# -- cleaning ------------------------------------------------------------------------------------


def trip_checks() -> list[Check]:
    """The trip chain with limits that remove something from the events."""
    hours = hours_between(F.col("start"), F.col("end"))
    return [
        Check("valid_timestamps", "end after start", F.col("end") > F.col("start"), "end > start"),
        Check("duration", "at most 90 minutes", (hours > 0) & (hours <= 1.5), "0 < hours <= 1.5"),
        Check("value_range", "value up to 300", F.col("value").between(0, 300), "0 <= value <= 300"),
        Check("known_type", "documented event types",
              F.col("event_type").isin("click", "view", "purchase", "signup"), "event_type in set"),
        Check("real_user", "no test users", F.col("user_id") >= 5, "user_id >= 5"),
    ]


_KEPT = [
    '"end" > "start"',
    '"end" - "start" > INTERVAL 0 MINUTE AND "end" - "start" <= INTERVAL 90 MINUTE',
    "value >= 0 AND value <= 300",
    "event_type IN ('click', 'view', 'purchase', 'signup')",
    "user_id >= 5",
]
_TRIP = f"b AS ({SQL['events_trip']})"
_ALL_KEPT = " AND ".join(f"({k})" for k in _KEPT)
_FAILED = "CASE " + " ".join(f"WHEN NOT coalesce({k}, false) THEN {i}" for i, k in enumerate(_KEPT)) + " ELSE 99 END"
_AUDIT_STEPS = ["valid_timestamps", "duration", "value_range", "known_type", "real_user"]


@query("clean_rows", f"WITH {_TRIP} SELECT event_id, user_id, event_type, value, \"start\", \"end\" FROM b WHERE {_ALL_KEPT}")
def q_clean_rows(spark, sf):
    trips = trip_columns(raw(spark, sf, "events"))
    return clean_rows(trips, trip_checks()).select("event_id", "user_id", "event_type", "value", "start", "end")


@query(
    "clean_audit",
    f"WITH {_TRIP}, f AS (SELECT {_FAILED} AS stop FROM b) "
    + " UNION ALL ".join(
        f"SELECT 'events' AS dataset, {i} AS step, '{n}' AS name, count(*) FILTER (stop >= {i}) AS rows_before, "
        f"count(*) FILTER (stop > {i}) AS rows_after, count(*) FILTER (stop = {i}) AS rows_removed FROM f"
        for i, n in enumerate(_AUDIT_STEPS)
    )
)
def q_clean_audit(spark, sf):
    trips = trip_columns(raw(spark, sf, "events"))
    return clean_audit(trips, trip_checks(), "events").drop("description", "rule")


@query("clean_written", ORACLE["clean_rows"])
def q_clean_written(spark, sf):
    """The cleaned table through its sink."""
    path = fresh_path(spark, "clean")
    write_clean(q_clean_rows(spark, sf), path)
    return scan_table(spark, path)


@query("audit_written", ORACLE["clean_audit"])
def q_audit_written(spark, sf):
    """The cleaning trail through its sink."""
    path = fresh_path(spark, "audit")
    audit = q_clean_audit(spark, sf)
    write_audit(audit, path)
    return spark.read.schema(audit.schema).json(path)


@query(
    "duration_filter",
    f"WITH {_TRIP} SELECT event_id, epoch_us(\"end\") - epoch_us(\"start\") AS micros FROM b "
    'WHERE "end" - "start" > INTERVAL 30 MINUTE AND "end" - "start" <= INTERVAL 60 MINUTE'
)
def q_duration_filter(spark, sf):
    trips = trip_columns(raw(spark, sf, "events"))
    hours = hours_between(F.col("start"), F.col("end"))
    micros = F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
    return trips.filter((hours > 0.5) & (hours <= 1.0)).select("event_id", micros.alias("micros"))


_LINES = f"b AS ({SQL['lineitem']})"


@query(
    "dedup_first",
    f"WITH {_LINES} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
    "ORDER BY _row_id) AS rn FROM b) WHERE rn = 1"
)
def q_dedup_first(spark, sf):
    return dedup_first(numbered(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# A star with repeated order keys and dangling references, made from the given tables.
def _star(spark, sf):
    orders = numbered(spark, sf, "orders")
    key = F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey") - F.col("o_orderkey") % 2)
    return {
        "orders": orders.withColumn("o_orderkey", key.otherwise(F.col("o_orderkey"))),
        "customer": numbered(spark, sf, "customer").filter("c_acctbal >= 0"),
        "lineitem": numbered(spark, sf, "lineitem"),
    }


_STAR = (
    f"o AS (SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN o_orderkey - o_orderkey % 2 ELSE o_orderkey END "
    f"AS o_orderkey) FROM ({SQL['orders']})), "
    f"c AS (SELECT * FROM ({SQL['customer']}) WHERE c_acctbal >= 0), {_LINES}, "
    "o1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY _row_id) AS rn "
    "FROM o) WHERE rn = 1), "
    "l1 AS (SELECT * FROM b WHERE l_orderkey IN (SELECT o_orderkey FROM o1)), "
    "o2 AS (SELECT * FROM o1 WHERE o_custkey IN (SELECT c_custkey FROM c))"
)


@query(
    "clean_star",
    f"WITH {_STAR}, a AS ("
    "SELECT 0 AS step, 'orders_pk_unique' AS name, (SELECT count(*) FROM o) AS rows_before, (SELECT count(*) FROM o1) AS rows_after "
    "UNION ALL SELECT 1, 'customer_pk_unique', (SELECT count(*) FROM c), (SELECT count(*) FROM c) "
    "UNION ALL SELECT 2, 'lineitem_fk_orders', (SELECT count(*) FROM b), (SELECT count(*) FROM l1) "
    "UNION ALL SELECT 3, 'orders_fk_customer', (SELECT count(*) FROM o1), (SELECT count(*) FROM o2)) "
    "SELECT 'star' AS dataset, step, name, rows_before, rows_after, rows_before - rows_after AS rows_removed FROM a"
)
def q_clean_star(spark, sf):
    _, audit = clean_star(_star(spark, sf), STAR_PRIMARY, STAR_FOREIGN, "star")
    return audit.drop("description", "rule")


@query("clean_star_lineitem", f"WITH {_STAR} SELECT _row_id, l_orderkey, l_linenumber, l_extendedprice FROM l1")
def q_clean_star_lineitem(spark, sf):
    out, _ = clean_star(_star(spark, sf), STAR_PRIMARY, STAR_FOREIGN, "star")
    return out["lineitem"].select(ROW_ID, "l_orderkey", "l_linenumber", "l_extendedprice")


# -- joins ---------------------------------------------------------------------------------------


@query("fk_semi", "SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 250000)")
def q_fk_semi(spark, sf):
    return fk_semi(raw(spark, sf, "lineitem"), "l_orderkey", raw(spark, sf, "orders").filter("o_totalprice > 250000"), "o_orderkey")


@query("fk_orphans", "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def q_fk_orphans(spark, sf):
    parents = raw(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'")
    return fk_orphans(raw(spark, sf, "orders"), "o_custkey", parents, "c_custkey")


_REQUEST = (
    "sha256(to_json({'model': role, 'params': '{\"temperature\":0}', 'prompt': text, 'salt': CAST(turn % 2 AS VARCHAR)}))"
)


@query(
    "open_requests",
    f"WITH r AS (SELECT conv_id, turn, {_REQUEST} AS request_key, text FROM conversations) "
    "SELECT conv_id, turn, request_key FROM r WHERE request_key NOT IN "
    "(SELECT request_key FROM r WHERE length(text) < 400)"
)
def q_open_requests(spark, sf):
    """Requests (all turns) against stored answers (the short ones)."""
    params, salt = F.lit('{"temperature":0}'), (F.col("turn") % 2).cast("string")
    requests = raw(spark, sf, "conversations").withColumn(
        "request_key", request_key(F.col("role"), F.col("text"), params, salt)
    )
    answers = requests.filter(F.char_length("text") < 400)
    return open_requests(requests, answers).select("conv_id", "turn", "request_key")


_SORTED = '{"stop":{"a":[2],"b":1},"temperature":0,"top_p":1}'
_SHUFFLED = ['{"top_p": 1, "temperature": 0, "stop": {"b": 1, "a": [2]}}', '{"temperature":0,"stop":{"a":[2],"b":1},"top_p":1}']
_ANY_ORDER = f"sha256(to_json({{'model': role, 'params': '{_SORTED}', 'prompt': text, 'salt': ''}}))"


@query(
    "answered_requests",
    f"WITH r AS (SELECT conv_id, turn, {_ANY_ORDER} AS request_key, length(text) AS answer FROM conversations), "
    "a AS (SELECT request_key, min(answer) AS answer FROM r GROUP BY request_key) SELECT conv_id, turn, request_key, a.answer FROM r JOIN a USING (request_key)",
)
def q_answered_requests(spark, sf):
    """Requests whose parameters list their keys in another order than those of the stored answers."""
    turns = raw(spark, sf, "conversations")
    keyed = [turns.withColumn("request_key", request_key(F.col("role"), F.col("text"), F.lit(p), F.lit(""))) for p in _SHUFFLED]
    answers = keyed[1].groupBy("request_key").agg(F.min(F.char_length("text").cast("bigint")).alias("answer"))
    return answered_requests(keyed[0], answers).select("conv_id", "turn", "request_key", "answer")


# -- ids and sampling ------------------------------------------------------------------------------


@query("row_ids", SQL["lineitem"])
def q_row_ids(spark, sf):
    return add_row_ids(raw(spark, sf, "lineitem"), LINEITEM)


@query("row_ids_documents", SQL["documents"])
def q_row_ids_documents(spark, sf):
    return add_row_ids(raw(spark, sf, "documents"), ["doc_id"])


def _first(view: str, seed: int, n: str) -> str:
    return f"SELECT * FROM ({SQL[view]}) ORDER BY md5('{seed}:' || _row_id), _row_id LIMIT {n}"


@query("sample_exact", _first("lineitem", 7, "1000"))
def q_sample_exact(spark, sf):
    return select_rows(numbered(spark, sf, "lineitem"), 1000, 7)


@query("subsample_cap", _first("orders", 3, "5000"))
def q_subsample_cap(spark, sf):
    return cap_rows(numbered(spark, sf, "orders"), 5000, 3)


@query("sample_preview", f"SELECT * EXCLUDE (_row_id) FROM ({_first('customer', 11, '20')})")
def q_sample_preview(spark, sf):
    return preview_rows(numbered(spark, sf, "customer"), 20, 11)


@query(
    "select_k",
    f"SELECT _row_id, o_orderkey FROM ({SQL['orders']}) ORDER BY md5('1:' || _row_id), _row_id "
    "LIMIT (SELECT CAST(round_even(count(*) * 0.05, 0) AS BIGINT) FROM orders)"
)
def q_select_k(spark, sf):
    orders = numbered(spark, sf, "orders")
    selection = Selection(orders, [1])
    k = half_even(selection.n * 0.05)
    return orders.filter(selection.cuts([(1, k)])[1, k].covers()).select(ROW_ID, "o_orderkey")


@query(
    "prepare_single",
    f"WITH {_TRIP}, k AS (SELECT * FROM b WHERE {_ALL_KEPT}), "
    "s AS (SELECT * FROM k ORDER BY md5('42:' || _row_id), _row_id LIMIT 2000) "
    'SELECT row_number() OVER (ORDER BY event_id) - 1 AS _row_id, event_id, user_id, value, "start", "end" FROM s'
)
def q_prepare_single(spark, sf):
    trips = events_trip(spark, sf).select(ROW_ID, "event_id", "user_id", "event_type", "value", "start", "end")
    prepared, _ = prepare_single(trips, trip_checks(), 2000, 42, "events")
    return prepared.drop("event_type")


@query(
    "prepare_star",
    f"WITH {_STAR}, s AS (SELECT * FROM l1 ORDER BY md5('42:' || _row_id), _row_id LIMIT 20000) "
    f"SELECT * REPLACE (row_number() OVER (ORDER BY {', '.join(LINEITEM)}) - 1 AS _row_id) FROM s"
)
def q_prepare_star(spark, sf):
    out, _ = prepare_star(_star(spark, sf), {"lineitem": 20000}, 42, {"lineitem": LINEITEM}, dataset="star")
    return out["lineitem"]

