from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rowassay.operators.clean import clean_audit, clean_rows, clean_star, dedup_first, fk_orphans, fk_semi
from rowassay.plans.prepare import STAR_FOREIGN, STAR_PRIMARY, prepare_single, prepare_star, taxi_checks
from rowassay.sources.scan import normalize_types, scan_manifest, scan_results, scan_table, type_changes
from rowassay.sources.sinks import write_audit, write_clean

TRIP = (
    "_row_id bigint, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, passenger_count bigint, "
    "trip_distance double, fare_amount double, total_amount double, RatecodeID bigint, payment_type bigint"
)


@pytest.fixture(scope="module")
def trips(spark):
    start = datetime(2024, 1, 1, 10)
    good = [start, start + timedelta(minutes=30), 2, 3.0, 12.0, 15.0, 1, 1]
    rows = [list(good) for _ in range(3)]
    for at, value in ((1, start - timedelta(hours=1)), (2, 0), (3, -1.0), (4, -5.0), (6, 99), (7, 0)):
        bad = list(good)
        bad[at] = value
        rows.append(bad)
    return spark.createDataFrame([tuple([i, *r]) for i, r in enumerate(rows)], TRIP)


def test_each_check_removes_its_violation(trips):
    kept = clean_rows(trips, taxi_checks())
    assert {r["_row_id"] for r in kept.collect()} == {0, 1, 2}
    audit = clean_audit(trips, taxi_checks(), "taxi").orderBy("step").collect()
    assert sum(r["rows_removed"] for r in audit) == 6
    assert [r["rows_removed"] for r in audit] == [1, 0, 1, 1, 1, 1, 1]
    assert audit[0]["rows_before"] == 9 and audit[-1]["rows_after"] == 3
    assert all(a["rows_after"] == b["rows_before"] for a, b in zip(audit, audit[1:]))


def test_missing_values_fail_checks(trips):
    gaps = trips.withColumn("passenger_count", F.when(F.col("_row_id") > 0, F.col("passenger_count")))
    assert {r["_row_id"] for r in clean_rows(gaps, taxi_checks()).collect()} == {1, 2}


def test_prepare_single_samples_and_numbers(trips, spark, tmp_path):
    table, audit = prepare_single(trips, taxi_checks(), 2, 42, "taxi")
    assert sorted(r["_row_id"] for r in table.collect()) == [0, 1] and table.columns[0] == "_row_id"
    write_clean(table, str(tmp_path / "clean"))
    write_audit(audit, str(tmp_path / "audit"))
    assert scan_table(spark, str(tmp_path / "clean")).count() == 2
    assert spark.read.json(str(tmp_path / "audit")).count() == 7


@pytest.fixture(scope="module")
def star(spark):
    return {
        "customer": spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "_row_id bigint, c_custkey bigint"),
        "orders": spark.createDataFrame([(0, 10, 1), (1, 11, 2), (2, 12, 3), (3, 12, 3)], "_row_id bigint, o_orderkey bigint, o_custkey bigint"),
        "lineitem": spark.createDataFrame([(0, 10, 1), (1, 11, 1), (2, 999, 1)], "_row_id bigint, l_orderkey bigint, l_linenumber int"),
    }


def test_star_loses_repeated_keys_and_orphans(star):
    out, audit = clean_star(star, STAR_PRIMARY, STAR_FOREIGN, "star")
    assert [r[0] for r in out["orders"].orderBy("_row_id").select("_row_id").collect()] == [0, 1, 2]
    assert out["lineitem"].count() == 2
    assert {r["name"]: r["rows_removed"] for r in audit.collect()} == {
        "orders_pk_unique": 1, "customer_pk_unique": 0, "lineitem_fk_orders": 1, "orders_fk_customer": 0,
    }


def test_star_steps_do_not_cascade(star, spark):
    """A line of an order that itself is an orphan stays."""
    tables = {**star, "customer": star["customer"].filter("c_custkey != 1")}
    out, _ = clean_star(tables, STAR_PRIMARY, STAR_FOREIGN)
    assert out["lineitem"].filter("l_orderkey = 10").count() == 1
    assert out["orders"].filter("o_orderkey = 10").count() == 0


def test_prepare_star_caps_children_inside_parents(star):
    out, _ = prepare_star(star, {"lineitem": 1}, 42, {})
    assert out["lineitem"].count() == 1 and out["lineitem"].first()["_row_id"] == 0
    assert out["lineitem"].join(out["orders"], F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").count() == 0


def test_dedup_keeps_the_first_also_for_missing_and_hot_keys(spark):
    df = spark.range(9000).selectExpr("id AS _row_id", "if(id % 3 = 0, NULL, if(id % 3 = 1, -1, id)) AS k")
    kept = dedup_first(df, ["k"])
    assert kept.count() == 3000 + 2
    assert {r[0] for r in kept.filter("k IS NULL OR k = -1").select("_row_id").collect()} == {0, 1}


def test_foreign_keys_split_the_child(spark):
    child = spark.createDataFrame([(1, 10), (2, 99), (3, None)], "id int, k int")
    parent = spark.createDataFrame([(10,), (10,), (None,)], "p int")
    assert [r["id"] for r in fk_semi(child, "k", parent, "p").collect()] == [1]
    assert sorted(r["id"] for r in fk_orphans(child, "k", parent, "p").collect()) == [2, 3]


def test_types_are_normalized(spark):
    df = spark.sql("SELECT CAST(1.50 AS DECIMAL(6,2)) AS d, DATE'2024-01-02' AS t, CAST('NaN' AS DOUBLE) AS x, 1 AS i")
    row = normalize_types(df).first()
    assert row["d"] == 1.5 and row["t"] == datetime(2024, 1, 2) and row["x"] is None and row["i"] == 1
    assert type_changes(df) == [("d", "decimal(6,2)", "double"), ("t", "date", "timestamp_ntz")]


def test_missing_inputs(spark, tmp_path):
    assert scan_manifest(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_results(spark, str(tmp_path / "none"))
