from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from rowassay import ROW_ID
from rowassay.functions import ids, select
from rowassay.functions.select import Selection, cap_rows, half_even, preview_rows, select_rows


def test_ids_are_dense_first_and_follow_the_order(spark):
    df = spark.createDataFrame([(x * 37 % 101,) for x in range(101)], "x int").repartition(7)
    out = ids.add_row_ids(df)
    assert out.columns[0] == ROW_ID
    assert [(r[0], r[1]) for r in out.orderBy(ROW_ID).collect()] == [(i, i) for i in range(101)]


def test_copies_of_one_row_spread_over_partitions(spark):
    """A third of all rows identical: they still get distinct, dense ids, from several tasks."""
    df = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("x"), F.rpad(F.lit("v"), 60, "-").alias("pad"))
    out = ids.add_row_ids(df)
    got = out.agg(F.min(ROW_ID), F.max(ROW_ID), F.count_distinct(ROW_ID)).first()
    assert tuple(got) == (0, 89_999, 90_000)
    assert out.filter("x = -1").agg(F.max(ROW_ID)).first()[0] == 29_999
    spread = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(8, "x", "pad", "_tie")
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 90_000 / 8


def test_ids_are_a_projection_of_one_written_table(spark, capsys):
    """Reading a numbered table shuffles nothing, however large it is; empty partitions and empty tables are fine."""
    df = spark.range(1000).select((F.col("id") % 7).alias("x")).repartition(9)
    out = ids.add_row_ids(df)
    out.explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan
    assert [r[0] for r in out.orderBy("x", ROW_ID).collect()] == list(range(1000))
    assert ids.add_row_ids(df.filter("x > 7")).collect() == []


def _brute(n, seed, k):
    order = sorted(range(n), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    return set(order[:k])


@pytest.mark.parametrize("tail", [10_000, 3, 1])
def test_selection_is_exact_however_buckets_are_divided(spark, monkeypatch, tail):
    """Small tails force the boundary buckets to be divided several times."""
    monkeypatch.setattr(select, "_MAX_TAIL", tail)
    monkeypatch.setattr(select, "_FIRST_DIGITS", 1)
    monkeypatch.setattr(select, "_MORE_DIGITS", 1)
    df = spark.range(3000).withColumnRenamed("id", ROW_ID)
    picks = [(1, 30), (1, 150), (2, 150), (2, 0), (1, 3000)]
    cuts = Selection(df, [1, 2]).cuts(picks)
    for seed, k in picks:
        got = {r[0] for r in df.withColumn("h", select.row_hash(seed)).filter(cuts[seed, k].covers()).select(ROW_ID).collect()}
        assert got == _brute(3000, seed, k)


def test_selection_ignores_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", ROW_ID)
    a = {r[0] for r in select_rows(df, 50, 9).collect()}
    b = {r[0] for r in select_rows(df.repartition(13), 50, 9).collect()}
    assert a == b and len(a) == 50
    assert a != {r[0] for r in select_rows(df, 50, 10).collect()}


def test_caps_and_previews(spark):
    df = spark.range(20).select(F.col("id").alias(ROW_ID), (F.col("id") * 2).alias("x"))
    assert cap_rows(df, None, 1).count() == 20
    assert cap_rows(df, 50, 1).count() == 20
    assert cap_rows(df, 7, 1).count() == 7
    preview = preview_rows(df, 5, 1)
    assert preview.columns == ["x"] and preview.count() == 5


def test_half_to_even():
    assert [half_even(x) for x in (0.5, 1.5, 2.5, 2.51)] == [0, 2, 2, 3]
