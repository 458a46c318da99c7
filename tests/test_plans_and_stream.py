from __future__ import annotations

import pytest
from conftest import SMALL

from rowassay.catalog.views import LINEITEM, frame, raw
from rowassay.functions.ids import add_row_ids
from rowassay.operators.bind import bind_rules
from rowassay.operators.inject import inject, injector
from rowassay.operators.rules import rule
from rowassay.operators.validate import flags, outcomes
from rowassay.plans.suites import hand_written
from rowassay.streaming import StatefulRule, flag_stream


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_level_paths_never_meet_in_one_partition(spark):
    lines = frame(spark, SMALL, "lineitem_rcv")
    row_rules = [r for r in hand_written("tpch_lineitem") if "unique" not in r.expectation_type]
    for df in (
        add_row_ids(raw(spark, SMALL, "lineitem"), LINEITEM), flags(lines, bind_rules(row_rules, lines)),
        inject(lines, injector("missing_value", column="l_quantity"), 0.05, 1)[0],
    ):
        text = plan(df)
        assert "SinglePartition" not in text and "Python" not in text


def test_row_rules_do_not_shuffle_and_read_only_their_columns(spark):
    lines = frame(spark, SMALL, "lineitem")
    hits = flags(lines, bind_rules([rule("expect_column_values_to_be_between", column="l_quantity", max_value=10)], lines))
    text = plan(hits)
    assert "Exchange" not in text and "ReadSchema: struct<_row_id:bigint,l_quantity:double>" in text


def test_all_row_and_table_rules_share_one_scan(spark):
    lines = frame(spark, SMALL, "lineitem")
    rules = [
        rule("expect_column_values_to_be_between", column="l_quantity", max_value=10),
        rule("expect_column_values_to_be_in_set", column="l_returnflag", value_set=["A"]),
        rule("expect_column_mean_to_be_between", column="l_tax", max_value=1),
        rule("expect_table_row_count_to_be_between", min_value=1),
    ]
    assert plan(outcomes(lines, bind_rules(rules, lines))).count("FileScan parquet") == 1


def test_rules_on_a_stream(spark):
    orders = frame(spark, SMALL, "orders")
    folder = orders.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(orders.schema).parquet(folder)
    rules = [rule("expect_column_values_to_be_between", column="o_totalprice", max_value=250000),
             rule("expect_column_values_to_not_be_null", column="nope")]
    query = flag_stream(stream, rules).writeStream.format("memory").queryName("hits").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("hits").count() == orders.filter("o_totalprice > 250000").count() > 0
    with pytest.raises(StatefulRule):
        flag_stream(stream, [rule("expect_column_values_to_be_unique", column="o_orderkey")])
