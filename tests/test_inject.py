from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowassay import ROW_ID
from rowassay.functions.select import Selection
from rowassay.operators.inject import (
    LABEL_COLUMNS, Injection, inject, inject_mixed, injector, mixed, single,
)
from rowassay.operators.validate import MissingRowId
from rowassay.plans.injection import injection_grid, plan_for

INJECTORS = [
    injector("missing_value", column="amount"),
    injector("out_of_range", column="amount"),
    injector("type_or_format_error", column="text"),
    injector("invalid_category", column="code"),
    injector("duplicate_row"),
    injector("referential_integrity", column="fk"),
    injector("cross_column_logic", kind="temporal", start_col="start", end_col="end"),
    injector("cross_column_logic", kind="sum", total_col="total", component_cols=["a", "b"]),
    injector("distribution_shift", column="amount"),
]
RATES, SEEDS = [0.01, 0.05], [1, 2, 3]
CELLS = [(i, r, s) for i in INJECTORS for r in RATES for s in SEEDS]


@pytest.fixture(scope="module")
def everything(synthetic):
    """All 54 variants from one scan: rows with the row before the change, and labels."""
    selection = Selection(synthetic, SEEDS)
    injection = Injection(synthetic, [single(i, r, s, 1000) for i, r, s in CELLS], "synth", selection)
    assert len(injection.schema_classes()) == 1
    rows = injection.rows(keep_old=True).toPandas()
    labels = injection.labels().toPandas()
    return rows, labels


@pytest.mark.parametrize("at", range(len(CELLS)), ids=[f"{i.error_type}-{r}-{s}" for i, r, s in CELLS])
def test_exact_counts_labels_and_untouched_rows(everything, at):
    inj, rate, seed = CELLS[at]
    k = round(1000 * rate)
    rows, labels = (d[d["_variant"] == at] for d in everything)
    assert len(labels) == k and labels[ROW_ID].is_unique
    assert set(labels["error_type"]) == {inj.error_type}
    assert set(labels["rate"]) == {rate} and set(labels["seed"]) == {seed} and set(labels["dataset"]) == {"synth"}
    labelled = set(labels[ROW_ID])
    base = [c for c in ("amount", "code", "text", "fk", "start", "end", "a", "b", "total")]
    differs = {
        r[ROW_ID] for r in rows.to_dict("records") if r[ROW_ID] == r["_source"]
        and any(r[c] != r["_old"][c] and not (r[c] != r[c] and r["_old"][c] is None) for c in base)
    }
    if inj.error_type == "duplicate_row":
        assert len(rows) == 1000 + k and differs == set()
        assert set(rows[ROW_ID]) - set(range(1000)) == labelled
        assert set(labels["column"]) == {None} and labels["original_value"].astype(int).isin(range(1000)).all()
    else:
        assert len(rows) == 1000 and set(rows[ROW_ID]) == set(range(1000))
        assert differs == labelled and set(labels["column"]) == {inj.column}


def test_same_seed_same_rows_other_seed_other_rows(synthetic):
    first, again, other = (
        {tuple(r) for r in inject(synthetic.repartition(p), INJECTORS[2], 0.05, s)[1].collect()} for p, s in ((3, 7), (11, 7), (3, 8))
    )
    assert first == again
    assert {r[0] for r in first} != {r[0] for r in other}


def _changed(synthetic, inj, **kw):
    corrupted, labels = inject(synthetic, inj, 0.05, 1, **kw)
    return corrupted.join(labels.select(ROW_ID), ROW_ID, "left_semi"), labels


def test_injector_invariants(synthetic):
    top, bottom = synthetic.agg(F.max("amount"), F.min("amount")).first()
    high, _ = _changed(synthetic, injector("out_of_range", column="amount", mode="high"))
    assert {r["amount"] for r in high.collect()} == {top + 100 * (top - bottom)}
    low, _ = _changed(synthetic, injector("out_of_range", column="amount", mode="low"))
    assert {r["amount"] for r in low.collect()} == {bottom - 100 * (top - bottom)}
    broken, _ = _changed(synthetic, INJECTORS[5])
    assert all(r["fk"] < 0 for r in broken.collect())
    assert broken.join(synthetic.select("fk"), "fk", "left_semi").count() == 0
    late, _ = _changed(synthetic, INJECTORS[6])
    assert late.filter("end >= start").count() == 0
    wrong, _ = _changed(synthetic, INJECTORS[7])
    assert wrong.filter("total != a + b + 100").count() == 0


def test_no_injected_key_is_valid(synthetic):
    injection = Injection(synthetic, [single(INJECTORS[5], 0.05, 1, 1000)])
    assert injection.collisions("fk", synthetic.select("fk")) == 0


def test_constant_column_has_span_one(synthetic):
    flat = synthetic.withColumn("amount", F.lit(5.0))
    changed, _ = _changed(flat, injector("out_of_range", column="amount"))
    assert {r["amount"] for r in changed.collect()} == {105.0}


def test_missing_cells_are_labelled_too(synthetic):
    gone = synthetic.withColumn("amount", F.lit(None).cast("double"))
    _, labels = inject(gone, injector("missing_value", column="amount"), 0.05, 1)
    assert labels.count() == 50
    _, labels = inject(gone, injector("out_of_range", column="amount"), 0.05, 1)
    assert labels.count() == 50


def test_type_changes(synthetic):
    text, _ = inject(synthetic, injector("type_or_format_error", column="code"), 0.01, 1)
    assert text.schema["code"].dataType.simpleString() == "string"
    text, _ = inject(synthetic, injector("invalid_category", column="code", invalid_value="ZZZ"), 0.01, 1)
    assert text.filter("code = 'ZZZ'").count() == 10
    number, _ = inject(synthetic, injector("out_of_range", column="code"), 0.01, 1)
    assert number.schema["code"].dataType.simpleString() == "double"


MIX = [
    (injector("missing_value", column="amount"), 0.02),
    (injector("invalid_category", column="code"), 0.02),
    (injector("duplicate_row"), 0.01),
]


def test_mix_is_disjoint_and_adds_up(synthetic):
    corrupted, labels = inject_mixed(synthetic, MIX, 5, "synth")
    assert labels.columns == LABEL_COLUMNS and corrupted.count() == 1010
    in_place = labels.filter(F.col(ROW_ID) < 1000)
    assert in_place.count() == in_place.select(ROW_ID).distinct().count() == 40
    counts = {r["error_type"]: r["count"] for r in labels.groupBy("error_type").count().collect()}
    assert counts == {"missing_value": 20, "invalid_category": 20, "duplicate_row": 10}


def test_mix_sees_what_earlier_parts_left(synthetic):
    plan = [(injector("out_of_range", column="amount"), 0.02), (injector("out_of_range", column="amount"), 0.02)]
    corrupted, labels = inject_mixed(synthetic, plan, 5)
    seen = {r["corrupted_value"] for r in labels.collect()}
    top, bottom = synthetic.agg(F.max("amount"), F.min("amount")).first()
    once = top + 100 * (top - bottom)
    assert {float(v) for v in seen} == {once, once + 100 * (once - bottom)}


def test_wrong_settings_are_errors(synthetic):
    for bad in (
        lambda: injector("nothing", column="x"), lambda: injector("missing_value"),
        lambda: injector("cross_column_logic", kind="temporal", start_col="start"),
        lambda: injector("cross_column_logic", kind="other"), lambda: injector("out_of_range", column="x", mode="up"),
        lambda: mixed([(MIX[0][0], 0.6), (MIX[1][0], 0.6)], 1, 1000),
    ):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(MissingRowId):
        inject(synthetic.drop(ROW_ID), MIX[0][0], 0.1, 1)
    with pytest.raises(KeyError):
        plan_for("unknown")


def test_grid_size(synthetic):
    plan = [i for i, _ in MIX]
    injection = injection_grid(synthetic, plan, RATES, SEEDS, "synth")
    assert len(injection.variants) == len(plan) * 2 * 3 + 3
    # 24 planned targets at two rates and seeds, and a mix per table and seed.
    tables = ("nyc_taxi", "tpch_customer", "tpch_orders", "tpch_lineitem")
    assert sum(len(plan_for(t)) for t in tables) * 4 + len(tables) * 2 == 104


def test_explicit_rows_and_valid_keys(spark, synthetic):
    from pyspark.sql import functions as F

    from rowassay.operators.inject import inject, injector

    named = spark.createDataFrame([(3,), (500,), (999,), (3,)], "_row_id bigint")
    far, labels = inject(synthetic, injector("out_of_range", column="amount"), 0.1, 1, rows=named)
    top = synthetic.agg(F.max("amount")).first()[0]
    assert far.count() == synthetic.count() and {r["_row_id"] for r in far.filter(F.col("amount") > top).collect()} == {3, 500, 999}
    assert {r["_row_id"] for r in labels.collect()} == {3, 500, 999}
    more, _ = inject(synthetic, injector("duplicate_row"), 0.1, 1, rows=named)
    assert more.count() == synthetic.count() + 3 and more.select("_row_id").distinct().count() == more.count()
    broken = injector("referential_integrity", column="fk")
    inject(synthetic, broken, 0.1, 1, rows=named, valid_keys=synthetic.select("fk"))
    with pytest.raises(ValueError):
        inject(synthetic, broken, 0.1, 1, rows=named, valid_keys=spark.createDataFrame([(-4,)], "fk bigint"))


def test_types_of_a_mix_only_widen(spark, synthetic):
    from pyspark.sql import functions as F

    from rowassay.operators.inject import inject_mixed, injector

    plan = [(injector("distribution_shift", column="code", scale=0.5), 0.2), (injector("referential_integrity", column="code"), 0.2)]
    rows, labels = inject_mixed(synthetic, plan, 3)
    assert rows.schema["code"].dataType.simpleString() == "double"
    assert rows.filter(F.col("code") % 1 != 0).count() > 50
    assert {r["original_value"] for r in labels.collect()} == {str(i) for i in range(1, 7)}
