from __future__ import annotations

import pytest

from rowassay.operators.bind import ERROR, bind_rules, datetime_pattern
from rowassay.operators.rules import RULE_SPECS, BadKwargs, UnknownRule, build_rules, canonical, is_allowed, rule
from rowassay.operators.validate import MissingRowId, flagged_rows, flags, outcomes, suite_outcomes, validate_suite

NULLS = "_row_id bigint, n double, m double, s string, t timestamp_ntz, i int"


@pytest.fixture(scope="module")
def gaps(spark):
    from datetime import datetime as d

    return spark.createDataFrame([
        (0, 1.0, 1.0, "ab", d(2024, 1, 1), 1), (1, None, 2.0, None, d(2024, 1, 2), 1),
        (2, 5.0, None, "abc", None, None), (3, None, None, "ab", d(2024, 1, 3), 3), (4, 9.0, 1.0, "", d(2024, 1, 4), 4),
    ], NULLS)


def test_vocabulary():
    assert len(RULE_SPECS) == 21 and is_allowed("expect_column_values_to_be_unique") and not is_allowed("expect_magic")
    with pytest.raises(UnknownRule):
        rule("expect_magic", column="x")
    with pytest.raises(BadKwargs):
        rule("expect_column_values_to_not_be_null", bad=1)
    with pytest.raises(BadKwargs):
        rule("expect_column_values_to_be_between", column="x")
    assert len(build_rules([{"expectation_type": "expect_magic", "kwargs": {}}, {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "x"}}])) == 1
    assert canonical({"b": 1, "a": [2]}) == canonical({"a": [2], "b": 1})


CASES = [
    (("expect_column_values_to_not_be_null", dict(column="n")), {1, 3}),
    (("expect_column_values_to_be_between", dict(column="n", min_value=2, max_value=5)), {0, 4}),
    (("expect_column_values_to_be_between", dict(column="n", max_value=5, strict_max=True)), {2, 4}),
    (("expect_column_values_to_be_between", dict(column="t", min_value="2024-01-02T00:00:00")), {0}),
    (("expect_column_values_to_be_in_set", dict(column="s", value_set=["ab", 7])), {2, 4}),
    (("expect_column_values_to_be_in_set", dict(column="i", value_set=["1"])), {0, 1, 3, 4}),
    (("expect_column_values_to_not_be_in_set", dict(column="i", value_set=[1.0, 3])), {0, 1, 3}),
    (("expect_column_values_to_match_regex", dict(column="s", regex="b")), {4}),
    (("expect_column_values_to_match_like_pattern", dict(column="s", like_pattern="a_")), {2, 4}),
    (("expect_column_value_lengths_to_be_between", dict(column="s", min_value=1, max_value=2)), {2, 4}),
    (("expect_column_values_to_be_unique", dict(column="s")), {0, 3}),
    (("expect_compound_columns_to_be_unique", dict(column_list=["n", "m"])), set()),
    (("expect_compound_columns_to_be_unique", dict(column_list=["i", "i"])), {0, 1}),
    (("expect_select_column_values_to_be_unique_within_record", dict(column_list=["n", "m"])), {0}),
    (("expect_select_column_values_to_be_unique_within_record", dict(column_list=["n", "m", "i"])), {0, 2, 3}),
    (("expect_column_pair_values_a_to_be_greater_than_b", dict(column_A="n", column_B="m", or_equal=True)), {1, 2}),
    (("expect_column_pair_values_a_to_be_greater_than_b", dict(column_A="n", column_B="m")), {0, 1, 2}),
    (("expect_column_pair_values_to_be_equal", dict(column_A="n", column_B="m")), {1, 2, 4}),
    (("expect_multicolumn_sum_to_equal", dict(column_list=["n", "m"], sum_total=2)), {2, 4}),
    (("expect_column_values_to_be_of_type", dict(column="s", type_="int64")), {0, 2, 3, 4}),
    (("expect_column_values_to_be_in_type_list", dict(column="s", type_list=["int64", "object"])), set()),
    (("expect_column_values_to_match_strftime_format", dict(column="s", strftime_format="%Y")), {0, 2, 3, 4}),
]


@pytest.mark.parametrize("case", range(len(CASES)), ids=[c[0][0] + str(i) for i, c in enumerate(CASES)])
def test_row_and_key_rules(gaps, case):
    (kind, kwargs), expected = CASES[case]
    if kind == "expect_compound_columns_to_be_unique" and len(set(kwargs["column_list"])) == 1:
        kwargs = {"column_list": kwargs["column_list"][:1]}
    bound = bind_rules([rule(kind, **kwargs)], gaps)
    assert {r[0] for r in flagged_rows(gaps, bound).collect()} == expected
    out = outcomes(gaps, bound).first()
    assert out["success"] is (not expected)
    if out["is_row_level"]:
        assert out["unexpected_count"] == len(expected) and out["element_count"] == 5


def test_fused_equals_rule_by_rule(gaps):
    rules = [rule(k, **kw) for (k, kw), _ in CASES if kw.get("column_list") != ["i", "i"]]
    together = {r["rule_index"]: r for r in outcomes(gaps, bind_rules(rules, gaps)).collect()}
    hits = {(r[0], r[1]) for r in flags(gaps, bind_rules(rules, gaps)).collect()}
    for i, r in enumerate(rules):
        alone = outcomes(gaps, bind_rules([r], gaps)).first()
        assert together[i]["success"] == alone["success"] and together[i]["unexpected_count"] == alone["unexpected_count"]
        assert {a for a, b in hits if b == i} == {x[0] for x in flagged_rows(gaps, bind_rules([r], gaps)).collect()}


def test_table_rules(gaps, spark):
    rules = [
        rule("expect_column_min_to_be_between", column="n", min_value=1, max_value=1),
        rule("expect_column_max_to_be_between", column="n", max_value=8),
        rule("expect_column_mean_to_be_between", column="n", min_value=5, max_value=5),
        rule("expect_column_distinct_values_to_be_in_set", column="s", value_set=["", "ab", "abc"]),
        rule("expect_table_row_count_to_be_between", min_value=5, max_value=5),
        rule("expect_column_values_to_be_of_type", column="n", type_="int64"),
    ]
    got = [r["success"] for r in outcomes(gaps, bind_rules(rules, gaps)).orderBy("rule_index").collect()]
    assert got == [True, False, True, True, True, False]
    empty = gaps.filter("false")
    got = [r["success"] for r in outcomes(empty, bind_rules(rules[:4], empty)).orderBy("rule_index").collect()]
    assert got == [False] * 4


def test_tolerance(gaps):
    rules = [
        rule("expect_column_values_to_be_in_set", column="s", value_set=["ab"], mostly=0.5),
        rule("expect_column_values_to_be_in_set", column="s", value_set=["ab"], mostly=0.51),
        rule("expect_column_values_to_be_unique", column="i", mostly=0.5),
    ]
    got = [r["success"] for r in outcomes(gaps, bind_rules(rules, gaps)).orderBy("rule_index").collect()]
    assert got == [True, False, True]


def test_unbindable_rules_do_not_disturb_the_others(gaps):
    rules = [
        rule("expect_column_values_to_not_be_null", column="nope"),
        rule("expect_column_values_to_be_between", column="s", min_value=0),
        rule("expect_column_values_to_match_regex", column="s", regex="(["),
        rule("expect_column_values_to_match_regex", column="n", regex="a"),
        rule("expect_column_values_to_match_strftime_format", column="s", strftime_format="%Q"),
        rule("expect_column_mean_to_be_between", column="s", min_value=0),
        rule("expect_column_pair_values_to_be_equal", column_A="s", column_B="n"),
        rule("expect_column_values_to_be_in_set", column="s", value_set="ab"),
        rule("expect_column_values_to_not_be_null", column="_row_id"),
    ]
    bound = bind_rules(rules, gaps)
    assert [b.kind == ERROR for b in bound] == [True] * 8 + [False]
    report = suite_outcomes(outcomes(gaps, bound)).first()
    assert (report["n_rules"], report["n_failed"], report["n_runtime_errors"], report["dataset_detected"]) == (9, 0, 8, False)


def test_a_table_without_row_ids_is_refused(gaps):
    with pytest.raises(MissingRowId):
        validate_suite(gaps.drop("_row_id"), [])


def test_strftime_patterns():
    assert datetime_pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-M-d'T'H:m:s"


def test_hot_key_is_flagged_whole(spark):
    """A third of the rows share one key."""
    df = spark.range(30_000).selectExpr("id AS _row_id", "if(id % 3 = 0, -1, id) AS k")
    bound = bind_rules([rule("expect_column_values_to_be_unique", column="k")], df)
    assert flagged_rows(df, bound).count() == 10_000
    assert outcomes(df, bound).first()["unexpected_count"] == 10_000


def test_time_literals_like_and_strftime(spark):
    from rowassay.operators.bind import bind_rules
    from rowassay.operators.rules import rule
    from rowassay.operators.validate import outcomes

    df = spark.createDataFrame([(0, "20240115", "C:\\temp"), (1, "2024-01-15", "x_y")], "_row_id bigint, day string, path string")
    df = df.selectExpr("*", "TIMESTAMP_NTZ '2024-01-15 12:00:00' AS moment", "1.5D AS wide")
    cases = [
        (rule("expect_column_values_to_match_strftime_format", column="day", strftime_format="%Y%m%d"), 1),
        (rule("expect_column_values_to_match_strftime_format", column="day", strftime_format="%Y-%m-%d"), 1),
        (rule("expect_column_values_to_match_like_pattern", column="path", like_pattern="x\\_y"), 1),
        (rule("expect_column_values_to_match_like_pattern", column="path", like_pattern="C:\\temp%"), None),
        (rule("expect_column_values_to_match_like_pattern", column="path", like_pattern="C:\\\\temp%"), 1),
        (rule("expect_column_values_to_be_between", column="moment", min_value="20240115T120000"), 0),
        (rule("expect_column_values_to_be_between", column="moment", max_value="2024-W01-1"), 2),
        (rule("expect_column_values_to_be_in_set", column="moment", value_set=["20240115T12", "soon"]), 0),
        (rule("expect_column_values_to_match_regex", column="day", regex="(["), None),
        (rule("expect_column_values_to_be_of_type", column="wide", type_="float"), None),
    ]
    found = {r["rule_index"]: r for r in outcomes(df, bind_rules([r for r, _ in cases], df)).collect()}
    assert [found[i]["unexpected_count"] for i in range(len(cases))] == [n for _, n in cases]
    assert found[9]["success"] and found[3]["exception"] and found[8]["exception"]


PATTERNS = [
    r"^a$", r"^a\Z", r"\Aa", r"(?P<x>a)b(?P=x)", r"(?P<first_name>\w+) (?P=first_name)?", r"^\w+$", r"\d{3}", r"^\S+$", r"[^\d]", r"[^\W\d_]",
    r"\bfoo\b", r"\B", r"^.$", r"(?s)^.+$", r"(?m)^next$", r"(?m)$", r"(?i)abc", r"(?i)É", r"(?i:a)B", r"(?x) a  b # comment", r"(?a)^\w+$",
    r"a{2,}?b", r"a*+a", r"(?>a+)b", r"(a)|b\1", r"(?<=a)b", r"(?<!a)b", r"[]x]", r"[a\-b]", r"\$\d", r"[.\-|\\]", r"^(ab)+$", r"#[0-9]+$",
    r"[\s\S]", r"\x41", r"(?i)k", r"a|", r"(a(b)(c))\2?", r"(?i:(?-i:a)b)", "",
]
TEXTS = [
    "", "a", "abc", "ABC", "aba", "a\n", "a\r\n", "\n", "line\nnext", "é", "É", "١٢٣", "123", "foo bar", "foo_bar", " ", "\x1c", "a b", "aa aa",
    "aab", "Customer#12", "customer#12\n", "ababab", "[x]", "a.b", "a-b", "日本語", "K", "k", "\x85", "$5", "a|b", "a\\b",
]


def test_patterns_match_as_in_python(spark):
    import re

    from rowassay.operators.patterns import UnusablePattern, java_pattern

    compiled = spark._jvm.java.util.regex.Pattern
    for p in PATTERNS:
        java = compiled.compile(java_pattern(p))
        assert [t for t in TEXTS if java.matcher(t).find()] == [t for t in TEXTS if re.search(p, t)], p
    for p in (r"([", r"(?P<a>x)(?(a)y|z)", r"\p{L}", r"*a", r"(?P=q)"):
        with pytest.raises(UnusablePattern):
            java_pattern(p)


def test_bounds_that_are_no_numbers(gaps):
    rules = [rule("expect_column_values_to_be_between", column="n", **{k: v}) for k in ("min_value", "max_value") for v in (float("nan"), float("inf"), -float("inf"))]
    assert [r["unexpected_count"] for r in outcomes(gaps, bind_rules(rules, gaps)).orderBy("rule_index").collect()] == [3, 3, 0, 3, 0, 3]
    top = rule("expect_column_max_to_be_between", column="n", max_value=float("nan"))
    assert outcomes(gaps, bind_rules([top], gaps)).first()["success"] is False


def test_large_sets_decide_as_small_ones_do(spark, gaps, monkeypatch):
    from rowassay.operators import bind

    sets = {
        "n": [1, 5.0, "5", True], "s": ["ab", 7, None], "i": [1.0, 3, 2.5, 10**30, float("inf")], "t": ["2024-01-02", "never", "2024-01-03T00:00:00"],
        "m": [],
    }
    kinds = ("expect_column_values_to_be_in_set", "expect_column_values_to_not_be_in_set", "expect_column_distinct_values_to_be_in_set")
    rules = [rule(k, column=c, value_set=v) for c, v in sets.items() for k in kinds]

    def judged():
        bound = bind_rules(rules, gaps)
        hits = {tuple(r) for r in flags(gaps, bound).collect()}
        return sorted(outcomes(gaps, bound).drop("kwargs").collect()), hits, {r[0] for r in flagged_rows(gaps, bound).collect()}

    small = judged()
    monkeypatch.setattr(bind, "LARGE", -1)
    assert judged() == small
    assert all(b.lookups for b in bind_rules(rules, gaps))
    table = spark.createDataFrame([("ab",), ("ab",), (None,)], "word string")
    named = [rule(k, column=c, value_set={"table": "words"}) for c in ("s", "i") for k in kinds] + [rule(kinds[0], column="s", value_set={"table": "none"})]
    found = {r["rule_index"]: (r["success"], r["unexpected_count"]) for r in outcomes(gaps, bind_rules(named, gaps, {"words": table})).collect()}
    assert found == {0: (False, 2), 1: (False, 2), 2: (False, None), 3: (False, 4), 4: (True, 0), 5: (False, None), 6: (None, None)}


def test_a_thousand_rules_stay_in_generated_code(spark):
    from rowassay.operators.validate import code_passes

    columns = [f"c{i}" for i in range(20)]
    df = spark.range(100).selectExpr("id AS _row_id", *[f"id * {i} AS {c}" for i, c in enumerate(columns)])
    rules = [rule("expect_column_values_to_be_between", column=c, min_value=-v, max_value=v) for c in columns for v in range(49)]
    rules += [rule("expect_select_column_values_to_be_unique_within_record", column_list=columns[i : i + 4]) for i in range(15)]
    rules += [rule("expect_column_mean_to_be_between", column=c, min_value=0) for c in columns]
    bound = bind_rules(rules, df)
    passes = code_passes(bound)
    assert sorted(b.index for p in passes for b in p) == list(range(len(rules)))
    assert sum(len({c for b in p for c in b.columns}) for p in passes) <= 5 * len(columns)  # a column is not read by every pass
    whole = {r["rule_index"]: (r["success"], r["unexpected_count"]) for r in outcomes(df, bound).collect()}
    for i in range(0, len(rules), 97):
        one = outcomes(df, [bound[i]]).first()
        assert whole[i] == (one["success"], one["unexpected_count"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for frame in (outcomes(df, passes[0] + passes[-1]), flags(df, bound), flagged_rows(df, bound)):
            plan = frame._jdf.queryExecution().executedPlan()
            generated = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(plan)
            sizes = [generated.apply(i)._3().maxMethodCodeSize() for i in range(generated.length())]
            assert sizes and max(sizes) < 8000, sizes
            assert "(1) HashAggregate" in plan.toString() or "(1) Filter" in plan.toString() or "*(" in plan.toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("form, texts", [
    ("%A, %d %B %Y", ["Monday, 05 February 2024", "monday, 5 february 2024", "Mon, 05 February 2024", "Monday, 31 February 2024", "Monday 05 February 2024", ""]),
    ("%d %b %Y (%a)", ["05 Feb 2024 (Tue)", "05 Feb 2024 (Tues)", "05 Feb 2024", "5 FEB 2024 (TUE)"]),
    ("%Y-%m-%d %H:%M:%S%z", ["2024-02-05 10:00:00+0200", "2024-02-05 10:00:00-05:30", "2024-02-05 10:00:00", "2024-02-05 10:00:00+2", "2024-02-05 10:00:00Z"]),
    ("%%%Y", ["%2024", "2024"]),
])
def test_times_are_read_as_in_python(spark, form, texts):
    from datetime import datetime

    from rowassay.operators.bind import datetime_of

    def reads(text):
        try:
            datetime.strptime(text, form)
        except ValueError:
            return False
        return True

    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", datetime_of(F.col("t"), form).isNotNull().alias("ok")).collect()
    assert {r["t"]: r["ok"] for r in rows} == {t: reads(t) for t in texts}
