"""Queries: the 21 rule types, each over a whole table.

Row and key rules return the flagged rows (one row per row id and rule); table and schema rules
return their outcomes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rowassay.catalog.registry import query
from rowassay.catalog.views import SQL, frame
from rowassay.operators.bind import bind_rules
from rowassay.operators.rules import rule
from rowassay.operators.validate import flags, outcomes

# -- views with gaps and text, made from the given tables ------------------------------------------


def orders_gap(spark, sf):
    """Orders where some statuses and large totals are missing."""
    return frame(spark, sf, "orders").withColumns({
        "o_orderstatus": F.nullif("o_orderstatus", F.lit("P")),
        "o_totalprice": F.when(F.col("o_totalprice") <= 400000, F.col("o_totalprice")),
        "o_orderpriority": F.nullif("o_orderpriority", F.lit("5-LOW")),
    })


SQL["orders_gap"] = (
    "SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, "
    f"CASE WHEN o_totalprice <= 400000 THEN o_totalprice END AS o_totalprice) FROM ({SQL['orders']})"
)


def orders_text(spark, sf):
    """Orders with their date as text, in another order of parts for some."""
    iso, other = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "dd/MM/yyyy")
    return frame(spark, sf, "orders").withColumns({
        "day": F.when(F.col("o_orderstatus") == "P", other).when(F.col("o_orderpriority") != "5-LOW", iso),
        "stamp": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        "compact": F.when(F.col("o_orderstatus") == "O", iso).otherwise(F.date_format("o_orderdate", "yyyyMMdd")),
        "compact_stamp": F.date_format("o_orderdate", "yyyyMMddHHmmss"),
        "spoken": F.when(
            F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "EEE, dd MMM yyyy")
        ).otherwise(F.date_format("o_orderdate", "EEEE, dd MMMM yyyy")),
        "zoned": F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.element_at(
            F.array(F.lit("+0200"), F.lit("-05:30"), F.lit("")), (F.col("o_orderkey") % 3 + 1).cast("int"))),
    })


SQL["orders_text"] = (
    "SELECT *, CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%d/%m/%Y') "
    "WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, "
    "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp, CASE WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d') "
    "ELSE strftime(o_orderdate, '%Y%m%d') END AS compact, "
    "strftime(o_orderdate, '%Y%m%d%H%M%S') AS compact_stamp, "
    "CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%a, %d %b %Y') ELSE strftime(o_orderdate, '%A, %d %B %Y') END AS spoken, "
    "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || (['+0200', '-05:30', ''])[o_orderkey % 3 + 1] AS zoned "
    f"FROM ({SQL['orders']})"
)


def customer_code(spark, sf):
    """Customers with a code that is a number for all but one segment."""
    code = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).otherwise(F.substring("c_name", 10, 20))
    return frame(spark, sf, "customer").withColumn("code", code)


SQL["customer_code"] = (
    "SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE substr(c_name, 10, 20) END AS code "
    f"FROM ({SQL['customer']})"
)

_VIEWS = {"orders_gap": orders_gap, "orders_text": orders_text, "customer_code": customer_code}


def view(spark, sf, name):
    return _VIEWS[name](spark, sf) if name in _VIEWS else frame(spark, sf, name)


# -- registration ----------------------------------------------------------------------------------


def _row_rules(name: str, source: str, *checks) -> None:
    """Register flags of row or key rules, given as (rule, SQL predicate for a flagged row)."""
    sql = f"WITH b AS ({SQL[source]}) " + " UNION ALL ".join(
        f"SELECT _row_id, {i} AS rule_index FROM (SELECT *, {predicate} AS hit FROM b) WHERE hit"
        for i, (_, predicate) in enumerate(checks)
    )

    @query(name, sql)
    def run(spark, sf):
        df = view(spark, sf, source)
        return flags(df, bind_rules([r for r, _ in checks], df))


def _table_rules(name: str, source: str, *checks, row_level: bool = False) -> None:
    """Register outcomes of table or schema rules, given as (rule, SQL for success)."""
    sql = f"WITH b AS ({SQL[source]}) " + " UNION ALL ".join(
        f"SELECT {i} AS rule_index, '{r.expectation_type}' AS expectation_type, {success} AS success FROM b"
        for i, (r, success) in enumerate(checks)
    )

    @query(name, sql)
    def run(spark, sf):
        df = view(spark, sf, source)
        return outcomes(df, bind_rules([r for r, _ in checks], df)).select("rule_index", "expectation_type", "success")


_row_rules(
    "rule_not_null", "orders_gap",
    (rule("expect_column_values_to_not_be_null", column="o_orderstatus"), "o_orderstatus IS NULL"),
    (rule("expect_column_values_to_not_be_null", column="o_totalprice"), "o_totalprice IS NULL"),
    (rule("expect_column_values_to_not_be_null", column="o_orderkey"), "o_orderkey IS NULL"),
)
_row_rules(
    "rule_between", "orders_gap",
    (rule("expect_column_values_to_be_between", column="o_totalprice", min_value=1000, max_value=300000.5),
     "o_totalprice < 1000 OR o_totalprice > 300000.5"),
    (rule("expect_column_values_to_be_between", column="o_custkey", max_value=900), "o_custkey > 900"),
    (rule("expect_column_values_to_be_between", column="o_orderdate", min_value="1996-06-01", strict_min=True),
     "o_orderdate <= TIMESTAMP '1996-06-01'"),
)
_table_rules(
    "rule_min_between", "orders_gap",
    (rule("expect_column_min_to_be_between", column="o_totalprice", min_value=0, max_value=5000),
     "coalesce(min(o_totalprice) BETWEEN 0 AND 5000, false)"),
    (rule("expect_column_min_to_be_between", column="o_orderkey", min_value=1), "coalesce(min(o_orderkey) >= 1, false)"),
    (rule("expect_column_min_to_be_between", column="o_orderdate", min_value="1990-01-01"),
     "coalesce(min(o_orderdate) >= TIMESTAMP '1990-01-01', false)"),
)
_table_rules(
    "rule_max_between", "orders_gap",
    (rule("expect_column_max_to_be_between", column="o_totalprice", max_value=400000),
     "coalesce(max(o_totalprice) <= 400000, false)"),
    (rule("expect_column_max_to_be_between", column="o_totalprice", min_value=400001),
     "coalesce(max(o_totalprice) >= 400001, false)"),
)
_table_rules(
    "rule_mean_between", "orders_gap",
    (rule("expect_column_mean_to_be_between", column="o_totalprice", min_value=100000, max_value=210000),
     "coalesce(avg(o_totalprice) BETWEEN 100000 AND 210000, false)"),
    (rule("expect_column_mean_to_be_between", column="o_custkey", max_value=10), "coalesce(avg(o_custkey) <= 10, false)"),
)
_row_rules(
    "rule_in_set", "orders_gap",
    (rule("expect_column_values_to_be_in_set", column="o_orderstatus", value_set=["O"]),
     "o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('O')"),
    (rule("expect_column_values_to_be_in_set", column="o_custkey", value_set=[1, 2.0, 3.5, "4"]),
     "o_custkey IS NOT NULL AND o_custkey NOT IN (1, 2)"),
)
_row_rules(
    "rule_not_in_set", "orders_gap",
    (rule("expect_column_values_to_not_be_in_set", column="o_orderpriority", value_set=["1-URGENT", "2-HIGH", 7]),
     "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
)
_table_rules(
    "rule_distinct_in_set", "orders_gap",
    (rule("expect_column_distinct_values_to_be_in_set", column="o_orderstatus", value_set=["O", "F"]),
     "count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) = 0"),
    (rule("expect_column_distinct_values_to_be_in_set", column="o_orderpriority", value_set=["1-URGENT"]),
     "count(*) FILTER (o_orderpriority NOT IN ('1-URGENT')) = 0"),
)
_row_rules(
    "rule_of_type", "customer_code",
    (rule("expect_column_values_to_be_of_type", column="code", type_="int64"),
     "code IS NOT NULL AND try_cast(code AS BIGINT) IS NULL"),
    (rule("expect_column_values_to_be_of_type", column="c_custkey", type_="int64"), "false"),
)
_table_rules(
    "rule_of_type_schema", "customer",
    (rule("expect_column_values_to_be_of_type", column="c_acctbal", type_="float64"), "count(*) >= 0"),
    (rule("expect_column_values_to_be_of_type", column="c_acctbal", type_="int64"), "count(*) < 0"),
    (rule("expect_column_values_to_be_of_type", column="c_name", type_="object"), "count(*) >= 0"),
)
_row_rules(
    "rule_in_type_list", "customer_code",
    (rule("expect_column_values_to_be_in_type_list", column="code", type_list=["int32", "float64"]),
     "code IS NOT NULL AND try_cast(code AS INTEGER) IS NULL AND try_cast(code AS DOUBLE) IS NULL"),
    (rule("expect_column_values_to_be_in_type_list", column="c_acctbal", type_list=["int64", "float64"]), "false"),
)
_row_rules(
    "rule_regex", "documents",
    (rule("expect_column_values_to_match_regex", column="text", regex="[0-9]{3}"), "NOT regexp_matches(text, '[0-9]{3}')"),
    (rule("expect_column_values_to_match_regex", column="lang", regex="^(en|de)$"), "NOT regexp_matches(lang, '^(en|de)$')"),
)
_row_rules(
    "rule_regex_python", "documents",  # patterns that only Python writes so: named groups and references, \\Z, flags, Unicode classes
    (rule("expect_column_values_to_match_regex", column="text", regex=r"(?P<letter>[a-z])(?P=letter)(?P=letter)?[ ,.]"),
     "NOT regexp_matches(text, '(" + "|".join(2 * chr(c) for c in range(97, 123)) + ")[ ,.]')"),
    (rule("expect_column_values_to_match_regex", column="lang", regex=r"\A(?P<known_lang>en|de|fr)\Z"), "lang NOT IN ('en', 'de', 'fr')"),
    (rule("expect_column_values_to_match_regex", column="source", regex=r"(?i)^SRC(?P<n>1\d?)$"), "NOT regexp_matches(source, '^src1[0-9]?$')"),
    (rule("expect_column_values_to_match_regex", column="text", regex=r"(?x) [^\W\d_]{20,}  # a long word"),
     "NOT regexp_matches(text, '[\\p{L}]{20}')"),
)
_row_rules(
    "rule_like", "customer",
    (rule("expect_column_values_to_match_like_pattern", column="c_name", like_pattern="Customer#%5"),
     "c_name NOT LIKE 'Customer#%5'"),
    (rule("expect_column_values_to_match_like_pattern", column="c_mktsegment", like_pattern="%U_L%"),
     "c_mktsegment NOT LIKE '%U_L%'"),
)
_row_rules(
    "rule_strftime", "orders_text",
    (rule("expect_column_values_to_match_strftime_format", column="day", strftime_format="%Y-%m-%d"),
     "day IS NOT NULL AND try_strptime(day, '%Y-%m-%d') IS NULL"),
    (rule("expect_column_values_to_match_strftime_format", column="stamp", strftime_format="%Y-%m-%d %H:%M:%S"),
     "try_strptime(stamp, '%Y-%m-%d %H:%M:%S') IS NULL"),
    (rule("expect_column_values_to_match_strftime_format", column="day", strftime_format="%d/%m/%Y"),
     "day IS NOT NULL AND try_strptime(day, '%d/%m/%Y') IS NULL"),
)
_row_rules(
    "rule_strftime_names", "orders_text",
    (rule("expect_column_values_to_match_strftime_format", column="spoken", strftime_format="%A, %d %B %Y"), "o_orderstatus = 'F' AND try_strptime(spoken, '%A, %d %B %Y') IS NULL"),
    (rule("expect_column_values_to_match_strftime_format", column="spoken", strftime_format="%a, %d %b %Y"), "try_strptime(spoken, '%a, %d %b %Y') IS NULL"),
    (rule("expect_column_values_to_match_strftime_format", column="zoned", strftime_format="%Y-%m-%d %H:%M:%S%z"), "o_orderkey % 3 = 2"),
)
_row_rules(
    "rule_length", "documents",
    (rule("expect_column_value_lengths_to_be_between", column="text", min_value=200, max_value=5000),
     "length(text) < 200 OR length(text) > 5000"),
)
_row_rules(
    "rule_unique", "orders_gap",
    (rule("expect_column_values_to_be_unique", column="o_totalprice"),
     "o_totalprice IS NOT NULL AND count(*) OVER (PARTITION BY o_totalprice) > 1"),
    (rule("expect_column_values_to_be_unique", column="o_orderkey"), "count(*) OVER (PARTITION BY o_orderkey) > 1"),
    (rule("expect_column_values_to_be_unique", column="o_custkey"), "count(*) OVER (PARTITION BY o_custkey) > 1"),
)
_row_rules(
    "rule_compound_unique", "lineitem",
    (rule("expect_compound_columns_to_be_unique", column_list=["l_orderkey", "l_linenumber"]),
     "count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1"),
)
_row_rules(
    "rule_compound_unique_gap", "orders_gap",
    (rule("expect_compound_columns_to_be_unique", column_list=["o_orderstatus", "o_orderpriority", "o_custkey"]),
     "count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority, o_custkey) > 1"),
    (rule("expect_compound_columns_to_be_unique", column_list=["o_orderstatus", "o_orderpriority"]),
     "(o_orderstatus IS NOT NULL OR o_orderpriority IS NOT NULL) "
     "AND count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) > 1"),
)
_row_rules(
    "rule_unique_in_record", "lineitem",
    (rule("expect_select_column_values_to_be_unique_within_record", column_list=["l_linenumber", "l_suppkey", "l_quantity"]),
     "l_linenumber = l_suppkey OR l_linenumber = l_quantity OR l_suppkey = l_quantity"),
)
_row_rules(
    "rule_unique_in_record_gap", "orders_gap",
    (rule("expect_select_column_values_to_be_unique_within_record", column_list=["o_orderstatus", "o_orderpriority", "o_totalprice"]),
     "(o_orderstatus IS NOT NULL OR o_orderpriority IS NOT NULL OR o_totalprice IS NOT NULL) AND "
     "(o_orderstatus IS NOT DISTINCT FROM o_orderpriority OR (o_totalprice IS NULL AND (o_orderstatus IS NULL OR o_orderpriority IS NULL)))"),
)
_row_rules(
    "rule_pair_gt", "lineitem_rcv",
    (rule("expect_column_pair_values_a_to_be_greater_than_b", column_A="l_quantity", column_B="l_linenumber"),
     "NOT l_quantity > l_linenumber"),
    (rule("expect_column_pair_values_a_to_be_greater_than_b", column_A="l_receiptdate", column_B="l_shipdate", or_equal=True),
     "NOT l_receiptdate >= l_shipdate"),
)
_row_rules(
    "rule_pair_gt_gap", "orders_gap",
    (rule("expect_column_pair_values_a_to_be_greater_than_b", column_A="o_orderstatus", column_B="o_orderpriority", or_equal=True),
     "(o_orderstatus IS NOT NULL OR o_orderpriority IS NOT NULL) AND NOT coalesce(o_orderstatus >= o_orderpriority, false)"),
)
_row_rules(
    "rule_pair_eq", "orders_gap",
    (rule("expect_column_pair_values_to_be_equal", column_A="o_orderstatus", column_B="o_orderpriority"),
     "o_orderstatus IS DISTINCT FROM o_orderpriority"),
    (rule("expect_column_pair_values_to_be_equal", column_A="o_orderkey", column_B="o_custkey"),
     "o_orderkey IS DISTINCT FROM o_custkey"),
)
_row_rules(
    "rule_row_sum", "lineitem",
    (rule("expect_multicolumn_sum_to_equal", column_list=["l_quantity", "l_linenumber"], sum_total=30),
     "l_quantity + l_linenumber <> 30"),
)
_table_rules(
    "rule_row_count", "lineitem",
    (rule("expect_table_row_count_to_be_between", min_value=1, max_value=50000), "count(*) BETWEEN 1 AND 50000"),
    (rule("expect_table_row_count_to_be_between", min_value=1), "count(*) >= 1"),
)


# -- value sets that are tables -----------------------------------------------------------------------

# 100,000 members, far beyond what stands in a plan as literals; three rules, two columns, one with an unknown half.
_MANY = [7 * i for i in range(100_000)]
_SPOKEN = [f"Customer#{i:09d}" for i in range(0, 300_000, 3)]


def _set_rules(name: str, source: str, *rules_and_sql) -> None:
    sql = " UNION ALL ".join(
        f"SELECT {i} AS rule_index, count(*) FILTER ({p}) = 0 AS success, {u} AS unexpected_count FROM b" for i, (_, p, u) in enumerate(rules_and_sql)
    )

    @query(name, f"WITH b AS ({SQL[source]}) {sql}")
    def run(spark, sf):
        df = view(spark, sf, source)
        sets = {"suppliers": frame(spark, sf, "orders").filter("o_orderstatus <> 'P'").select("o_custkey")}
        return outcomes(df, bind_rules([r for r, _, _ in rules_and_sql], df, sets)).select("rule_index", "success", "unexpected_count")


_SEVENTH = "o_orderkey % 7 <> 0 OR o_orderkey >= 700000"
_set_rules(
    "rule_large_sets", "orders_gap",
    (rule("expect_column_values_to_be_in_set", column="o_orderkey", value_set=_MANY), _SEVENTH, f"count(*) FILTER ({_SEVENTH})"),
    (rule("expect_column_values_to_not_be_in_set", column="o_orderkey", value_set=_MANY), f"NOT ({_SEVENTH})", f"count(*) FILTER (NOT ({_SEVENTH}))"),
    (rule("expect_column_distinct_values_to_be_in_set", column="o_totalprice", value_set=_MANY + ["x", 0.5]),
     "o_totalprice IS NOT NULL AND NOT (o_totalprice % 7 = 0 AND o_totalprice < 700000) AND o_totalprice <> 0.5", "NULL"),
    (rule("expect_column_values_to_be_in_set", column="o_custkey", value_set={"table": "suppliers"}),
     "o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P')",
     "count(*) FILTER (o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P'))"),
)
_row_rules(
    "rule_large_set_rows", "customer",
    (rule("expect_column_values_to_be_in_set", column="c_name", value_set=_SPOKEN), "CAST(substr(c_name, 10) AS BIGINT) % 3 <> 0 OR CAST(substr(c_name, 10) AS BIGINT) >= 300000"),
    (rule("expect_column_values_to_not_be_in_set", column="c_custkey", value_set=_SPOKEN), "false"),
)


# -- suites of many rules -----------------------------------------------------------------------------

# 1,000 rules over eleven columns: several passes, each with the columns of its rules only.
_BOUNDS = {
    "l_orderkey": 150, "l_partkey": 20, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 1, "l_extendedprice": 1000,
    "l_discount": 0.001, "l_tax": 0.001,
}
_THOUSAND = [(c, round(step * (i + 1), 3)) for c, step in _BOUNDS.items() for i in range(125)]


@query(
    "validate_thousand_rules",
    "WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', CAST({v!r} AS DOUBLE))" for i, (c, v) in enumerate(_THOUSAND)) + ") t(rule_index, name, bound)), "
    + "v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS DOUBLE) AS value, count(*) AS n FROM lineitem GROUP BY ALL" for c in _BOUNDS) + ") "
    "SELECT rule_index, coalesce(sum(n) FILTER (value > bound), 0) = 0 AS success, CAST(coalesce(sum(n) FILTER (value > bound), 0) AS BIGINT) AS unexpected_count "
    "FROM r JOIN v USING (name) GROUP BY rule_index",
)
def q_validate_thousand_rules(spark, sf):
    df = frame(spark, sf, "lineitem")
    rules = [rule("expect_column_values_to_be_between", column=c, max_value=v) for c, v in _THOUSAND]
    return outcomes(df, bind_rules(rules, df)).select("rule_index", "success", "unexpected_count")


# -- rules that cannot run, and tolerance ------------------------------------------------------------

_MIXED_BAG = [
    rule("expect_column_values_to_not_be_null", column="o_orderstatus", mostly=0.5),
    rule("expect_column_values_to_be_in_set", column="o_orderstatus", value_set=["O"], mostly=0.9),
    rule("expect_column_values_to_be_between", column="no_such_column", min_value=0),
    rule("expect_column_values_to_be_between", column="o_orderpriority", min_value=0),
    rule("expect_column_values_to_match_regex", column="o_orderpriority", regex="(["),
    rule("expect_column_value_lengths_to_be_between", column="o_orderpriority", min_value=5, max_value=15),
    rule("expect_column_values_to_be_unique", column="o_custkey"),
    rule("expect_column_values_to_match_strftime_format", column="o_orderpriority", strftime_format="%Q"),
]


@query(
    "validate_suite",
    f"WITH b AS ({SQL['orders_gap']}), u AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) > 1 AS rep FROM b), "
    "n AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus IS NULL) AS u0, "
    "count(*) FILTER (o_orderstatus <> 'O') AS u1, count(o_orderstatus) AS c1, "
    "count(*) FILTER (length(o_orderpriority) NOT BETWEEN 5 AND 15) AS u5, count(*) FILTER (rep) AS u6 FROM u) "
    "SELECT 0 AS rule_index, 1 - u0 / n >= 0.5 AS success, u0 AS unexpected_count, n AS element_count, true AS is_row_level, false AS failed_to_run FROM n "
    "UNION ALL SELECT 1, 1 - u1 / c1 >= 0.9, u1, n, true, false FROM n "
    "UNION ALL SELECT unnest([2, 3, 4, 7]), NULL, NULL, NULL, false, true "
    "UNION ALL SELECT 5, u5 = 0, u5, n, true, false FROM n UNION ALL SELECT 6, u6 = 0, u6, n, true, false FROM n",
)
def q_validate_suite(spark, sf):
    df = view(spark, sf, "orders_gap")
    return outcomes(df, bind_rules(_MIXED_BAG, df)).select(
        "rule_index", "success", "unexpected_count", "element_count", "is_row_level",
        F.col("exception").isNotNull().alias("failed_to_run"),
    )


_row_rules(
    "rule_strftime_compact", "orders_text",
    (rule("expect_column_values_to_match_strftime_format", column="compact", strftime_format="%Y%m%d"), "o_orderstatus = 'O'"),
    (rule("expect_column_values_to_match_strftime_format", column="compact_stamp", strftime_format="%Y%m%d%H%M%S"), "false"),
    (rule("expect_column_values_to_match_strftime_format", column="compact", strftime_format="%Y%m%d%H%M%S"), "true"),
)

_UNUSABLE = [
    rule("expect_column_values_to_be_between", column="o_orderdate", min_value="19960601"),
    rule("expect_column_values_to_be_between", column="o_orderdate", max_value="1997-W01-1"),
    rule("expect_column_values_to_be_between", column="o_orderdate", min_value="next week"),
    rule("expect_column_values_to_match_like_pattern", column="o_orderpriority", like_pattern="C:\\temp%"),
    rule("expect_column_values_to_match_like_pattern", column="o_orderpriority", like_pattern="1-%"),
    rule("expect_column_values_to_be_of_type", column="o_totalprice", type_="money"),
    rule("expect_column_values_to_be_of_type", column="o_totalprice", type_="float"),
    rule("expect_column_values_to_be_in_set", column="o_orderdate", value_set=["19950101", "never"]),
    rule("expect_column_values_to_not_be_null", column="o_orderpriority"),
]


@query(
    "rule_unusable",
    f"WITH b AS ({SQL['orders_gap']}), n AS (SELECT count(*) AS n, "
    "count(*) FILTER (o_orderdate < TIMESTAMP '1996-06-01') AS u0, count(*) FILTER (o_orderdate > TIMESTAMP '1996-12-30') AS u1, "
    "count(*) FILTER (o_orderpriority NOT LIKE '1-%') AS u4, count(*) FILTER (o_orderdate <> TIMESTAMP '1995-01-01') AS u7, "
    "count(*) FILTER (o_orderpriority IS NULL) AS u8 FROM b) "
    "SELECT 0 AS rule_index, u0 = 0 AS success, u0 AS unexpected_count, false AS failed_to_run FROM n UNION ALL SELECT 1, u1 = 0, u1, false FROM n "
    "UNION ALL SELECT unnest([2, 3, 5]), NULL, NULL, true UNION ALL SELECT 4, u4 = 0, u4, false FROM n UNION ALL SELECT 6, true, NULL, false "
    "UNION ALL SELECT 7, u7 = 0, u7, false FROM n UNION ALL SELECT 8, u8 = 0, u8, false FROM n",
)
def q_rule_unusable(spark, sf):
    df = view(spark, sf, "orders_gap")
    return outcomes(df, bind_rules(_UNUSABLE, df)).select("rule_index", "success", "unexpected_count", F.col("exception").isNotNull().alias("failed_to_run"))
