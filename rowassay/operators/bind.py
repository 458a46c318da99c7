"""Bind rules to a schema: every rule becomes Column expressions, or an error, before any job runs.

All type questions are settled here, because inside a fused job one bad comparison would fail
every rule at once.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowassay.operators.patterns import UnusablePattern, java_pattern
from rowassay.operators.rules import Rule, canonical
from rowassay.operators.sets import LARGE, Lookup

ROW, KEY, TABLE, SCHEMA, ERROR = "row", "key", "table", "schema", "error"

# Accepted type names and the column types they stand for. The bare names ``int`` and
# ``float`` say nothing about the width.
TYPE_NAMES: dict[str, tuple[str, ...]] = {
    "int64": ("bigint",), "int32": ("int",), "int16": ("smallint",), "int8": ("tinyint",),
    "float64": ("double",), "float32": ("float",),
    "object": ("string",), "str": ("string",), "string": ("string",),
    "bool": ("boolean",), "boolean": ("boolean",),
    "datetime64[ns]": ("timestamp_ntz", "timestamp"), "datetime64[us]": ("timestamp_ntz", "timestamp"),
    "datetime64": ("timestamp_ntz", "timestamp"),
    "bigint": ("bigint",), "int": ("int", "bigint"), "smallint": ("smallint",), "tinyint": ("tinyint",),
    "double": ("double",), "float": ("float", "double"), "timestamp": ("timestamp",),
    "timestamp_ntz": ("timestamp_ntz",), "date": ("date",),
}

# Strftime directives and the datetime pattern letters they stand for.
STRFTIME: dict[str, str] = {
    "%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%f": "SSSSSS",
    "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%I": "h", "%p": "a", "%z": "XX", "%%": "%",
}
# Names of weekdays, which Spark writes but does not read.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


class BindError(Exception):
    """The rule cannot run against this schema."""


@dataclass(frozen=True)
class TableState:
    """A table-level statistic: ``value`` aggregated by ``how``, then tested by ``holds``."""

    how: str  # min | max | mean | bad | rows
    value: Column
    columns: tuple[str, ...]
    holds: Callable[[Column], Column]


@dataclass(frozen=True)
class BoundRule:
    index: int
    rule: Rule
    kind: str
    violated: Column | None = None  # ROW: flags this row (never NULL)
    counted: Column | None = None  # ROW/KEY: the row takes part in ``mostly``
    key: tuple[str, ...] = ()  # KEY
    state: TableState | None = None  # TABLE
    passes: bool | None = None  # SCHEMA
    error: str | None = None  # ERROR
    mostly: float = 1.0
    columns: tuple[str, ...] = field(default=())  # columns the verdict depends on
    lookups: tuple[Lookup, ...] = ()  # sets that ``with_sets`` must have joined


def _family(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(t, T.BooleanType):
        return "flag"
    return "other"


def _literal(value, t: T.DataType) -> Column | None:
    """``value`` as a literal comparable with a column of type ``t``; None when it cannot be."""
    family = _family(t)
    if family == "number" and isinstance(value, (int, float)) and not isinstance(value, bool):
        if isinstance(value, float) and value.is_integer() and abs(value) < 2**53 and isinstance(t, T.IntegralType):
            value = int(value)
        if isinstance(value, int) and not -(2**63) <= value < 2**63:
            value = float(value)
        return F.lit(value)
    if family == "text" and isinstance(value, str):
        return F.lit(value)
    if family == "flag" and isinstance(value, bool):
        return F.lit(value)
    if family == "time" and isinstance(value, str):
        try:
            moment = datetime.fromisoformat(value)
        except ValueError:
            return None
        if isinstance(t, T.TimestampNTZType):
            moment = moment.replace(tzinfo=None)
        # one spelling that Spark reads, whichever of the ISO forms the rule has
        return F.lit(moment.isoformat(sep=" ", timespec="microseconds")).cast(t)
    return None


@functools.lru_cache(maxsize=4096)
def _regex_problem(pattern: str) -> str | None:
    """Spark accepts any pattern when planning and fails only when running, so compile it first."""
    try:
        SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile(pattern)
    except (PySparkException, Py4JJavaError) as problem:
        return str(problem).splitlines()[0]
    return None


# Directives that stand for digits; where two of them touch, both take their full width.
_DIGITS = {"%Y", "%m", "%d", "%H", "%M", "%S", "%f", "%y", "%j", "%I"}
_FULL_WIDTH = {"%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%I": "hh"}


def datetime_pattern(strftime: str) -> str:
    parts = re.findall(r"%.?|[^%]", strftime, re.DOTALL)
    out = []
    for i, part in enumerate(parts):
        if part.startswith("%"):
            if part not in STRFTIME:
                raise BindError(f"strftime directive {part!r} has no counterpart")
            beside = [*parts[max(i - 1, 0) : i], *parts[i + 1 : i + 2]]
            touches = part in _DIGITS and any(b in _DIGITS or b.isdigit() for b in beside)
            out.append(_FULL_WIDTH.get(part, STRFTIME[part]) if touches else STRFTIME[part])
        else:
            out.append("''" if part == "'" else f"'{part}'" if part.isalpha() or part in "[]{}#" else part)
    return "".join(out)


def datetime_of(text: Column, strftime: str) -> Column:
    """The moment that ``text`` is in a strftime format, NULL if it is none.

    A weekday's name is looked for and taken out first, as any weekday goes with any date; an offset may have a colon or not.
    """
    parts = re.split(r"(?<!%)((?:%%)*)(%[aA])", strftime)
    if len(parts) > 4:
        raise BindError("a strftime format has one weekday at most")
    if len(parts) == 4:
        before, after = parts[0] + parts[1], parts[3]
        names = "|".join(day if parts[2] == "%A" else day[:3] for day in WEEKDAYS)
        shape = f"^(.*?)(?i:{names})(.*)$"
        text = F.when(text.rlike(shape), F.regexp_replace(text, F.lit(shape), F.lit("$1~$2")))
        strftime = f"{before}~{after}"
    pattern = datetime_pattern(strftime)
    offsets = [pattern] + ([pattern.replace("XX", "XXX")] if "%z" in strftime else [])
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in offsets])


class Binder:
    """Binds rules against the columns of one DataFrame. ``sets`` are tables that a rule may name as its value set."""

    def __init__(self, schema: T.StructType, sets: dict[str, DataFrame] | None = None):
        self._types = {f.name: f.dataType for f in schema}
        self._sets = sets or {}
        self._lookups: dict[str, Lookup] = {}

    def bind(self, index: int, rule: Rule) -> BoundRule:
        try:
            mostly = rule.kwargs.get("mostly", 1.0)
            if not isinstance(mostly, (int, float)) or isinstance(mostly, bool) or not 0 <= mostly <= 1:
                raise BindError("mostly must be a number from 0 to 1")
            parts = _BINDERS[rule.expectation_type](self, rule.kwargs)
        except BindError as problem:
            return BoundRule(index, rule, ERROR, error=str(problem))
        except (TypeError, AttributeError, ValueError) as problem:
            return BoundRule(index, rule, ERROR, error=f"unusable arguments: {problem}")
        return BoundRule(index, rule, mostly=float(mostly), **parts)

    # -- helpers ---------------------------------------------------------

    def type_of(self, name) -> T.DataType:
        if not isinstance(name, str) or name not in self._types:
            raise BindError(f"no column {name!r}")
        return self._types[name]

    def column(self, name) -> Column:
        self.type_of(name)
        return F.col(f"`{name}`")

    def columns(self, names) -> list[Column]:
        if not isinstance(names, list) or len(names) < 1:
            raise BindError("column_list must be a list of column names")
        return [self.column(n) for n in names]

    def text(self, name) -> Column:
        if _family(self.type_of(name)) != "text":
            raise BindError(f"column {name!r} is not text")
        return self.column(name)

    def pair(self, kwargs: dict) -> tuple[Column, Column]:
        a, b = kwargs["column_A"], kwargs["column_B"]
        fa, fb = _family(self.type_of(a)), _family(self.type_of(b))
        if fa != fb or fa == "other":
            raise BindError(f"columns {a!r} and {b!r} cannot be compared")
        return self.column(a), self.column(b)

    def bounds(self, kwargs: dict, t: T.DataType) -> Callable[[Column], Column]:
        """The test ``min <= x <= max`` with open sides where a bound is missing."""
        tests = []
        for key, strict, closed_op, strict_op in (
            ("min_value", "strict_min", Column.__ge__, Column.__gt__),
            ("max_value", "strict_max", Column.__le__, Column.__lt__),
        ):
            if kwargs.get(key) is None:
                continue
            bound = _literal(kwargs[key], t)
            if bound is None:
                raise BindError(f"{key} {kwargs[key]!r} cannot be compared with {t.simpleString()}")
            tests.append((strict_op if kwargs.get(strict) else closed_op, bound))
        undefined = any(isinstance(v := kwargs.get(k), float) and math.isnan(v) for k in ("min_value", "max_value"))

        def holds(x: Column) -> Column:
            if undefined:  # nothing compares with NaN, as in Python; for Spark it is the largest number
                return F.when(x.isNotNull(), F.lit(False))
            return functools.reduce(Column.__and__, [op(x, bound) for op, bound in tests])

        return holds

    def members(self, kwargs: dict) -> tuple[Column, Column, tuple[Lookup, ...]]:
        """(is in the set, column, sets to join); members of another type family match nothing.

        A set is a list, or ``{"table": name}`` for the first column of a table given to ``bind_rules``.
        """
        values, column = kwargs["value_set"], kwargs["column"]
        t, c = self.type_of(column), self.column(column)
        if isinstance(values, dict) and list(values) == ["table"]:
            if values["table"] not in self._sets:
                raise BindError(f"no set named {values['table']!r}")
            table = self._sets[values["table"]]
            if _family(table.schema[0].dataType) != _family(t):
                return F.lit(False), c, ()
            return self._lookup(values, column, table)
        if not isinstance(values, list):
            raise BindError("value_set must be a list")
        if len(values) > LARGE:
            return self._lookup(values, column, values)
        literals = [m for v in values if (m := _literal(v, t)) is not None]
        return (c.isin(*literals) if literals else F.lit(False)), c, ()

    def _lookup(self, values, column: str, members) -> tuple[Column, Column, tuple[Lookup, ...]]:
        name = "_in_" + hashlib.sha256(canonical({"column": column, "set": values}).encode()).hexdigest()[:20]
        lookup = self._lookups.setdefault(name, Lookup(name, column, self.type_of(column), members))
        return lookup.inside, self.column(column), (lookup,)


def _row(violated: Column, columns, counted: Column) -> dict:
    return {
        "kind": ROW, "violated": F.coalesce(violated, F.lit(False)), "counted": counted,
        "columns": tuple(columns),
    }


def _not_null(b: Binder, kw: dict) -> dict:
    return _row(b.column(kw["column"]).isNull(), [kw["column"]], F.lit(True))


def _between(b: Binder, kw: dict) -> dict:
    c = b.column(kw["column"])
    return _row(~b.bounds(kw, b.type_of(kw["column"]))(c), [kw["column"]], c.isNotNull())


def _extreme(how: str):
    def bind(b: Binder, kw: dict) -> dict:
        t, c = b.type_of(kw["column"]), b.column(kw["column"])
        if how == "mean":
            if _family(t) != "number":
                raise BindError("a mean needs a numeric column")
            t = T.DoubleType()
            c = c.cast(t)
        return {
            "kind": TABLE, "columns": (kw["column"],),
            "state": TableState(how, c, (kw["column"],), b.bounds(kw, t)),
        }

    return bind


def _in_set(b: Binder, kw: dict) -> dict:
    inside, c, lookups = b.members(kw)
    return {**_row(c.isNotNull() & ~inside, [kw["column"]], c.isNotNull()), "lookups": lookups}


def _not_in_set(b: Binder, kw: dict) -> dict:
    inside, c, lookups = b.members(kw)
    return {**_row(inside, [kw["column"]], c.isNotNull()), "lookups": lookups}


def _distinct_in_set(b: Binder, kw: dict) -> dict:
    inside, c, lookups = b.members(kw)
    # The distinct values lie inside the set exactly when no value lies outside it. NULLs do not
    # count, and a column of nothing but NULLs fails: ``bad`` then stays NULL.
    outside = F.when(c.isNotNull(), F.when(inside, 0).otherwise(1))
    return {
        "kind": TABLE, "columns": (kw["column"],), "lookups": lookups,
        "state": TableState("bad", outside, (kw["column"],), lambda x: x == 0),
    }


def _of_types(b: Binder, column, names: list) -> dict:
    t, c = b.type_of(column), b.column(column)
    for name in names:
        if name not in TYPE_NAMES:
            raise BindError(f"unknown type name {name!r}")
    targets = [target for name in names for target in TYPE_NAMES[name]]
    if t.simpleString() in targets:
        return {"kind": SCHEMA, "passes": True, "columns": (column,)}
    if _family(t) != "text" or not targets:
        return {"kind": SCHEMA, "passes": False, "columns": (column,)}
    fits = [c.try_cast(target).isNotNull() for target in targets]
    return _row(c.isNotNull() & ~functools.reduce(Column.__or__, fits), [column], c.isNotNull())


def _of_type(b: Binder, kw: dict) -> dict:
    return _of_types(b, kw["column"], [kw["type_"]])


def _in_type_list(b: Binder, kw: dict) -> dict:
    if not isinstance(kw["type_list"], list):
        raise BindError("type_list must be a list")
    return _of_types(b, kw["column"], kw["type_list"])


def _regex(b: Binder, kw: dict) -> dict:
    c = b.text(kw["column"])
    try:
        pattern = java_pattern(kw["regex"])
    except UnusablePattern as problem:
        raise BindError(str(problem)) from problem
    problem = _regex_problem(pattern)
    if problem:
        raise BindError(problem)
    return _row(~c.rlike(pattern), [kw["column"]], c.isNotNull())


def _like(b: Binder, kw: dict) -> dict:
    c, pattern = b.text(kw["column"]), kw["like_pattern"]
    if not isinstance(pattern, str) or re.search(r"\\(?![_%\\])", re.sub(r"\\[_%\\]", "", pattern)):
        raise BindError("unusable like_pattern: a backslash stands before _, % or another backslash only")
    return _row(~c.like(pattern), [kw["column"]], c.isNotNull())


def _strftime(b: Binder, kw: dict) -> dict:
    c = b.text(kw["column"])
    return _row(c.isNotNull() & datetime_of(c, kw["strftime_format"]).isNull(), [kw["column"]], c.isNotNull())


def _lengths(b: Binder, kw: dict) -> dict:
    c = b.text(kw["column"])
    return _row(~b.bounds(kw, T.IntegerType())(F.char_length(c)), [kw["column"]], c.isNotNull())


def _unique(b: Binder, kw: dict) -> dict:
    return {
        "kind": KEY, "key": (kw["column"],), "columns": (kw["column"],),
        "counted": b.column(kw["column"]).isNotNull(),
    }


def _compound_unique(b: Binder, kw: dict) -> dict:
    some = functools.reduce(Column.__or__, [c.isNotNull() for c in b.columns(kw["column_list"])])
    return {"kind": KEY, "key": tuple(kw["column_list"]), "columns": tuple(kw["column_list"]), "counted": some}


def _unique_in_record(b: Binder, kw: dict) -> dict:
    names = kw["column_list"]
    cols = b.columns(names)
    same = F.lit(False)
    for i, (name, c) in enumerate(zip(names, cols)):
        for other, d in zip(names[:i], cols[:i]):
            if _family(b.type_of(name)) == _family(b.type_of(other)):
                same = same | c.eqNullSafe(d)
            else:
                same = same | (c.isNull() & d.isNull())
    some = functools.reduce(Column.__or__, [c.isNotNull() for c in cols])
    return _row(same & some, names, some)


def _pair_greater(b: Binder, kw: dict) -> dict:
    x, y = b.pair(kw)
    some = x.isNotNull() | y.isNotNull()
    holds = (x >= y) if kw.get("or_equal") else (x > y)
    return _row(some & ~F.coalesce(holds, F.lit(False)), [kw["column_A"], kw["column_B"]], some)


def _pair_equal(b: Binder, kw: dict) -> dict:
    x, y = b.pair(kw)
    return _row(~x.eqNullSafe(y), [kw["column_A"], kw["column_B"]], x.isNotNull() | y.isNotNull())


def _row_sum(b: Binder, kw: dict) -> dict:
    names, cols = kw["column_list"], b.columns(kw["column_list"])
    if any(_family(b.type_of(n)) != "number" for n in names):
        raise BindError("a row sum needs numeric columns")
    total = kw["sum_total"]
    if not isinstance(total, (int, float)) or isinstance(total, bool):
        raise BindError("sum_total must be a number")
    added = functools.reduce(Column.__add__, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    some = functools.reduce(Column.__or__, [c.isNotNull() for c in cols])
    return _row(some & (added != F.lit(float(total))), names, some)


def _row_count(b: Binder, kw: dict) -> dict:
    return {
        "kind": TABLE, "columns": (),
        "state": TableState("rows", F.lit(1), (), b.bounds(kw, T.LongType())),
    }


_BINDERS: dict[str, Callable[[Binder, dict], dict]] = {
    "expect_column_values_to_not_be_null": _not_null,
    "expect_column_values_to_be_between": _between,
    "expect_column_min_to_be_between": _extreme("min"),
    "expect_column_max_to_be_between": _extreme("max"),
    "expect_column_mean_to_be_between": _extreme("mean"),
    "expect_column_values_to_be_in_set": _in_set,
    "expect_column_values_to_not_be_in_set": _not_in_set,
    "expect_column_distinct_values_to_be_in_set": _distinct_in_set,
    "expect_column_values_to_be_of_type": _of_type,
    "expect_column_values_to_be_in_type_list": _in_type_list,
    "expect_column_values_to_match_regex": _regex,
    "expect_column_values_to_match_like_pattern": _like,
    "expect_column_values_to_match_strftime_format": _strftime,
    "expect_column_value_lengths_to_be_between": _lengths,
    "expect_column_values_to_be_unique": _unique,
    "expect_compound_columns_to_be_unique": _compound_unique,
    "expect_select_column_values_to_be_unique_within_record": _unique_in_record,
    "expect_column_pair_values_a_to_be_greater_than_b": _pair_greater,
    "expect_column_pair_values_to_be_equal": _pair_equal,
    "expect_multicolumn_sum_to_equal": _row_sum,
    "expect_table_row_count_to_be_between": _row_count,
}


def bind_rules(rules: list[Rule], df: DataFrame, sets: dict[str, DataFrame] | None = None) -> list[BoundRule]:
    """Rules bound to the columns of ``df``; ``sets`` names tables that value sets may refer to."""
    binder = Binder(df.schema, sets)
    return [binder.bind(i, r) for i, r in enumerate(rules)]


