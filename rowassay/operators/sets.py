"""Value sets as tables: a large set meets the column in one left join instead of standing in the plan as literals."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowassay.session import materialize

#: Sets of more members than this become tables.
LARGE = 1000
_MEMBER = "_member"


def _kind(t: T.DataType) -> str | None:
    """The type that members and column are compared in."""
    if isinstance(t, T.IntegralType):
        return "bigint"
    if isinstance(t, T.NumericType):
        return "double"
    if isinstance(t, (T.StringType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return t.simpleString()
    return None


def _listed(values: Iterable, kind: str) -> set:
    """The members that a column of this kind can have at all, each once."""
    found = set()
    for v in values:
        number = isinstance(v, (int, float)) and not isinstance(v, bool)
        if kind == "bigint" and number and (isinstance(v, int) or v.is_integer()) and -(2**63) <= v < 2**63:
            found.add(int(v))
        elif kind == "double" and number and v == v and abs(v) < 2**1023:
            found.add(float(v))
        elif kind == "boolean" and isinstance(v, bool) or kind == "string" and isinstance(v, str):
            found.add(v)
        elif kind in ("timestamp", "timestamp_ntz", "date") and isinstance(v, str):
            try:
                moment = datetime.fromisoformat(v)
            except ValueError:
                continue
            moment = moment.replace(tzinfo=None) if kind == "timestamp_ntz" else moment
            found.add(moment.isoformat(sep=" ", timespec="microseconds"))
    return found


class Lookup:
    """A set joined as a table; ``inside`` is the column that ``with_sets`` adds, true where the value is a member.

    The members are written once, so Spark knows their exact size and decides by its own threshold whether to broadcast them;
    a larger set is joined by shuffle, where AQE splits a value that many rows share.
    """

    def __init__(self, name: str, column: str, t: T.DataType, members: list | DataFrame):
        self.name, self.column, self.kind, self.members = name, column, _kind(t), members
        self._written: DataFrame | None = None

    @property
    def inside(self) -> Column:
        return F.col(self.name)

    def _table(self, spark: SparkSession) -> DataFrame:
        if self._written is None:
            if isinstance(self.members, DataFrame):
                first = self.members.columns[0]
                members = self.members.select(F.col(f"`{first}`").try_cast(self.kind).alias(_MEMBER)).filter(F.col(_MEMBER).isNotNull()).distinct()
            else:
                text = self.kind not in ("bigint", "double", "boolean")
                rows = [(v,) for v in sorted(_listed(self.members, self.kind))]
                members = spark.createDataFrame(rows, f"{_MEMBER} {'string' if text else self.kind}")
                members = members.select(F.col(_MEMBER).cast(self.kind).alias(_MEMBER)).distinct()
            self._written = materialize(members, "set")
        return self._written

    def mark(self, df: DataFrame) -> DataFrame:
        if self.kind is None:
            return df.withColumn(self.name, F.lit(False))
        members = self._table(df.sparkSession)
        marked = df.join(members, F.col(f"`{self.column}`").cast(self.kind) == F.col(_MEMBER), "left")
        return marked.withColumn(self.name, F.col(_MEMBER).isNotNull()).drop(_MEMBER)


def with_sets(df: DataFrame, bound: Iterable) -> DataFrame:
    """``df`` with a column for each set of the bound rules that is a table; rules that share a set share the join."""
    lookups = {lookup.name: lookup for b in bound for lookup in b.lookups}
    for name, lookup in lookups.items():
        if name not in df.columns:
            df = lookup.mark(df)
    return df
