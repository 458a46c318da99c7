"""What suites say of a table, with the rules of all suites judged together.

Rules are told apart by type and arguments, so one that several suites share is judged once. Verdicts on a row travel as bits of
a few numbers, and rows with the same verdicts are counted together.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowassay.operators.bind import ERROR, KEY, ROW, SCHEMA, TABLE, BoundRule, bind_rules
from rowassay.operators.metrics import FACT_COLUMNS
from rowassay.operators.rules import Rule
from rowassay.operators.validate import by_key

FACT_SCHEMA = (
    "model string, dataset string, condition string, repetition int, method string, error_type string, "
    "rate double, seed bigint, metric string, value double"
)
WORD = 60  # verdict bits per number

@dataclass(frozen=True)
class Suite:
    method: str
    condition: str
    repetition: int
    rules: tuple[Rule, ...]
    counts: dict[str, int] | None = None  # generated suites: rules per parse status
    costs: dict[str, float] = field(default_factory=dict)

    def dims(self, table_id: str) -> dict:
        return {
            "model": self.method, "dataset": table_id, "condition": self.condition, "repetition": self.repetition, "method": self.method,
        }


def fused(suites: Iterable[Suite]) -> tuple[list[Rule], list[list[int]]]:
    """The different rules of all suites, and for each suite the numbers of its rules."""
    index: dict[tuple[str, str], int] = {}
    rules: list[Rule] = []
    numbers = []
    for suite in suites:
        for r in suite.rules:
            if (r.expectation_type, r.kwargs_json) not in index:
                index[r.expectation_type, r.kwargs_json] = len(rules)
                rules.append(r)
        numbers.append([index[r.expectation_type, r.kwargs_json] for r in suite.rules])
    return rules, numbers


@dataclass
class Tally:
    """Counts of one frame: the clean table or one variant."""

    n: int = 0
    unexpected: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    counted: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    flagged: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    labelled: dict[str, int] = field(default_factory=lambda: defaultdict(int))
    found: dict[tuple[str, int], int] = field(default_factory=lambda: defaultdict(int))
    states: dict[int, tuple] = field(default_factory=dict)

    def copy(self) -> Tally:
        new = Tally(self.n, states=dict(self.states))
        new.unexpected.update(self.unexpected)
        new.counted.update(self.counted)
        new.flagged.update(self.flagged)
        return new


def state_columns(how: str, value: Column, name: str, is_time: bool) -> list[Column]:
    """Mergeable statistics of a TABLE rule over ``value``."""
    if how == "mean":
        return [F.sum(value).alias(f"{name}_a"), F.count(value).alias(f"{name}_b")]
    if how in ("min", "max"):
        best = F.min(value) if how == "min" else F.max(value)
        # Times travel as text, so the client's time zone does not matter; the order is the same.
        return [(best.cast("string") if is_time else best).alias(f"{name}_a")]
    return [(F.sum(value) if how == "bad" else F.count(value)).alias(f"{name}_a")]


def merge(how: str, x: tuple | None, y: tuple | None) -> tuple:
    if x is None or x[0] is None:
        return y if y is not None else (None,)
    if y is None or y[0] is None:
        return x
    if how == "min":
        return (min(x[0], y[0]),)
    if how == "max":
        return (max(x[0], y[0]),)
    return tuple(a + b for a, b in zip(x, y))


def any_of(flags: list[Column]) -> Column:
    return functools.reduce(Column.__or__, flags) if flags else F.lit(False)


class Judge:
    """Fused rules bound to the columns of a table. ``suites`` lists the numbers of each suite's rules."""

    def __init__(self, base: DataFrame, rules: list[Rule], suites: list[list[int]]):
        self.base, self.suites = base, suites
        self.bound = bind_rules(rules, base)
        self.flagging = [b for b in self.bound if b.kind in (ROW, KEY)]
        self.tables = [b for b in self.bound if b.kind == TABLE]
        self.keys = list(by_key(self.bound).items())

    def _flags(self, violated: dict[int, Column]) -> list[Column]:
        return [any_of([violated[i] for i in sorted(set(s)) if i in violated]) for s in self.suites]

    # -- verdicts as bits ------------------------------------------------------

    def _bits(self) -> list[tuple[str, int]]:
        """What each bit stands for: rule i is violated (u), or counts the row for its tolerance (c)."""
        return [("u", b.index) for b in self.flagging] + [("c", b.index) for b in self.flagging if b.mostly < 1]

    def _words(self) -> int:
        return -(-len(self._bits()) // WORD)

    def _place(self, kind: str, index: int) -> tuple[int, int]:
        return divmod(self._bits().index((kind, index)), WORD)

    def _bit(self, side: str, kind: str, index: int) -> Column:
        word, at = self._place(kind, index)
        return F.col(f"{side}{word}").bitwiseAND(F.lit(1 << at).cast("bigint")) != 0

    def _row_bits(self, side: str) -> dict[str, Column]:
        """Words with the bits that depend on the row alone."""
        words = {f"{side}{w}": F.lit(0).cast("bigint") for w in range(self._words())}
        for b in self.flagging:
            for kind, flag in (("u", b.violated), ("c", b.counted if b.mostly < 1 else None)):
                if flag is not None:
                    word, at = self._place(kind, b.index)
                    bit = F.when(flag, F.lit(1 << at).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
                    words[f"{side}{word}"] = words[f"{side}{word}"].bitwiseOR(bit)
        return words

    def _key_bits(self, word: int, side: str) -> Column:
        """The bits of a word that depend on repeated keys."""
        bits = F.lit(0).cast("bigint")
        for j, (_, rules) in enumerate(self.keys):
            mask = sum(1 << self._place("u", r.index)[1] for r in rules if self._place("u", r.index)[0] == word)
            if mask:
                bits = bits.bitwiseOR(F.when(F.col(f"{side}{j}"), F.lit(mask).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return bits

    # -- verdicts ------------------------------------------------------------------

    def verdicts(self, tallies: list[Tally]) -> list[dict[int, bool | None]]:
        """Per frame: rule -> passed, failed, or None when it could not run."""
        out = [{} for _ in tallies]
        tests, where = [], []
        for at, tally in enumerate(tallies):
            for b in self.bound:
                if b.kind == ERROR:
                    out[at][b.index] = None
                elif b.kind == SCHEMA:
                    out[at][b.index] = b.passes
                elif b.kind == TABLE:
                    tests.append(b.state.holds(self._state_literal(b, tally.states[b.index])))
                    where.append((at, b.index))
                else:
                    u, c = tally.unexpected[b.index], tally.counted[b.index]
                    out[at][b.index] = u == 0 if b.mostly >= 1 else c == 0 or 1 - u / c >= b.mostly
        if tests:
            spark = self.base.sparkSession
            names = [F.coalesce(t, F.lit(False)).alias(f"x{i}") for i, t in enumerate(tests)]
            for (at, index), passed in zip(where, spark.range(1).select(*names).first()):
                out[at][index] = passed
        return out

    def _state_literal(self, b: BoundRule, state: tuple) -> Column:
        value = state[0]
        if b.state.how == "mean" and value is not None:
            value = value / state[1] if state[1] else None
        kind = "double" if b.state.how == "mean" else "bigint"
        if b.state.how in ("min", "max"):
            kind = self.base.schema[b.columns[0]].dataType.simpleString()
        return F.lit(value).cast(kind)

    def _is_time(self, b: BoundRule) -> bool:
        types = {f.name: f.dataType for f in self.base.schema}
        return any(isinstance(types[c], (T.TimestampType, T.TimestampNTZType, T.DateType)) for c in b.columns)


def ratio_of(part, whole) -> float | None:
    return part / whole if whole else None


def detection_facts(
    suites: list[Suite], numbers: list[list[int]], table_id: str, judged: Iterable[tuple[str, float | None, int, Tally, dict]]
) -> list[dict]:
    """Facts of suites on variants: ``judged`` has error type, rate, seed, tally and verdicts of each variant."""
    judged, facts = list(judged), []
    for s, suite in enumerate(suites):
        for error_type, rate, seed, tally, passed in judged:
            hits = sum(tally.found[e, s] for e in tally.labelled)
            precision, recall = ratio_of(hits, tally.flagged[s]), ratio_of(hits, sum(tally.labelled.values()))
            f1 = None
            if precision is not None and recall is not None:
                f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
            detected = any(passed[i] is False for i in numbers[s])
            values = [(error_type, "precision", precision), (error_type, "recall", recall), (error_type, "f1", f1), (error_type, "dataset_detected", int(detected))]
            values += [(e, "recall_by_type", ratio_of(tally.found[e, s], k)) for e, k in sorted(tally.labelled.items())]
            facts += [
                {**suite.dims(table_id), "error_type": e, "rate": rate, "seed": seed, "metric": m, "value": v} for e, m, v in values
            ]
    return facts


def facts_frame(spark: SparkSession, facts: list[dict]) -> DataFrame:
    """Facts as a table: a few rows per suite and variant, however large the data."""
    rows = [
        tuple(None if (v := f.get(c)) is None else float(v) if c in ("value", "rate") else v for c in FACT_COLUMNS)
        for f in facts
    ]
    return spark.createDataFrame(rows, FACT_SCHEMA)
