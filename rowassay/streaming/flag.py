"""Row rules over a stream: the same compiled columns, no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rowassay.operators.bind import ERROR, ROW, SCHEMA, bind_rules
from rowassay.operators.rules import Rule
from rowassay.operators.validate import flags, require_row_id


class StatefulRule(ValueError):
    """The rule needs to see the whole table."""


def flag_stream(stream: DataFrame, rules: list[Rule]) -> DataFrame:
    """(row id, rule) hits of a streaming table that carries row ids."""
    require_row_id(stream)
    bound = bind_rules(rules, stream)
    stateful = [b.rule.expectation_type for b in bound if b.kind not in (ROW, SCHEMA, ERROR)]
    if stateful:
        raise StatefulRule(f"not row rules: {stateful}")
    return flags(stream, [b for b in bound if b.kind == ROW])
