"""The rule vocabulary: 21 rule types and the keyword arguments they accept."""

from __future__ import annotations

import json
from dataclasses import dataclass

VALID = "valid"
JSON_ERROR = "json_error"
UNKNOWN = "unknown_expectation"
BAD_KWARGS = "invalid_kwargs"
RUNTIME_ERROR = "runtime_error"
STATUSES = [VALID, JSON_ERROR, UNKNOWN, BAD_KWARGS, RUNTIME_ERROR]


@dataclass(frozen=True)
class RuleSpec:
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()  # at least one of these

    @property
    def accepted(self) -> tuple[str, ...]:
        return self.required + self.optional + self.any_of + ("mostly", "strict_min", "strict_max")


BOUNDS = ("min_value", "max_value")

# Rule type names and argument names.
RULE_SPECS: dict[str, RuleSpec] = {
    "expect_column_values_to_not_be_null": RuleSpec(("column",)),
    "expect_column_values_to_be_between": RuleSpec(("column",), any_of=BOUNDS),
    "expect_column_min_to_be_between": RuleSpec(("column",), any_of=BOUNDS),
    "expect_column_max_to_be_between": RuleSpec(("column",), any_of=BOUNDS),
    "expect_column_mean_to_be_between": RuleSpec(("column",), any_of=BOUNDS),
    "expect_column_values_to_be_in_set": RuleSpec(("column", "value_set")),
    "expect_column_values_to_not_be_in_set": RuleSpec(("column", "value_set")),
    "expect_column_distinct_values_to_be_in_set": RuleSpec(("column", "value_set")),
    "expect_column_values_to_be_of_type": RuleSpec(("column", "type_")),
    "expect_column_values_to_be_in_type_list": RuleSpec(("column", "type_list")),
    "expect_column_values_to_match_regex": RuleSpec(("column", "regex")),
    "expect_column_values_to_match_like_pattern": RuleSpec(("column", "like_pattern")),
    "expect_column_values_to_match_strftime_format": RuleSpec(("column", "strftime_format")),
    "expect_column_value_lengths_to_be_between": RuleSpec(("column",), any_of=BOUNDS),
    "expect_column_values_to_be_unique": RuleSpec(("column",)),
    "expect_compound_columns_to_be_unique": RuleSpec(("column_list",)),
    "expect_select_column_values_to_be_unique_within_record": RuleSpec(("column_list",)),
    "expect_column_pair_values_a_to_be_greater_than_b": RuleSpec(
        ("column_A", "column_B"), optional=("or_equal",)
    ),
    "expect_column_pair_values_to_be_equal": RuleSpec(("column_A", "column_B")),
    "expect_multicolumn_sum_to_equal": RuleSpec(("column_list", "sum_total")),
    "expect_table_row_count_to_be_between": RuleSpec((), any_of=BOUNDS),
}


class UnknownRule(ValueError):
    """The rule type is not in the vocabulary."""


class BadKwargs(ValueError):
    """The rule type does not take these keyword arguments."""


@dataclass(frozen=True)
class Rule:
    expectation_type: str
    kwargs_json: str
    rationale: str = ""

    @property
    def kwargs(self) -> dict:
        return json.loads(self.kwargs_json)


def canonical(kwargs: dict) -> str:
    """JSON text that does not depend on the order the arguments were given in."""
    return json.dumps(kwargs, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def rule(expectation_type: str, rationale: str = "", **kwargs) -> Rule:
    """Check a rule against the vocabulary and build it."""
    spec = RULE_SPECS.get(expectation_type)
    if spec is None:
        raise UnknownRule(expectation_type)
    unknown = sorted(set(kwargs) - set(spec.accepted))
    missing = sorted(set(spec.required) - set(kwargs))
    if unknown or missing:
        raise BadKwargs(f"{expectation_type}: unknown {unknown}, missing {missing}")
    if spec.any_of and not set(spec.any_of) & {k for k, v in kwargs.items() if v is not None}:
        raise BadKwargs(f"{expectation_type}: needs one of {list(spec.any_of)}")
    return Rule(expectation_type, canonical(kwargs), rationale)


def is_allowed(expectation_type: str) -> bool:
    return expectation_type in RULE_SPECS


def build_rules(records: list[dict]) -> list[Rule]:
    """Rules from plain records; records outside the vocabulary are skipped."""
    rules = []
    for record in records:
        kwargs = record.get("kwargs") or {}
        if isinstance(kwargs, str):
            kwargs = json.loads(kwargs)
        try:
            rules.append(rule(record["expectation_type"], record.get("rationale") or "", **kwargs))
        except (UnknownRule, BadKwargs):
            continue
    return rules
