"""SQL text for corrupted variants: the same contract written a second way, for comparison only.

Rows are numbered per seed in md5 order; parts of a variant are applied one after the other, each
reading the frame the previous one left.
"""

from __future__ import annotations

from dataclasses import dataclass

from rowassay.operators.inject import Injector

TOKENS = "['not_a_value', '2024-13-45', '??', '1e999x']"


@dataclass(frozen=True)
class Slice:
    """Part of a variant: an injector on the rows ranked (skip, skip + count] in a seed's order."""

    injector: Injector
    rate: float
    label_seed: int
    order_seed: int
    skip: str
    count: str


def count_of(rate: float) -> str:
    return f"CAST(round_even((SELECT count(*) FROM b) * CAST({rate} AS DOUBLE), 0) AS BIGINT)"


def single_slices(inj: Injector, rate: float, seed: int) -> list[Slice]:
    return [Slice(inj, rate, seed, seed, "0", count_of(rate))]


def mixed_slices(plan: list[tuple[Injector, float]], seed: int) -> list[Slice]:
    out, skip = [], "0"
    for i, (inj, rate) in enumerate(p for p in plan if p[0].column is not None):
        out.append(Slice(inj, rate, seed + i + 1, seed, skip, count_of(rate)))
        skip = f"{skip} + {count_of(rate)}"
    for j, (inj, rate) in enumerate(p for p in plan if p[0].column is None):
        out.append(Slice(inj, rate, seed + 1000 + j, seed + 1000 + j, "0", count_of(rate)))
    return out


def ranked(view: str, seeds: list[int]) -> str:
    """WITH items: b (the view) and r (with a rank column per seed)."""
    ranks = ", ".join(
        f"row_number() OVER (ORDER BY md5('{s}:' || _row_id), _row_id) AS r{s}" for s in sorted(set(seeds))
    )
    return f"b AS ({view}), r AS MATERIALIZED (SELECT *, {ranks} FROM b)"


def _given(inj: Injector, name: str, default):
    """A setting with the default stated here, not the engine's."""
    return dict(inj.options).get(name, default)


#: Text columns that a sentinel is put into.
TEXT = {"o_orderpriority", "o_orderstatus"}


def _q(column: str) -> str:
    return f'"{column}"'


def _hit(s: Slice) -> str:
    return f"(r{s.order_seed} > {s.skip} AND r{s.order_seed} <= {s.skip} + {s.count})"


def _value(s: Slice, frame: str) -> str:
    inj, c = s.injector, _q(s.injector.column)
    kind = inj.error_type
    if kind == "missing_value":
        return "NULL"
    if kind == "out_of_range":
        span = f"(SELECT CASE WHEN max({c}) = min({c}) THEN 1.0 ELSE max({c}) - min({c}) END FROM {frame})"
        if _given(inj, "mode", "high") == "low":
            return f"(SELECT min({c}) FROM {frame}) - 100 * {span}"
        return f"(SELECT max({c}) FROM {frame}) + 100 * {span}"
    if kind == "type_or_format_error":
        return f"{TOKENS}[('0x' || substr(md5('{s.label_seed + 1}:' || _row_id), 1, 8))::BIGINT % 4 + 1]"
    if kind == "invalid_category":
        value = _given(inj, "invalid_value", 999)
        return f"'{value}'" if isinstance(value, str) or inj.column in TEXT else str(value)
    if kind == "referential_integrity":
        return "-(_row_id + 1)"
    if kind == "distribution_shift":
        return f"{c} * CAST({_given(inj, 'scale', 3.0)} AS DOUBLE) + CAST({_given(inj, 'shift', 0.0)} AS DOUBLE)"
    if _given(inj, "kind", "temporal") == "temporal":
        return f"{_q(inj.get('start_col'))} - INTERVAL 1 HOUR"
    parts = [f"coalesce({_q(p)}, 0)" for p in inj.get("component_cols")]
    return f"{' + '.join(parts)} + CAST(100 AS DOUBLE)"


def chain(name: str, slices: list[Slice], start: str = "r") -> tuple[list[str], str]:
    """WITH items that apply the in-place slices in turn, and the name of the last one."""
    items, frame = [], start
    for i, s in enumerate(x for x in slices if x.injector.column is not None):
        c = _q(s.injector.column)
        before = f"CAST({c} AS VARCHAR)" if s.injector.error_type == "type_or_format_error" else c
        items.append(
            f"{name}_{i} AS (SELECT * REPLACE (CASE WHEN {_hit(s)} THEN {_value(s, frame)} ELSE {before} END AS {c}) "
            f"FROM {frame})"
        )
        frame = f"{name}_{i}"
    return items, frame


def rows(name: str, slices: list[Slice], columns: list[str], extra: str = "") -> tuple[list[str], str]:
    """WITH items, and a SELECT of the corrupted table: row id, columns, and ``extra`` constants."""
    items, last = chain(name, slices)
    cols = ", ".join(_q(c) for c in columns)
    selects = [f"SELECT {extra}_row_id, {cols} FROM {last}"]
    for j, s in enumerate(x for x in slices if x.injector.column is None):
        selects.append(
            f"SELECT {extra}{j + 1} * (SELECT max(_row_id) + 1 FROM b) + _row_id, {cols} FROM {last} WHERE {_hit(s)}"
        )
    return items, " UNION ALL ".join(selects)


NUMERIC = {"o_totalprice", "o_custkey", "c_acctbal", "l_quantity", "l_orderkey", "l_extendedprice", "total", "value", "user_id"}
TEMPORAL = {"l_receiptdate", "end"}


def labels(name: str, slices: list[Slice], dataset: str, extra: str = "") -> tuple[list[str], str]:
    """WITH items, and a SELECT of labels: numbers as numbers, everything else as text."""
    items, _ = chain(name, slices)
    selects, at = [], 0
    frame = "r"
    for s in slices:
        inj = s.injector
        dims = f"'{inj.error_type}' AS error_type, CAST({s.rate} AS DOUBLE) AS rate, {s.label_seed} AS seed, '{dataset}' AS dataset"
        if inj.column is None:
            selects.append(
                f"SELECT {extra}(SELECT max(_row_id) + 1 FROM b) + _row_id AS _row_id, NULL AS \"column\", {dims}, "
                f"CAST(_row_id AS DOUBLE) AS original_number, NULL AS original_text, NULL AS corrupted_number, "
                f"NULL AS corrupted_text FROM r WHERE {_hit(s)}"
            )
            continue
        c, new = _q(inj.column), _value(s, frame)
        if inj.column in NUMERIC:
            values = (
                f"CAST({c} AS DOUBLE) AS original_number, NULL AS original_text, "
                f"CAST({new} AS DOUBLE) AS corrupted_number, NULL AS corrupted_text"
            )
        elif inj.column in TEMPORAL:
            f = "'%Y-%m-%d %H:%M:%S.%f'"
            values = (
                f"NULL AS original_number, strftime({c}, {f}) AS original_text, "
                f"NULL AS corrupted_number, strftime({new}, {f}) AS corrupted_text"
            )
        else:
            values = f"NULL AS original_number, {c} AS original_text, NULL AS corrupted_number, {new} AS corrupted_text"
        selects.append(
            f"SELECT {extra}_row_id, '{inj.column}' AS \"column\", {dims}, {values} FROM {frame} WHERE {_hit(s)}"
        )
        frame = f"{name}_{at}"
        at += 1
    return items, " UNION ALL ".join(selects)
