"""SQL text for the evaluation grid: every variant as a full frame, every rule on every row of it.

The engine never does it this way; that is the point of comparing with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from rowassay.catalog import sqltext
from rowassay.catalog.injections import COLUMNS, PLANNED, SEEDS, _planned_slices
from rowassay.catalog.suites import COLUMNS as PROFILED
from rowassay.catalog.suites import FLAGGED
from rowassay.catalog.views import SQL


@dataclass(frozen=True)
class SqlRule:
    """``flag``: predicate of a flagged row; ``holds``: success of a table rule; neither: cannot run."""

    flag: str | None = None
    holds: str | None = None
    exists: str = "true"


@dataclass(frozen=True)
class SqlSuite:
    method: str
    condition: str
    rules: tuple[SqlRule, ...]
    redundancy: int = 0
    counts: tuple[int, int, int, int] | None = None  # valid, json_error, unknown_expectation, invalid_kwargs
    costs: tuple[str, str, str] = ("NULL", "NULL", "NULL")


def human_rules(table: str) -> tuple[SqlRule, ...]:
    return tuple(SqlRule(p.replace("PARTITION BY ", "PARTITION BY vid, ")) for p in FLAGGED[table])


_EXTRA = {"lineitem_rcv": [("l_receiptdate", "t")], "events_trip": [("start", "t"), ("end", "t")]}
_SOURCE = {"lineitem_rcv": "lineitem", "events_trip": "events"}


def profiled_rules(source: str) -> tuple[SqlRule, ...]:
    """The profile of the clean view ``b`` as predicates; a rule exists only where the data says so."""
    rules = []
    for column, kind in PROFILED[_SOURCE.get(source, source)] + _EXTRA.get(source, []):
        c = f'"{column}"'
        one = f"(SELECT {{}} FROM b)"
        rules.append(SqlRule(f"{c} IS NULL", exists=one.format(f"count(*) = count({c})")))
        if kind in "if":
            rules.append(SqlRule(
                f"{c} < {one.format(f'min({c})')} OR {c} > {one.format(f'max({c})')}", exists=one.format(f"count({c}) > 0")))
        rules.append(SqlRule(
            f"{c} IS NOT NULL AND count(*) OVER (PARTITION BY vid, {c}) > 1",
            exists=one.format(f"count(*) = count(DISTINCT {c}) + least(1, count(*) - count({c}))")))
        if kind != "f":
            rules.append(SqlRule(
                f"{c} IS NOT NULL AND {c} NOT IN (SELECT {c} FROM b WHERE {c} IS NOT NULL)",
                exists=one.format(f"count(DISTINCT {c}) BETWEEN 1 AND 20")))
        if kind == "s":
            rules.append(SqlRule(
                f"length({c}) < {one.format(f'min(length({c}))')} OR length({c}) > {one.format(f'max(length({c}))')}",
                exists=one.format(f"count({c}) > 0")))
    return tuple(rules)


def grid_items(table: str, suites: list[SqlSuite]) -> list[str]:
    """WITH items ending in ``clean_facts`` and ``detection_facts``."""
    source = PLANNED[table]
    cols = ", ".join(f'"{c}"' for c in COLUMNS[source])
    items = [sqltext.ranked(SQL[source], SEEDS + [s + 1000 for s in SEEDS])]
    frames = [f"SELECT -1 AS vid, _row_id, {cols}, NULL AS lab FROM r"]
    variants = []
    for i, (error, rate, seed, slices) in enumerate(_planned_slices(table)):
        more, last = sqltext.chain(f"v{i}", slices)
        items += more
        inplace = [s for s in slices if s.injector.column is not None]
        lab = "CASE " + " ".join(f"WHEN {sqltext._hit(s)} THEN '{s.injector.error_type}'" for s in inplace) + " END" if inplace else "NULL"
        frames.append(f"SELECT {i} AS vid, _row_id, {cols}, {lab} AS lab FROM {last}")
        for s in slices:
            if s.injector.column is None:
                frames.append(
                    f"SELECT {i}, (SELECT max(_row_id) + 1 FROM b) + _row_id, {cols}, 'duplicate_row' FROM {last} WHERE {sqltext._hit(s)}")
        value = "CAST(NULL AS DOUBLE)" if rate is None else f"CAST({rate} AS DOUBLE)"
        variants.append(f"SELECT {i} AS vid, '{error}' AS vtype, {value} AS rate, {seed} AS seed")
    items.append(f"frames AS MATERIALIZED ({' UNION ALL '.join(frames)})")
    items.append(f"variants AS ({' UNION ALL '.join(variants)})")

    flags, holds = {}, {}
    for suite in suites:
        for r in suite.rules:
            if r.flag is not None:
                flags.setdefault((r.flag, r.exists), f"h{len(flags)}")
            elif r.holds is not None:
                holds.setdefault(r.holds, f"t{len(holds)}")
    hit_cols = ", ".join(f"coalesce(({f}) AND {e}, false) AS {n}" for (f, e), n in flags.items())
    items.append(f"hits AS MATERIALIZED (SELECT vid, lab, {hit_cols} FROM frames)")
    any_of = []
    for s, suite in enumerate(suites):
        names = sorted({flags[r.flag, r.exists] for r in suite.rules if r.flag is not None})
        any_of.append(f"({' OR '.join(names) if names else 'false'}) AS s{s}")
    sums = ", ".join(f"bool_or({n}) AS any_{n}" for n in flags.values())
    per_suite = ", ".join(
        f"count(*) FILTER (s{s}) AS f{s}, count(*) FILTER (s{s} AND lab IS NOT NULL) AS tp{s}" for s in range(len(suites)))
    items.append(f"marked AS (SELECT *, {', '.join(any_of)} FROM hits)")
    items.append(f"sums AS MATERIALIZED (SELECT vid, count(*) AS n, count(lab) AS inj, {sums}, {per_suite} FROM marked GROUP BY vid)")
    if holds:
        tests = ", ".join(f"coalesce({h}, false) AS {n}" for h, n in holds.items())
        items.append(f"tests AS (SELECT vid, {tests} FROM frames GROUP BY vid)")
    else:
        items.append("tests AS (SELECT DISTINCT vid FROM frames)")
    by_lab = ", ".join(f"count(*) FILTER (s{s}) AS f{s}" for s in range(len(suites)))
    items.append(f"labs AS (SELECT vid, lab, count(*) AS inj, {by_lab} FROM marked WHERE lab IS NOT NULL GROUP BY vid, lab)")

    clean, found = [], []
    for s, suite in enumerate(suites):
        head = (
            f"SELECT '{suite.method}' AS model, '{table}' AS dataset, '{suite.condition}' AS condition, 0 AS repetition, "
            f"'{suite.method}' AS method"
        )
        size, failed, errors = [], [], 0
        for r in suite.rules:
            if r.flag is not None:
                n = flags[r.flag, r.exists]
                size.append(f"CAST({r.exists} AS INTEGER)")
                failed.append(f"CAST(any_{n} AS INTEGER)")
            elif r.holds is not None:
                size.append("1")
                failed.append(f"CAST(NOT {holds[r.holds]} AS INTEGER)")
            else:
                size.append("1")
                errors += 1
        size_sql, failed_sql = " + ".join(size) or "0", " + ".join(failed) or "0"
        values = [
            ("suite_size", f"({size_sql})"), ("redundancy", str(suite.redundancy)),
            ("fp_rate_rules", f"({failed_sql}) / nullif(CAST({size_sql} AS DOUBLE), 0)"),
            ("fp_rate_rows", f"f{s} / CAST(n AS DOUBLE)"), ("n_runtime_errors", str(errors)),
        ]
        if suite.counts is not None:
            total = sum(suite.counts)
            values += [
                ("executability", f"{suite.counts[0] - errors} / nullif(CAST({total} AS DOUBLE), 0)"), ("n_rules_total", str(total)),
                *zip(("n_valid", "n_json_error", "n_unknown_expectation", "n_invalid_kwargs"), map(str, suite.counts)),
                *zip(("prompt_tokens", "completion_tokens", "latency_s"), suite.costs),
            ]
        for metric, value in values:
            clean.append(
                f"{head}, 'overall' AS error_type, CAST(NULL AS DOUBLE) AS rate, NULL AS seed, '{metric}' AS metric, "
                f"CAST({value} AS DOUBLE) AS value FROM sums JOIN tests USING (vid) WHERE vid = -1"
            )
        p, r = f"tp{s} / nullif(CAST(f{s} AS DOUBLE), 0)", f"tp{s} / nullif(CAST(inj AS DOUBLE), 0)"
        f1 = f"CASE WHEN ({p}) + ({r}) = 0 THEN 0.0 ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END"
        for metric, value in (
            ("precision", p), ("recall", r), ("f1", f1), ("dataset_detected", f"CAST(({failed_sql}) > 0 AS INTEGER)"),
        ):
            found.append(
                f"{head}, vtype AS error_type, rate, seed, '{metric}' AS metric, CAST({value} AS DOUBLE) AS value "
                "FROM sums JOIN variants USING (vid) JOIN tests USING (vid)"
            )
        found.append(
            f"{head}, lab AS error_type, rate, seed, 'recall_by_type' AS metric, f{s} / CAST(inj AS DOUBLE) AS value "
            "FROM labs JOIN variants USING (vid)"
        )
    items.append(f"clean_facts AS ({' UNION ALL '.join(clean)})")
    items.append(f"detection_facts AS ({' UNION ALL '.join(found)})")
    return items


def grid_sql(table: str, suites: list[SqlSuite], facts: str = "both") -> str:
    select = {
        "clean": "SELECT * FROM clean_facts", "detection": "SELECT * FROM detection_facts",
        "both": "SELECT * FROM clean_facts UNION ALL SELECT * FROM detection_facts",
    }[facts]
    return f"WITH {', '.join(grid_items(table, suites))} {select}"
