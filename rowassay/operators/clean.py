"""Cleaning with an audit trail: every step says how many rows it saw and removed."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowassay import ROW_ID
from rowassay.session import materialize

AUDIT_COLUMNS = ["dataset", "step", "name", "description", "rule", "rows_before", "rows_after", "rows_removed"]


@dataclass(frozen=True)
class Check:
    """One cleaning predicate; a row stays when ``keep`` is true (NULL counts as false)."""

    name: str
    description: str
    keep: Column
    rule: str = ""


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(3.6e9)


def first_failed(checks: list[Check]) -> Column:
    """Position of the first check the row fails; NULL when it passes all."""
    return F.coalesce(*[F.when(~F.coalesce(c.keep, F.lit(False)), F.lit(i)) for i, c in enumerate(checks)])


def clean_rows(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Rows that pass every check; plain filters, so what can be pushed to the scan is."""
    return functools.reduce(lambda d, c: d.filter(F.coalesce(c.keep, F.lit(False))), checks, df)


def clean_audit(df: DataFrame, checks: list[Check], dataset: str = "") -> DataFrame:
    """The trail of ``clean_rows``: one pass, whatever the number of checks."""
    counts = df.select(first_failed(checks).alias("_at")).agg(
        F.count("*").alias("_n"), *[F.count_if(F.col("_at") == i).alias(f"_f{i}") for i in range(len(checks))]
    )
    rows, before = [], F.col("_n")
    for i, check in enumerate(checks):
        after = before - F.col(f"_f{i}")
        rows.append(_audit_row(dataset, i, check.name, check.description, check.rule, before, after))
        before = after
    return counts.select(F.inline(F.array(*rows)))


def _audit_row(dataset, step, name, description, rule, before: Column, after: Column) -> Column:
    return F.struct(
        F.lit(dataset).alias("dataset"), F.lit(step).alias("step"), F.lit(name).alias("name"),
        F.lit(description).alias("description"), F.lit(rule).alias("rule"),
        before.alias("rows_before"), after.alias("rows_after"), (before - after).alias("rows_removed"),
    )


def dedup_first(df: DataFrame, key: list[str], position: str = ROW_ID) -> DataFrame:
    """Keep the first row of every key, in the order of ``position`` (unique per row).

    Only keys that repeat are looked up again. They are counted with map-side combining and
    written out, so a hot key is one row by the time of the join, and the join is a broadcast
    whenever the repeated keys are measured to be few.
    """
    firsts = (
        df.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(key)])
        .agg(F.min(position).alias("_first"), F.count("*").alias("_copies"))
        .filter("_copies > 1")
    )
    repeated = materialize(firsts.drop("_copies"), "repeated")
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    later = F.col(position) > F.col("_first")
    return df.join(repeated, functools.reduce(Column.__and__, same) & later, "left_anti")


def fk_semi(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key exists in the parent; rows without a key go."""
    return child.join(parent.select(F.col(parent_key).alias("_pk")), F.col(key) == F.col("_pk"), "left_semi")


def fk_orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """The rows ``fk_semi`` removes."""
    return child.join(parent.select(F.col(parent_key).alias("_pk")), F.col(key) == F.col("_pk"), "left_anti")


def clean_star(
    tables: dict[str, DataFrame],
    primary: list[tuple[str, str]],
    foreign: list[tuple[str, str, str, str]],
    dataset: str = "",
    position: str = ROW_ID,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Primary keys made unique, then dangling foreign keys removed, in the given order.

    Steps do not cascade: a child is tested against its parent as it is at that step, before the
    parent may lose rows to a later one. Every step's result is written once: later steps, the audit
    and the caller read that, so no join runs twice, and the audit counts whole files.
    """
    out, trail = dict(tables), []
    for table, key in primary:
        if table in out and key in out[table].columns:
            after = materialize(dedup_first(out[table], [key], position), f"{table}-pk")
            trail.append((f"{table}_pk_unique", f"{table}.{key} is unique", f"first row per {key}", out[table], after))
            out[table] = after
    for child, key, parent, parent_key in foreign:
        if child in out and parent in out:
            after = materialize(fk_semi(out[child], key, out[parent], parent_key), f"{child}-fk")
            text = f"{child}.{key} exists in {parent}.{parent_key}"
            trail.append((f"{child}_fk_{parent}", text, f"{key} in {parent}.{parent_key}", out[child], after))
            out[child] = after
    audits = []
    for step, (name, description, rule, before, after) in enumerate(trail):
        counts = before.agg(F.count("*").alias("_b")).select(F.struct("_b", F.lit(0).cast("bigint").alias("_a")).alias("_c"))
        counts = counts.unionByName(
            after.agg(F.count("*").alias("_a")).select(F.struct(F.lit(0).cast("bigint").alias("_b"), "_a").alias("_c"))
        ).agg(F.sum("_c._b").alias("_b"), F.sum("_c._a").alias("_a"))
        row = _audit_row(dataset, step, name, description, rule, F.col("_b"), F.col("_a"))
        audits.append(counts.select(F.inline(F.array(row))))
    return out, functools.reduce(DataFrame.unionByName, audits)
