"""The queries this engine answers over the given tables."""

from __future__ import annotations

from importlib import import_module

from rowassay.catalog.registry import ORACLE, QUERIES

for _part in ("tables", "rules", "suites", "injections", "responses", "scores"):
    import_module(f"rowassay.catalog.{_part}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
