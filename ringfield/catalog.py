"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib

from ringfield.plans.registry import QUERIES, SQL

MODULES = ("grid", "objects", "evaluation", "motion", "diagnosis", "detector", "failures", "transforms", "intake", "exports", "streams")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"ringfield.plans.{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
