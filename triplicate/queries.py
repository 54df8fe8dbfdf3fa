"""All queries of the library by name, and SQL with the same rows."""

from __future__ import annotations

from triplicate.plans import dictionaries, files, projects, reconciliation, reports, reviews, services

_PLANS = (reconciliation, services, projects, reports, reviews, files, dictionaries)


def queries() -> dict:
    return {f.__name__: f for plan in _PLANS for f in plan.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
