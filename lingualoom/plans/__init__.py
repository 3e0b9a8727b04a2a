"""Query plans over the driver's tables, each with the SQL of its oracle."""

from __future__ import annotations


def _load():
    from . import files, reading, reports, texts  # noqa: F401
    from .registry import QUERIES, SQL

    return QUERIES, SQL


def queries() -> dict:
    return dict(_load()[0])


def oracle_sql() -> dict[str, str]:
    return dict(_load()[1])
