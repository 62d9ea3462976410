"""All registered queries."""

from __future__ import annotations

from tidemark.plans import customer, files, knowledge, learning, market, valuation
from tidemark.plans.registry import Runner

MODULES = [customer, market, valuation, knowledge, learning, files]


def queries() -> dict[str, Runner]:
    return {name: run for m in MODULES for name, run in m.R.runners.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.R.sql.items()}
