"""All queries over the relational tables, with their DuckDB twins."""

from __future__ import annotations

from quern.plans import aggregates, joins, scalars, selects, sets, sources, windows
from quern.plans.registry import ORACLES, QUERIES

MODULES = (selects, joins, aggregates, windows, sets, scalars, sources)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
