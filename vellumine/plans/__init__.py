"""Registry of the query suites."""

from __future__ import annotations

from vellumine.plans import aggregates, analytics, expressions, extras, io, joins, more, relational, streams, subqueries, windows
from vellumine.plans.suite import Query

SUITES = (relational, joins, aggregates, windows, subqueries, expressions, more, extras, io, analytics, streams)
FLAGSHIP = "q01_pricing_summary"


def queries() -> dict[str, Query]:
    return {name: q for module in SUITES for name, q in module.suite.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for module in SUITES for name, q in module.suite.sql.items()}
