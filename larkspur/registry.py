"""All queries of the reference's operators, with their DuckDB counterparts."""

from __future__ import annotations

from larkspur.plans import all_queries

QUERIES = {name: q.run for name, q in all_queries().items()}
ORACLES = {name: q.oracle for name, q in all_queries().items() if q.oracle}
