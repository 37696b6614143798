"""All registered queries and their checks."""

from __future__ import annotations

from wane.plans import catalog_queries, evaluation_queries, library_queries, resolution_queries

MODULES = [catalog_queries, resolution_queries, library_queries, evaluation_queries]

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
CHECKS = {k: v for m in MODULES for k, v in m.CHECKS.items()}
