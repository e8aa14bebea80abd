"""All queries of the routing jobs, by name."""

from __future__ import annotations

from quillon.plans import data_queries, metric_queries, pareto_queries, review_queries, state_queries

MODULES = [data_queries, metric_queries, pareto_queries, review_queries, state_queries]


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
