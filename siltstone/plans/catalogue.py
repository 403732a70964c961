"""The queries of the library's own operators, by name."""

from __future__ import annotations

from siltstone.plans import ann_queries, catalog_queries, graph_queries, registry, report_queries, retrieval, signal_queries, table_queries  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
