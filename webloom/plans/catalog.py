"""Named queries with the SQL that checks them."""

from __future__ import annotations

from webloom.plans import crawl_queries, evidence_queries, graph_queries, page_queries, record_queries, run_queries  # noqa: F401  they register themselves
from webloom.plans.registry import ORACLES, QUERIES

FLAGSHIP = "link_edges"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
