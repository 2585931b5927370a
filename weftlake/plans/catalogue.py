"""The library's own queries, by name, with their SQL."""

from __future__ import annotations

from weftlake.plans import cluster_queries, dom_queries, markup_queries, more_queries, url_queries  # noqa: F401  they register themselves
from weftlake.plans.registry import ORACLES, QUERIES

FLAGSHIP = "tag_sequence_clusters"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
