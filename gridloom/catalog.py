"""All queries of the library by name, and SQL for those that SQL can express."""

from __future__ import annotations

from gridloom import registry
from gridloom.plans import analytics_queries, feature_queries, io_queries, learner_queries, match_queries, pixel_queries, platform_queries, sampling_queries, stencil_queries, tree_queries  # noqa: F401  they register themselves


def queries() -> dict:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.ORACLE
