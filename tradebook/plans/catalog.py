"""All registered queries."""

from tradebook.plans import (  # noqa: F401
    event_queries,
    flow_queries,
    page_queries,
    quality_queries,
    ranking_queries,
    records_queries,
)
from tradebook.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
