"""All registered queries and their SQL."""

from panelweave.plans import review_queries, source_queries  # noqa: F401  they register themselves
from panelweave.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
