"""All registered queries. Importing the modules registers them."""

from plumbline.plans import (  # noqa: F401
    queries_change,
    queries_jobs,
    queries_kpi,
    queries_large,
    queries_metrics,
    queries_scalar,
    queries_tables,
)
from plumbline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
