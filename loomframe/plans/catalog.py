"""All registered queries."""

from __future__ import annotations

from loomframe.plans import extra_queries, matrix_queries, model_queries, qc_queries, table_queries  # noqa: F401
from loomframe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
