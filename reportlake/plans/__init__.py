"""Registered queries over the given tables."""

from reportlake.plans import (  # noqa: F401
    document_queries,
    extract_queries,
    merge_queries,
    model_queries,
    report_queries,
    search_queries,
    store_queries,
    whole_queries,
)
from reportlake.plans.registry import ORACLES, QUERIES  # noqa: F401
