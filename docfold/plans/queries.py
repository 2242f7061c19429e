"""All registered queries of the engine's own operators."""

from __future__ import annotations

from docfold.plans import batch_queries, control_queries, merge_queries, run_queries, schema_queries, text_queries  # noqa: F401
from docfold.plans.registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
