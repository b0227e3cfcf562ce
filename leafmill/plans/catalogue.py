"""All core queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.plans import core_problems, document_queries, golden_queries, report_queries, table_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **core_problems.QUERIES,
    **table_queries.QUERIES,
    **text_queries.QUERIES,
    **report_queries.QUERIES,
    **document_queries.QUERIES,
    **golden_queries.QUERIES,
}

SQL: dict[str, str] = {**core_problems.SQL, **table_queries.SQL, **text_queries.SQL, **report_queries.SQL, **document_queries.SQL, **golden_queries.SQL}
