"""Every operator as a named query over a folder of Parquet tables.

Each entry pairs the Spark query with the same question in ANSI SQL, so that two
engines can be compared on whole tables.
"""

from retail_spark.catalog import (  # noqa: F401
    aggregation,
    analysis,
    cleaning,
    joins,
    loading,
    ordering,
    profiling,
    quality,
    questions,
    scalars,
    sources,
    statements,
    validation,
)
from retail_spark.catalog.registry import ENTRIES, oracle_sql, queries

__all__ = ["ENTRIES", "oracle_sql", "queries"]
