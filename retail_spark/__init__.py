"""Retail data quality and analytics on Spark DataFrames."""

from retail_spark.session import build_session, configure

__all__ = ["build_session", "configure"]
