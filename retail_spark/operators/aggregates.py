"""Aggregations that the reports share.

Facts are aggregated on the foreign key before a dimension is joined.  The join
then sees one row per key, so a hot product or customer costs no more than any
other; sums are decimal, so re-aggregating is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.functions.expressions import round_half_away, safe_divide


def with_amount(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("total_amount").isNotNull())


def sales_by(orders: DataFrame, *keys: str) -> DataFrame:
    """Orders, units and revenue per key, NULL amounts adding nothing.

    ``revenue`` is NULL for a key without any amount, as in SQL.
    """
    return orders.groupBy(*keys).agg(
        F.count("order_id").alias("order_count"),
        F.count("total_amount").alias("amount_count"),
        F.sum("quantity").alias("units"),
        F.count("quantity").alias("quantity_count"),
        F.sum("total_amount").alias("revenue"),
    )


def ratings_by(reviews: DataFrame, *keys: str) -> DataFrame:
    """Reviews and rating sums per key; ratings are summed as decimals."""
    return reviews.groupBy(*keys).agg(
        F.count("review_id").alias("review_count"),
        F.count("rating").alias("rating_count"),
        F.sum(F.col("rating").cast("decimal(9,2)")).alias("rating_sum"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def share_of_total(counted: DataFrame, count: str, out: str) -> DataFrame:
    """Per-cent share of an already small aggregate."""
    total = counted.agg(F.sum(count)).scalar()
    return counted.withColumn(out, round_half_away(safe_divide(F.col(count), total) * 100, 2))


def pivot_sum(df: DataFrame, row: str, column: str, value: str, values: Sequence[str]) -> DataFrame:
    """Matrix of sums, absent cells zero, with a ``TOTAL`` column."""
    wide = df.groupBy(row).pivot(column, list(values)).agg(F.sum(value))
    cells = [F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values]
    filled = wide.select(row, *cells)
    total = sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))
    return filled.withColumn("TOTAL", total)
