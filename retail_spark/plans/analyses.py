"""The batch analyses: revenue matrix, customer segments, product performance,
discount impact.  Means round half to even here, as data frames do; a group key
that is NULL is left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.functions.expressions import (
    bin_right_closed,
    days_between,
    flag,
    growth_pct,
    mean_of,
    ordinal,
    round_half_even,
    tier_by_edges,
    year_month,
)
from retail_spark.operators.aggregates import pivot_sum, ratings_by, sales_by, with_amount
from retail_spark.operators.ordering import top_k
from retail_spark.operators.ranking import quantile_columns, rank_descending

# Bin edges and labels of the reports.
SEGMENT_EDGES, SEGMENTS = (-1, 90, 180, float("inf")), ("Active", "At Risk", "Churned")
DISCOUNT_EDGES = (-0.1, 0, 5, 10, 15, 100)
DISCOUNT_TIERS = ("No discount", "1–5%", "6–10%", "11–15%", "16%+")
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
PERFORMANCE_TIERS = ("Bottom 25%", "Lower Mid", "Upper Mid", "Top 25%")


def _zero(c):
    return F.coalesce(c, F.lit(0))


def revenue_by_month_category(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Long form: ``month, category, revenue``."""
    dated = with_amount(orders).where(F.col("order_date").isNotNull())
    per_product = dated.groupBy(F.trunc("order_date", "MM").alias("month"), "product_id").agg(
        F.sum("total_amount").alias("revenue")
    )
    return (
        per_product.join(products.select("product_id", "category"), "product_id", "left")
        .where(F.col("category").isNotNull())
        .groupBy("month", "category")
        .agg(F.sum("revenue").alias("revenue"))
    )


def product_categories(products: DataFrame) -> list[str]:
    """The matrix columns.  Bounded: a pivot admits only so many."""
    limit = int(products.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = products.where("category IS NOT NULL").select("category").distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} categories; use revenue_by_month_category")
    return sorted(row["category"] for row in found)


def revenue_pivot(orders: DataFrame, products: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """Month x category matrix with ``TOTAL`` and growth over the month before."""
    long = revenue_by_month_category(orders, products)
    wide = pivot_sum(long, "month", "category", "revenue", categories or product_categories(products))
    months = Window.orderBy("month")
    amounts = [F.col(f"`{c}`").cast("double").alias(c) for c in wide.columns if c != "month"]
    return wide.select(
        "month",
        *amounts,
        growth_pct(F.col("TOTAL").cast("double"), F.lag(F.col("TOTAL").cast("double")).over(months)).alias(
            "mom_growth_pct"
        ),
    ).select(year_month(F.col("month")).alias("year_month"), *[F.col(f"`{c}`") for c in wide.columns[1:]], "mom_growth_pct")


def customer_totals(orders: DataFrame) -> DataFrame:
    return (
        orders.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count("order_id").alias("total_orders"),
            _zero(F.sum("total_amount")).alias("total_spent"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
        )
    )


def customer_segments(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per buyer: totals, recency, segment and profile.

    Recency counts from the latest order of all.  The mean order value divides by
    every order, also those without an amount.
    """
    latest = orders.agg(F.max("order_date")).scalar()
    totals = customer_totals(orders).withColumn("_latest", latest)
    recency = days_between(F.col("_latest"), F.col("last_order_date"))
    profile = customers.select("customer_id", "first_name", "last_name", "city", "loyalty_tier", "is_active")
    return (
        totals.withColumn("days_since_last_order", recency)
        .join(profile, "customer_id", "left")
        .select(
            "customer_id",
            "total_orders",
            "total_spent",
            "first_order_date",
            "last_order_date",
            round_half_even(mean_of(F.col("total_spent"), F.col("total_orders"))).alias("avg_order_value"),
            "days_since_last_order",
            bin_right_closed(F.col("days_since_last_order"), SEGMENT_EDGES, SEGMENTS).alias("segment"),
            "first_name",
            "last_name",
            "city",
            "loyalty_tier",
            "is_active",
        )
    )


def segment_distribution(segments: DataFrame) -> DataFrame:
    counted = segments.where("segment IS NOT NULL").groupBy("segment").agg(F.count("*").alias("customers"))
    return counted.orderBy(F.desc("customers"), "segment")


def segment_revenue(segments: DataFrame) -> DataFrame:
    grouped = segments.where("segment IS NOT NULL").groupBy("segment").agg(
        F.count("customer_id").alias("customers"),
        F.sum("total_spent").alias("_spent"),
        F.sum("total_orders").alias("_orders"),
    )
    return grouped.orderBy(ordinal(F.col("segment"), SEGMENTS)).select(
        "segment",
        "customers",
        round_half_even(F.col("_spent")).alias("total_revenue"),
        round_half_even(mean_of(F.col("_spent"), F.col("customers"))).alias("avg_spend"),
        round_half_even(mean_of(F.col("_orders"), F.col("customers"))).alias("avg_orders"),
    )


def top_spenders(segments: DataFrame, k: int = 10) -> DataFrame:
    columns = (
        "customer_id",
        "first_name",
        "last_name",
        "total_orders",
        "total_spent",
        "avg_order_value",
        "days_since_last_order",
        "segment",
    )
    return top_k(segments.select(*columns), "total_spent", k, "customer_id")


def product_totals(orders: DataFrame, products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every product with its sales and ratings; both facts are aggregated before
    they meet, so orders and reviews never multiply."""
    sold = sales_by(orders.where(F.col("product_id").isNotNull()), "product_id")
    rated = ratings_by(reviews.where(F.col("product_id").isNotNull()), "product_id")
    return (
        products.select("product_id", "product_name", "category", "unit_price")
        .join(sold, "product_id", "left")
        .join(rated, "product_id", "left")
        .select(
            "product_id",
            "product_name",
            "category",
            "unit_price",
            _zero(F.col("units")).alias("units_sold"),
            _zero(F.col("revenue")).alias("total_revenue"),
            _zero(F.col("order_count")).alias("order_count"),
            round_half_even(mean_of(F.col("rating_sum"), F.col("rating_count"))).alias("avg_rating"),
            _zero(F.col("review_count")).alias("review_count"),
        )
    )


def product_performance(totals: DataFrame) -> DataFrame:
    """Rank within the category and revenue quartile.

    ``totals`` is read several times; pass a staged frame when it is costly.
    """
    ranked = rank_descending(totals, "total_revenue", "revenue_rank_in_category", by=["category"])
    names = list(QUARTILES)
    edges = quantile_columns(totals, "total_revenue", QUARTILES).select(F.struct(*names)).scalar()
    return (
        ranked.withColumn("_edges", edges)
        .withColumn(
            "performance_tier",
            tier_by_edges(
                F.col("total_revenue").cast("double"),
                [F.col(f"_edges.{name}") for name in names],
                PERFORMANCE_TIERS,
            ),
        )
        .drop("_edges")
    )


def top_products(performance: DataFrame, k: int = 15) -> DataFrame:
    columns = (
        "product_id",
        "product_name",
        "category",
        "units_sold",
        "total_revenue",
        "avg_rating",
        "review_count",
        "revenue_rank_in_category",
    )
    return top_k(performance.select(*columns), "total_revenue", k, "product_id")


def category_summary(totals: DataFrame) -> DataFrame:
    """Per category: products, revenue, mean of the products' ratings, units."""
    rating = F.col("avg_rating").cast("decimal(9,2)")
    grouped = totals.where("category IS NOT NULL").groupBy("category").agg(
        F.count("product_id").alias("products"),
        F.sum("total_revenue").alias("_revenue"),
        F.sum(rating).alias("_ratings"),
        F.count("avg_rating").alias("_rated"),
        F.sum("units_sold").alias("total_units"),
    )
    return grouped.orderBy(F.desc("_revenue"), "category").select(
        "category",
        "products",
        round_half_even(F.col("_revenue")).alias("total_revenue"),
        round_half_even(mean_of(F.col("_ratings"), F.col("_rated"))).alias("avg_rating"),
        "total_units",
    )


def _rate(hits: str, total: str):
    """Share rounded to four places, then as per cent to two."""
    return round_half_even(round_half_even(mean_of(F.col(hits), F.col(total)), 4) * 100)


def _order_outcomes(orders: DataFrame, group: str) -> DataFrame:
    return orders.groupBy(group).agg(
        F.count("order_id").alias("order_count"),
        F.count("*").alias("_rows"),
        F.count("total_amount").alias("_amounts"),
        _zero(F.sum("total_amount")).alias("_revenue"),
        *[
            F.sum(flag(F.coalesce(F.col("status") == status, F.lit(False)))).alias(f"_{status}")
            for status in ("completed", "returned", "cancelled")
        ],
    )


def _mean_amount():
    return round_half_even(round_half_even(mean_of(F.col("_revenue"), F.col("_amounts")), 4))


def discount_impact(orders: DataFrame) -> DataFrame:
    """Order value and outcome per discount tier, in tier order."""
    tier = bin_right_closed(F.col("discount_pct"), DISCOUNT_EDGES, DISCOUNT_TIERS)
    tiered = orders.select("order_id", "total_amount", "status", tier.alias("discount_tier")).where(
        "discount_tier IS NOT NULL"
    )
    medians = quantile_columns(tiered, "total_amount", {"_median": 0.5}, by=["discount_tier"])
    joined = _order_outcomes(tiered, "discount_tier").join(medians, "discount_tier", "left")
    return joined.orderBy(ordinal(F.col("discount_tier"), DISCOUNT_TIERS)).select(
        "discount_tier",
        "order_count",
        _mean_amount().alias("avg_order_value"),
        round_half_even(round_half_even(F.col("_median"), 4)).alias("median_order_value"),
        round_half_even(F.col("_revenue")).alias("total_revenue"),
        _rate("_completed", "_rows").alias("completion_rate"),
        _rate("_returned", "_rows").alias("return_rate"),
        _rate("_cancelled", "_rows").alias("cancellation_rate"),
    )


def discount_comparison(orders: DataFrame) -> DataFrame:
    """Discounted against undiscounted orders."""
    has = F.coalesce(F.col("discount_pct") > 0, F.lit(False))
    label = F.when(has, F.lit("Has discount")).otherwise(F.lit("No discount"))
    labelled = orders.select("order_id", "total_amount", "status", label.alias("discount"))
    return _order_outcomes(labelled, "discount").select(
        "discount",
        "order_count",
        _mean_amount().alias("avg_order_value"),
        _rate("_completed", "_rows").alias("completion_rate"),
        _rate("_returned", "_rows").alias("return_rate"),
    )
