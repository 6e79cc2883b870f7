"""The standing SQL reports.  ROUND is half away from zero, NULL groups stay, and
top-k ties go to the smaller id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.functions.expressions import (
    full_name,
    growth_pct,
    mean_of,
    round_half_away,
    safe_divide,
    stock_flag,
    year_month,
)
from retail_spark.operators.aggregates import ratings_by, sales_by, with_amount
from retail_spark.operators.ordering import top_k


def product_sales(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Per product with orders: labels, units and revenue over orders with an amount."""
    sold = sales_by(with_amount(orders), "product_id")
    return sold.join(products.select("product_id", "product_name", "category"), "product_id")


def top_revenue_products(orders: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    sales = product_sales(orders, products).select(
        "product_id",
        "product_name",
        "category",
        F.col("units").alias("total_units_sold"),
        F.col("revenue").alias("total_revenue"),
        round_half_away(mean_of(F.col("units"), F.col("quantity_count"))).alias("avg_order_quantity"),
        "order_count",
    )
    return top_k(sales, "total_revenue", k, "product_id")


def monthly_revenue(orders: DataFrame) -> DataFrame:
    """``month`` (first day) and ``revenue``, for months with an amount."""
    dated = with_amount(orders).where(F.col("order_date").isNotNull())
    return dated.groupBy(F.trunc("order_date", "MM").alias("month")).agg(F.sum("total_amount").alias("revenue"))


def monthly_trend(orders: DataFrame, months: int = 12) -> DataFrame:
    """The last months with their predecessor's revenue and the growth.

    The predecessor is looked up before the cut, so the oldest month shown has one.
    """
    previous = F.lag("revenue").over(Window.orderBy("month"))
    trend = monthly_revenue(orders).withColumn("prev_revenue", previous)
    return (
        trend.orderBy(F.desc("month"))
        .limit(months)
        .select(
            year_month(F.col("month")).alias("month"),
            "revenue",
            "prev_revenue",
            round_half_away(
                growth_pct(F.col("revenue").cast("double"), F.col("prev_revenue").cast("double"))
            ).alias("mom_growth_pct"),
        )
    )


def customer_spend(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Per customer with an amount: labels, orders, spend, mean over orders with an amount."""
    stats = sales_by(with_amount(orders), "customer_id")
    labels = customers.select(
        "customer_id",
        full_name(F.col("first_name"), F.col("last_name")).alias("customer_name"),
        "loyalty_tier",
        "city",
    )
    return stats.join(labels, "customer_id").select(
        "customer_id",
        "customer_name",
        "loyalty_tier",
        "city",
        F.col("order_count").alias("total_orders"),
        F.col("revenue").alias("total_spent"),
        round_half_away(mean_of(F.col("revenue"), F.col("amount_count"))).alias("avg_order_value"),
    )


def customer_lifetime_value(orders: DataFrame, customers: DataFrame, k: int = 20) -> DataFrame:
    """The largest spenders with a dense rank.

    A rank only depends on the rows before it, so the top rows are cut out first
    and the window runs over those alone.
    """
    top = top_k(customer_spend(orders, customers), "total_spent", k, "customer_id")
    return top.withColumn("spend_rank", F.dense_rank().over(Window.orderBy(F.desc("total_spent"))))


def monthly_category_revenue(orders: DataFrame, products: DataFrame) -> DataFrame:
    dated = with_amount(orders).where(F.col("order_date").isNotNull())
    per_product = dated.groupBy(F.trunc("order_date", "MM").alias("month"), "product_id").agg(
        F.sum("total_amount").alias("revenue")
    )
    return (
        per_product.join(products.select("product_id", "category"), "product_id")
        .groupBy("category", "month")
        .agg(F.sum("revenue").alias("monthly_revenue"))
    )


def category_running_total(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Monthly revenue per category and its running total; a window holds one
    category's months."""
    so_far = Window.partitionBy("category").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return (
        monthly_category_revenue(orders, products)
        .withColumn("running_total", F.sum("monthly_revenue").over(so_far))
        .orderBy("category", "month")
        .withColumn("month", year_month(F.col("month")))
    )


def rating_vs_revenue(orders: DataFrame, products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Products with both rated reviews and orders with an amount."""
    ratings = ratings_by(reviews.where(F.col("rating").isNotNull()), "product_id").select(
        "product_id",
        round_half_away(mean_of(F.col("rating_sum"), F.col("rating_count"))).alias("avg_rating"),
        "review_count",
    )
    sales = sales_by(with_amount(orders), "product_id").select(
        "product_id",
        F.col("revenue").alias("total_revenue"),
        F.col("units").alias("total_units_sold"),
        "order_count",
    )
    return (
        products.select("product_id", "product_name", "category")
        .join(ratings, "product_id")
        .join(sales, "product_id")
        .orderBy(F.desc("avg_rating"), "product_id")
    )


def repeat_rate_by_tier(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Buyers, repeat buyers and orders per buyer, by loyalty tier."""
    counts = orders.groupBy("customer_id").agg(F.count("order_id").alias("order_count"))
    repeat = F.sum(F.when(F.col("order_count") > 1, 1).otherwise(0))
    by_tier = (
        counts.join(customers.select("customer_id", "loyalty_tier"), "customer_id")
        .groupBy("loyalty_tier")
        .agg(
            F.count("customer_id").alias("total_customers"),
            repeat.alias("repeat_customers"),
            F.sum("order_count").alias("_orders"),
        )
    )
    return by_tier.select(
        "loyalty_tier",
        "total_customers",
        "repeat_customers",
        round_half_away(safe_divide(F.col("repeat_customers"), F.col("total_customers")) * 100).alias(
            "repeat_purchase_rate_pct"
        ),
        round_half_away(mean_of(F.col("_orders"), F.col("total_customers"))).alias("avg_orders_per_customer"),
    ).orderBy(F.desc("repeat_purchase_rate_pct"), "loyalty_tier")


def inventory_turnover(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Units sold against stock for every product, sold or not."""
    sold = orders.groupBy("product_id").agg(F.sum("quantity").alias("units_sold"))
    units = F.coalesce(F.col("units_sold"), F.lit(0))
    ratio = safe_divide(units, F.col("stock_quantity"))
    return (
        products.join(sold, "product_id", "left")
        .select(
            "product_id",
            "product_name",
            "category",
            F.col("stock_quantity").alias("current_stock"),
            units.alias("units_sold"),
            round_half_away(ratio).alias("turnover_ratio"),
            stock_flag(F.col("stock_quantity"), ratio).alias("inventory_flag"),
        )
        .orderBy(F.col("turnover_ratio").desc_nulls_last(), "product_id")
    )
