"""Key figures and the one-row summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_spark.functions.expressions import mean_of, round_half_away
from retail_spark.operators.aggregates import share_of_total, value_counts
from retail_spark.operators.ordering import top_k
from retail_spark.plans.reports import customer_spend, product_sales


def key_figures(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue, row counts and mean order value in one row; 0 where there is none."""
    count = F.count("*")
    totals = orders.agg(
        F.sum("total_amount").alias("revenue"),
        F.count("total_amount").alias("amounts"),
        count.alias("total_orders"),
    )
    return totals.select(
        F.coalesce(F.col("revenue"), F.lit(0)).alias("total_revenue"),
        "total_orders",
        customers.agg(count).scalar().alias("total_customers"),
        products.agg(count).scalar().alias("total_products"),
        F.coalesce(round_half_away(mean_of(F.col("revenue"), F.col("amounts"))), F.lit(0.0)).alias("avg_order_value"),
    )


def top_products(orders: DataFrame, products: DataFrame, k: int = 5) -> DataFrame:
    sales = product_sales(orders, products).select(
        "product_id",
        "product_name",
        "category",
        F.col("revenue").alias("total_revenue"),
        F.col("units").alias("units_sold"),
    )
    return top_k(sales, "total_revenue", k, "product_id")


def top_customers(orders: DataFrame, customers: DataFrame, k: int = 5) -> DataFrame:
    spend = customer_spend(orders, customers).select("customer_id", "customer_name", "total_orders", "total_spent")
    return top_k(spend, "total_spent", k, "customer_id")


def status_distribution(orders: DataFrame) -> DataFrame:
    counted = value_counts(orders, "status").withColumnRenamed("n", "orders")
    return share_of_total(counted, "orders", "pct").orderBy(F.desc("orders"), "status")


def _as_list(df: DataFrame, *order: Column) -> Column:
    """A short result as one array of rows, in the given order."""
    keyed = df.agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct("*").alias("row")))).alias("rows"))
    return keyed.select(F.transform("rows", lambda r: r["row"])).scalar()


def summary(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Key figures with the three short lists nested in the same row.

    The lists hold five rows each and one row per order status, so gathering them
    is bounded.
    """
    return key_figures(orders, customers, products).select(
        "*",
        _as_list(top_products(orders, products), -F.col("total_revenue"), F.col("product_id")).alias("top_5_products"),
        _as_list(top_customers(orders, customers), -F.col("total_spent"), F.col("customer_id")).alias(
            "top_5_customers"
        ),
        _as_list(status_distribution(orders), -F.col("orders"), F.col("status")).alias("order_status_dist"),
    )
