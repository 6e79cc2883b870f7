"""Aggregation shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from retail_spark.catalog.registry import entry
from retail_spark.functions.expressions import flag, mean_of, round_half_away, year_month
from retail_spark.operators.aggregates import pivot_sum, share_of_total, value_counts
from retail_spark.operators.ranking import exact_quantiles, quantile_columns
from retail_spark.plans.analyses import product_categories, revenue_by_month_category
from retail_spark.plans.reports import monthly_category_revenue


@entry(
    "agg_multi",
    """SELECT customer_id, count(order_id) AS orders, CAST(sum(total_amount) AS DOUBLE) AS spent,
    CAST(min(total_amount) AS DOUBLE) AS smallest, CAST(max(total_amount) AS DOUBLE) AS largest,
    CAST(round(CAST(CAST(sum(total_amount) AS DOUBLE) / count(total_amount) AS DECIMAL(38,6)), 2) AS DOUBLE) AS mean,
    strftime(min(order_date), '%Y-%m-%d') AS first_order, strftime(max(order_date), '%Y-%m-%d') AS last_order
    FROM v_orders GROUP BY customer_id""",
)
def agg_multi(v):
    amount = F.col("total_amount")
    return v.orders.groupBy("customer_id").agg(
        F.count("order_id").alias("orders"),
        F.sum(amount).alias("spent"),
        F.min(amount).alias("smallest"),
        F.max(amount).alias("largest"),
        round_half_away(mean_of(F.sum(amount), F.count(amount))).alias("mean"),
        F.min("order_date").alias("first_order"),
        F.max("order_date").alias("last_order"),
    )


@entry(
    "agg_global",
    """SELECT count(*) AS orders, CAST(sum(total_amount) AS DOUBLE) AS revenue, CAST(sum(quantity) AS BIGINT) AS units,
    strftime(max(order_date), '%Y-%m-%d') AS latest,
    CAST(round(CAST(CAST(sum(total_amount) AS DOUBLE) / count(total_amount) AS DECIMAL(38,6)), 2) AS DOUBLE) AS mean
    FROM v_orders""",
)
def agg_global(v):
    amount = F.col("total_amount")
    return v.orders.agg(
        F.count("*").alias("orders"),
        F.sum(amount).alias("revenue"),
        F.sum("quantity").alias("units"),
        F.max("order_date").alias("latest"),
        round_half_away(mean_of(F.sum(amount), F.count(amount))).alias("mean"),
    )


@entry(
    "agg_two_keys",
    """SELECT category, strftime(order_date, '%Y-%m') AS month, CAST(sum(total_amount) AS DOUBLE) AS revenue
    FROM v_orders JOIN v_products ON v_orders.product_id = v_products.product_id
    WHERE total_amount IS NOT NULL GROUP BY ALL""",
)
def agg_two_keys(v):
    monthly = monthly_category_revenue(v.orders, v.products)
    return monthly.select("category", year_month(F.col("month")).alias("month"), F.col("monthly_revenue").alias("revenue"))


@entry(
    "agg_conditional",
    """SELECT payment_method, count(*) AS orders, count(*) FILTER (WHERE status = 'returned') AS returned,
    CAST(sum(CASE WHEN discount_pct > 10 THEN quantity ELSE 0 END) AS BIGINT) AS discounted_units,
    CAST(round(CAST(CAST(count(*) FILTER (WHERE status = 'cancelled') AS DOUBLE) / count(*) AS DECIMAL(38,6)), 4) AS DOUBLE)
      AS cancel_rate FROM v_orders GROUP BY payment_method""",
)
def agg_conditional(v):
    cancelled = F.sum(flag(F.col("status") == "cancelled"))
    return v.orders.groupBy("payment_method").agg(
        F.count("*").alias("orders"),
        F.count_if(F.col("status") == "returned").alias("returned"),
        F.sum(F.when(F.col("discount_pct") > 10, F.col("quantity")).otherwise(0)).alias("discounted_units"),
        round_half_away(mean_of(cancelled, F.count("*")), 4).alias("cancel_rate"),
    )


@entry(
    "agg_median",
    """SELECT status, quantile_cont(CAST(total_amount AS DOUBLE), 0.5) AS median_amount FROM v_orders
    WHERE total_amount IS NOT NULL GROUP BY status""",
)
def agg_median(v):
    return quantile_columns(v.orders, "total_amount", {"median_amount": 0.5}, by=["status"])


@entry(
    "agg_distinct_count",
    """SELECT status, count(DISTINCT customer_id) AS customers, count(DISTINCT product_id) AS products
    FROM v_orders GROUP BY status""",
)
def agg_distinct_count(v):
    return v.orders.groupBy("status").agg(
        F.count_distinct("customer_id").alias("customers"), F.count_distinct("product_id").alias("products")
    )


@entry(
    "agg_of_agg",
    """SELECT order_count, count(*) AS customers, CAST(sum(spent) AS DOUBLE) AS spent FROM
    (SELECT customer_id, count(order_id) AS order_count, sum(total_amount) AS spent FROM v_orders GROUP BY customer_id) t
    GROUP BY order_count""",
)
def agg_of_agg(v):
    per_customer = v.orders.groupBy("customer_id").agg(
        F.count("order_id").alias("order_count"), F.sum("total_amount").alias("spent")
    )
    return per_customer.groupBy("order_count").agg(F.count("*").alias("customers"), F.sum("spent").alias("spent"))


@entry(
    "agg_value_counts",
    "SELECT payment_method, count(*) AS n FROM v_orders GROUP BY payment_method ORDER BY n DESC",
)
def agg_value_counts(v):
    return value_counts(v.orders, "payment_method").orderBy(F.desc("n"), "payment_method")


CATEGORIES = ("economy", "large", "medium", "promo", "small", "standard")
_CELLS = ", ".join(
    f"CAST(coalesce(sum(total_amount) FILTER (WHERE category = '{c}'), 0) AS DOUBLE) AS {c}" for c in CATEGORIES
)
MATRIX = f"""SELECT strftime(order_date, '%Y-%m') AS month, {_CELLS},
    CAST(sum(total_amount) AS DOUBLE) AS "TOTAL" FROM v_orders JOIN v_products ON v_orders.product_id = v_products.product_id
    WHERE total_amount IS NOT NULL GROUP BY ALL"""


def _matrix(v):
    long = revenue_by_month_category(v.orders, v.products)
    wide = pivot_sum(long, "month", "category", "revenue", product_categories(v.products))
    return wide.withColumn("month", year_month(F.col("month")))


@entry("agg_pivot", f'SELECT * EXCLUDE ("TOTAL") FROM ({MATRIX}) t')
def agg_pivot(v):
    return _matrix(v).drop("TOTAL")


@entry("agg_row_total", f'SELECT month, "TOTAL" FROM ({MATRIX}) t')
def agg_row_total(v):
    return _matrix(v).select("month", "TOTAL")


@entry(
    "agg_share_pct",
    """SELECT status, n, CAST(round(CAST(CAST(n AS DOUBLE) / (SELECT count(*) FROM v_orders) * 100 AS DECIMAL(38,6)), 2) AS DOUBLE)
    AS pct FROM (SELECT status, count(*) AS n FROM v_orders GROUP BY status) t""",
)
def agg_share_pct(v):
    return share_of_total(value_counts(v.orders, "status"), "n", "pct")


@entry(
    "agg_quartiles",
    """SELECT probability, quantile FROM (
    SELECT unnest([0.25, 0.5, 0.75]) AS p, unnest(quantile_cont(CAST(revenue AS DOUBLE), [0.25, 0.5, 0.75])) AS quantile,
           unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS probability
    FROM (SELECT product_id, sum(total_amount) AS revenue FROM v_orders WHERE total_amount IS NOT NULL GROUP BY product_id) t) u""",
)
def agg_quartiles(v):
    revenue = v.orders.groupBy("product_id").agg(F.sum("total_amount").alias("revenue"))
    return exact_quantiles(revenue, "revenue", [0.25, 0.5, 0.75])
