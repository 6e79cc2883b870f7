"""Join shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from retail_spark.catalog.registry import entry
from retail_spark.operators.aggregates import ratings_by, sales_by, with_amount
from retail_spark.operators.referential import keep_members, orphans
from retail_spark.plans.cleaning import clean_products

_PRODUCT = ("product_id", "product_name", "category")


@entry(
    "join_inner_fact_dim",
    """SELECT order_id, v_orders.product_id, product_name, category, CAST(quantity AS BIGINT) AS quantity,
    CAST(total_amount AS DOUBLE) AS total_amount
    FROM v_orders JOIN v_products ON v_orders.product_id = v_products.product_id""",
)
def join_inner_fact_dim(v):
    return v.orders.join(v.products.select(*_PRODUCT), "product_id").select(
        "order_id", "product_id", "product_name", "category", "quantity", "total_amount"
    )


@entry(
    "join_left_fact_dim",
    """SELECT order_id, r_orders.product_id, category, status FROM r_orders
    LEFT JOIN c_products ON r_orders.product_id = c_products.product_id""",
)
def join_left_fact_dim(v):
    dim = clean_products(v.products_raw).select("product_id", "category")
    return v.orders_raw.join(dim, "product_id", "left").select("order_id", "product_id", "category", "status")


@entry(
    "join_left_dim_aggregates",
    """SELECT p.product_id, category, CAST(coalesce(units, 0) AS BIGINT) AS units, coalesce(reviews, 0) AS reviews
    FROM v_products p
    LEFT JOIN (SELECT product_id, sum(quantity) AS units FROM v_orders GROUP BY product_id) s ON s.product_id = p.product_id
    LEFT JOIN (SELECT product_id, count(*) AS reviews FROM v_reviews GROUP BY product_id) r ON r.product_id = p.product_id""",
)
def join_left_dim_aggregates(v):
    sold = sales_by(v.orders, "product_id").select("product_id", "units")
    rated = ratings_by(v.reviews, "product_id").select("product_id", F.col("review_count").alias("reviews"))
    return (
        v.products.select("product_id", "category")
        .join(sold, "product_id", "left")
        .join(rated, "product_id", "left")
        .fillna(0, ["units", "reviews"])
    )


@entry(
    "join_multi_aggregates",
    """SELECT p.product_id, CAST(revenue AS DOUBLE) AS revenue, rated FROM v_products p
    JOIN (SELECT product_id, sum(total_amount) AS revenue FROM v_orders WHERE total_amount IS NOT NULL GROUP BY product_id) s
      ON s.product_id = p.product_id
    JOIN (SELECT product_id, count(rating) AS rated FROM v_reviews WHERE rating IS NOT NULL GROUP BY product_id) r
      ON r.product_id = p.product_id""",
)
def join_multi_aggregates(v):
    sold = sales_by(with_amount(v.orders), "product_id").select("product_id", "revenue")
    rated = ratings_by(v.reviews.where("rating IS NOT NULL"), "product_id")
    return (
        v.products.select("product_id")
        .join(sold, "product_id")
        .join(rated.select("product_id", F.col("rating_count").alias("rated")), "product_id")
    )


@entry(
    "join_semi",
    "SELECT order_id, product_id, quantity FROM r_orders WHERE product_id IN (SELECT product_id FROM c_products)",
)
def join_semi(v):
    kept = keep_members(v.orders_raw, clean_products(v.products_raw), "product_id")
    return kept.select("order_id", "product_id", "quantity")


@entry(
    "join_anti",
    "SELECT order_id, product_id, quantity FROM r_orders WHERE product_id NOT IN (SELECT product_id FROM c_products)",
)
def join_anti(v):
    lost = orphans(v.orders_raw, clean_products(v.products_raw), "product_id")
    return lost.select("order_id", "product_id", "quantity")
