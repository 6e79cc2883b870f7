"""The ten standing business questions as fixed, read-only statements.

They run over the views ``orders``, ``products``, ``customers`` and ``reviews``.
Revenue leaves out orders without an amount, relative dates count back from the
latest order, and a listing shows at most 20 rows.  Orders are aggregated per key
before a dimension is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retail_spark.operators.statements import read_query, run_named
from retail_spark.sources.readers import register
from retail_spark.sources.scratch import stage

# The latest order date, moved back by months; days run over as in shift_months.
_SINCE = (
    "(SELECT date_add(add_months(trunc(max(order_date), 'MM'), -{months}), day(max(order_date)) - 1) FROM orders)"
)

QUESTIONS: dict[str, tuple[str, str]] = {
    "n1_top5_products": (
        "Which five products bring the most revenue?",
        """
SELECT p.product_id, p.product_name, p.category, s.total_revenue, s.units_sold
FROM (SELECT product_id, sum(total_amount) AS total_revenue, sum(quantity) AS units_sold
      FROM orders WHERE total_amount IS NOT NULL GROUP BY product_id) s
JOIN products p ON p.product_id = s.product_id
ORDER BY s.total_revenue DESC, p.product_id LIMIT 5""",
    ),
    "n2_orders_last_6_months": (
        "How many orders came in over the last six months?",
        f"""
SELECT count(*) AS order_count FROM orders WHERE order_date >= {_SINCE.format(months=6)}""",
    ),
    "n3_top_customer": (
        "Who has spent the most?",
        """
SELECT c.customer_id, c.first_name || ' ' || c.last_name AS customer_name, s.total_spent
FROM (SELECT customer_id, sum(total_amount) AS total_spent
      FROM orders WHERE total_amount IS NOT NULL GROUP BY customer_id) s
JOIN customers c ON c.customer_id = s.customer_id
ORDER BY s.total_spent DESC, c.customer_id LIMIT 1""",
    ),
    "n4_aov_by_category": (
        "What is an order worth on average in each category?",
        """
SELECT p.category,
       round(CAST(try_divide(CAST(sum(s.revenue) AS DOUBLE), sum(s.amounts)) AS DECIMAL(38, 6)), 2)
         AS avg_order_value
FROM (SELECT product_id, sum(total_amount) AS revenue, count(total_amount) AS amounts
      FROM orders WHERE total_amount IS NOT NULL GROUP BY product_id) s
JOIN products p ON p.product_id = s.product_id
GROUP BY p.category ORDER BY avg_order_value DESC, p.category""",
    ),
    "n5_monthly_trend_last_year": (
        "How did revenue develop by month over the last year?",
        f"""
SELECT date_format(month, 'yyyy-MM') AS month, revenue
FROM (SELECT trunc(order_date, 'MM') AS month, sum(total_amount) AS revenue
      FROM orders
      WHERE total_amount IS NOT NULL AND order_date >= {_SINCE.format(months=12)}
      GROUP BY trunc(order_date, 'MM')) m
ORDER BY month""",
    ),
    "n6_low_rated_products": (
        "Which products are rated below three on average?",
        """
SELECT p.product_id, p.product_name, r.avg_rating, r.review_count
FROM (SELECT product_id,
             round(CAST(CAST(sum(CAST(rating AS DECIMAL(9, 2))) AS DOUBLE) / count(rating) AS DECIMAL(38, 6)), 2)
               AS avg_rating,
             count(review_id) AS review_count
      FROM reviews WHERE rating IS NOT NULL GROUP BY product_id) r
JOIN products p ON p.product_id = r.product_id
WHERE r.avg_rating < 3.0
ORDER BY r.avg_rating, p.product_id""",
    ),
    "n7_pct_cancelled": (
        "What share of the orders was cancelled?",
        """
SELECT count(*) AS order_count, count_if(status = 'cancelled') AS cancelled,
       round(CAST(try_divide(CAST(count_if(status = 'cancelled') AS DOUBLE), count(*)) * 100 AS DECIMAL(38, 6)), 2)
         AS pct_cancelled
FROM orders""",
    ),
    "n8_customers_over_5_orders": (
        "Which customers have placed more than five orders?",
        """
SELECT c.customer_id, c.first_name || ' ' || c.last_name AS customer_name, s.order_count
FROM (SELECT customer_id, count(order_id) AS order_count
      FROM orders GROUP BY customer_id HAVING count(order_id) > 5) s
JOIN customers c ON c.customer_id = s.customer_id
ORDER BY s.order_count DESC, c.customer_id""",
    ),
    "n9_popular_payment_method": (
        "Which payment method is used most?",
        """
SELECT payment_method, count(*) AS order_count FROM orders
WHERE payment_method IS NOT NULL
GROUP BY payment_method ORDER BY order_count DESC, payment_method LIMIT 1""",
    ),
    "n10_top_category_best_seller": (
        "Which category earns the most, and what sells best in it by units?",
        """
SELECT top.category, top.category_revenue, p.product_id, p.product_name, s.units_sold
FROM (SELECT q.category, sum(t.revenue) AS category_revenue
      FROM (SELECT product_id, sum(total_amount) AS revenue
            FROM orders WHERE total_amount IS NOT NULL GROUP BY product_id) t
      JOIN products q ON q.product_id = t.product_id
      GROUP BY q.category ORDER BY category_revenue DESC, q.category LIMIT 1) top
JOIN products p ON p.category = top.category
JOIN (SELECT product_id, sum(quantity) AS units_sold FROM orders GROUP BY product_id) s
  ON s.product_id = p.product_id
ORDER BY s.units_sold DESC, p.product_id LIMIT 1""",
    ),
}


def answer(spark: SparkSession, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The rows that answer one question."""
    register(tables)
    rows, error = read_query(spark, QUESTIONS[key][1])
    if error is not None:
        raise ValueError(error)
    return rows


#: The columns of orders that the questions read.
ASKED = ("order_id", "customer_id", "product_id", "quantity", "total_amount", "order_date", "status", "payment_method")


def answer_all(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Run every question and record success and row count.

    Nine of the ten read orders, so these are written once, the orders of a product side by side: what is summed
    per product is then mostly added up before it is shuffled.
    """
    orders = tables["orders"].select(*[c for c in tables["orders"].columns if c in ASKED])
    register(tables | {"orders": stage(orders.repartitionByRange("product_id"), "asked")})
    return run_named(spark, list(QUESTIONS.values()))
