"""The ten standing questions."""

from __future__ import annotations

from retail_spark.catalog.oracle_views import half_away
from retail_spark.catalog.registry import entry
from retail_spark.plans.questions import answer

_PRODUCT_SALES = """SELECT p.product_id, product_name, category, sum(total_amount) AS revenue, sum(quantity) AS units
  FROM v_orders s JOIN v_products p ON p.product_id = s.product_id WHERE total_amount IS NOT NULL GROUP BY ALL"""
_LATEST = "(SELECT max(order_date) FROM v_orders)"


def _since(months: int) -> str:
    start = f"date_trunc('month', {_LATEST}) - INTERVAL {months} MONTH"
    return f"CAST({start} AS DATE) + CAST(day({_LATEST}) - 1 AS INTEGER)"


SQL = {
    "n1_top5_products": f"""SELECT product_id, product_name, category, CAST(revenue AS DOUBLE) AS total_revenue,
        CAST(units AS BIGINT) AS units_sold FROM ({_PRODUCT_SALES}) t ORDER BY revenue DESC, product_id LIMIT 5""",
    "n2_orders_last_6_months": f"SELECT count(*) AS order_count FROM v_orders WHERE order_date >= {_since(6)}",
    "n3_top_customer": """SELECT c.customer_id, first_name || ' ' || last_name AS customer_name,
        CAST(sum(total_amount) AS DOUBLE) AS total_spent FROM v_orders s JOIN v_customers c ON c.customer_id = s.customer_id
        GROUP BY ALL ORDER BY total_spent DESC, c.customer_id LIMIT 1""",
    "n4_aov_by_category": f"""SELECT category, {half_away("CAST(sum(total_amount) AS DOUBLE) / count(total_amount)")}
        AS avg_order_value FROM v_orders s JOIN v_products p ON p.product_id = s.product_id GROUP BY category
        ORDER BY avg_order_value DESC, category""",
    "n5_monthly_trend_last_year": f"""SELECT strftime(order_date, '%Y-%m') AS month, CAST(sum(total_amount) AS DOUBLE) AS revenue
        FROM v_orders WHERE total_amount IS NOT NULL AND order_date >= {_since(12)} GROUP BY 1 ORDER BY 1""",
    "n6_low_rated_products": f"""SELECT p.product_id, product_name, avg_rating, review_count FROM v_products p JOIN
        (SELECT product_id, {half_away("sum(rating) / count(rating)")} AS avg_rating, count(*) AS review_count FROM v_reviews
         WHERE rating IS NOT NULL GROUP BY product_id) r ON r.product_id = p.product_id
        WHERE avg_rating < 3 ORDER BY avg_rating, p.product_id""",
    "n7_pct_cancelled": f"""SELECT count(*) AS order_count, count(*) FILTER (WHERE status = 'cancelled') AS cancelled,
        {half_away("CAST(count(*) FILTER (WHERE status = 'cancelled') AS DOUBLE) / count(*) * 100")} AS pct_cancelled FROM v_orders""",
    "n8_customers_over_5_orders": """SELECT c.customer_id, first_name || ' ' || last_name AS customer_name,
        count(order_id) AS order_count FROM v_orders s JOIN v_customers c ON c.customer_id = s.customer_id
        GROUP BY ALL HAVING count(order_id) > 5 ORDER BY order_count DESC, c.customer_id""",
    "n9_popular_payment_method": """SELECT payment_method, count(*) AS order_count FROM v_orders GROUP BY payment_method
        ORDER BY order_count DESC, payment_method LIMIT 1""",
    "n10_top_category_best_seller": """SELECT t.category, CAST(category_revenue AS DOUBLE) AS category_revenue, p.product_id,
        product_name, CAST(sum(quantity) AS BIGINT) AS units_sold
        FROM (SELECT category, sum(total_amount) AS category_revenue FROM v_orders s JOIN v_products p
              ON p.product_id = s.product_id GROUP BY category ORDER BY category_revenue DESC, category LIMIT 1) t
        JOIN v_products p ON p.category = t.category JOIN v_orders s ON s.product_id = p.product_id
        GROUP BY ALL ORDER BY units_sold DESC, p.product_id LIMIT 1""",
}

for _key, _sql in SQL.items():
    entry(_key, _sql)(lambda v, key=_key: answer(v.spark, key, v.clean))
