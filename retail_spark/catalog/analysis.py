"""The complete analyses, reports and key figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from retail_spark.catalog.aggregation import MATRIX
from retail_spark.catalog.oracle_views import half_away, half_even, iso
from retail_spark.catalog.registry import entry
from retail_spark.plans import analyses, metrics, reports
from retail_spark.sources.scratch import stage


def _mean(total: str, count: str) -> str:
    return f"CAST({total} AS DOUBLE) / nullif({count}, 0)"


@entry(
    "a1_revenue_pivot",
    f"""SELECT * RENAME (month AS year_month),
    ("TOTAL" - lag("TOTAL") OVER (ORDER BY month)) / nullif(lag("TOTAL") OVER (ORDER BY month), 0) * 100 AS mom_growth_pct
    FROM ({MATRIX}) t""",
)
def a1_revenue_pivot(v):
    return analyses.revenue_pivot(v.orders, v.products)


_SEGMENTS = f"""
segments AS (
  SELECT t.customer_id, total_orders, total_spent, first_order_date, last_order_date,
    {half_even("CAST(total_spent AS DOUBLE) / total_orders")} AS avg_order_value,
    date_diff('day', last_order_date, (SELECT max(order_date) FROM v_orders)) AS days_since_last_order,
    CASE WHEN date_diff('day', last_order_date, (SELECT max(order_date) FROM v_orders)) <= 90 THEN 'Active'
         WHEN date_diff('day', last_order_date, (SELECT max(order_date) FROM v_orders)) <= 180 THEN 'At Risk'
         ELSE 'Churned' END AS segment,
    first_name, last_name, city, loyalty_tier, is_active
  FROM (SELECT customer_id, count(order_id) AS total_orders, coalesce(sum(total_amount), 0) AS total_spent,
          min(order_date) AS first_order_date, max(order_date) AS last_order_date
        FROM v_orders GROUP BY customer_id) t
  LEFT JOIN v_customers c ON c.customer_id = t.customer_id)"""


def _segments(v):
    return analyses.customer_segments(v.orders, v.customers)


@entry(
    "a2_customer_segments",
    f"""WITH {_SEGMENTS} SELECT * REPLACE (CAST(total_spent AS DOUBLE) AS total_spent,
    {iso("first_order_date")} AS first_order_date, {iso("last_order_date")} AS last_order_date) FROM segments""",
)
def a2_customer_segments(v):
    return _segments(v)


@entry(
    "a2_segment_distribution", f"WITH {_SEGMENTS} SELECT segment, count(*) AS customers FROM segments GROUP BY segment"
)
def a2_segment_distribution(v):
    return analyses.segment_distribution(_segments(v))


@entry(
    "a2_segment_revenue",
    f"""WITH {_SEGMENTS} SELECT segment, count(*) AS customers, {half_even("sum(total_spent)")} AS total_revenue,
    {half_even("CAST(sum(total_spent) AS DOUBLE) / count(*)")} AS avg_spend,
    {half_even("CAST(sum(total_orders) AS DOUBLE) / count(*)")} AS avg_orders FROM segments GROUP BY segment""",
)
def a2_segment_revenue(v):
    return analyses.segment_revenue(_segments(v))


@entry(
    "a2_top10_customers",
    f"""WITH {_SEGMENTS} SELECT customer_id, first_name, last_name, total_orders, CAST(total_spent AS DOUBLE) AS total_spent,
    avg_order_value, days_since_last_order, segment FROM segments ORDER BY segments.total_spent DESC, customer_id LIMIT 10""",
)
def a2_top10_customers(v):
    return analyses.top_spenders(_segments(v))


_PERFORMANCE = f"""
totals AS (
  SELECT p.product_id, product_name, category, unit_price, coalesce(units, 0) AS units_sold,
    coalesce(revenue, 0) AS total_revenue, coalesce(n_orders, 0) AS order_count,
    {half_even("rating_sum / rated")} AS avg_rating, coalesce(n_reviews, 0) AS review_count
  FROM v_products p
  LEFT JOIN (SELECT product_id, sum(quantity) AS units, sum(total_amount) AS revenue, count(order_id) AS n_orders
             FROM v_orders GROUP BY product_id) s ON s.product_id = p.product_id
  LEFT JOIN (SELECT product_id, CAST(sum(rating) AS DOUBLE) AS rating_sum, nullif(count(rating), 0) AS rated, count(*) AS n_reviews
             FROM v_reviews GROUP BY product_id) r ON r.product_id = p.product_id),
edges AS (
  SELECT quantile_cont(CAST(total_revenue AS DOUBLE), 0.25) AS a, quantile_cont(CAST(total_revenue AS DOUBLE), 0.5) AS b,
    quantile_cont(CAST(total_revenue AS DOUBLE), 0.75) AS c FROM totals),
performance AS (
  SELECT totals.*, rank() OVER (PARTITION BY category ORDER BY total_revenue DESC) AS revenue_rank_in_category,
    CASE WHEN CAST(total_revenue AS DOUBLE) <= a THEN 'Bottom 25%' WHEN CAST(total_revenue AS DOUBLE) <= b THEN 'Lower Mid'
      WHEN CAST(total_revenue AS DOUBLE) <= c THEN 'Upper Mid' ELSE 'Top 25%' END AS performance_tier
  FROM totals, edges)"""


def _totals(v):
    return analyses.product_totals(v.orders, v.products, v.reviews)


@entry(
    "a3_product_performance",
    f"""WITH {_PERFORMANCE} SELECT * REPLACE (CAST(unit_price AS DOUBLE) AS unit_price, CAST(units_sold AS BIGINT) AS units_sold,
    CAST(total_revenue AS DOUBLE) AS total_revenue) FROM performance""",
)
def a3_product_performance(v):
    return analyses.product_performance(stage(_totals(v)))


@entry(
    "a3_top15_products",
    f"""WITH {_PERFORMANCE} SELECT product_id, product_name, category, CAST(units_sold AS BIGINT) AS units_sold,
    CAST(total_revenue AS DOUBLE) AS total_revenue, avg_rating, review_count, revenue_rank_in_category
    FROM performance ORDER BY performance.total_revenue DESC, product_id LIMIT 15""",
)
def a3_top15_products(v):
    return analyses.top_products(analyses.product_performance(stage(_totals(v))))


@entry(
    "a3_category_summary",
    f"""WITH {_PERFORMANCE} SELECT category, count(*) AS products, {half_even("sum(total_revenue)")} AS total_revenue,
    {half_even("CAST(sum(CAST(avg_rating AS DECIMAL(9,2))) AS DOUBLE) / count(avg_rating)")} AS avg_rating,
    CAST(sum(units_sold) AS BIGINT) AS total_units FROM totals GROUP BY category""",
)
def a3_category_summary(v):
    return analyses.category_summary(_totals(v))


def _rate(status: str) -> str:
    share = f"CAST(count(*) FILTER (WHERE status = '{status}') AS DOUBLE) / count(*)"
    return half_even(f"{half_even(share, 4)} * 100")


_AMOUNT_MEAN = half_even(half_even("CAST(sum(total_amount) AS DOUBLE) / count(total_amount)", 4))


@entry(
    "a4_discount_impact",
    f"""SELECT discount_tier, count(order_id) AS order_count, {_AMOUNT_MEAN} AS avg_order_value,
    {half_even(half_even("quantile_cont(CAST(total_amount AS DOUBLE), 0.5)", 4))} AS median_order_value,
    {half_even("sum(total_amount)")} AS total_revenue, {_rate("completed")} AS completion_rate,
    {_rate("returned")} AS return_rate, {_rate("cancelled")} AS cancellation_rate
    FROM (SELECT *, CASE WHEN discount_pct <= -0.1 THEN NULL WHEN discount_pct <= 0 THEN 'No discount'
      WHEN discount_pct <= 5 THEN '1–5%' WHEN discount_pct <= 10 THEN '6–10%' WHEN discount_pct <= 15 THEN '11–15%'
      WHEN discount_pct <= 100 THEN '16%+' END AS discount_tier FROM v_orders) t
    WHERE discount_tier IS NOT NULL GROUP BY discount_tier""",
)
def a4_discount_impact(v):
    return analyses.discount_impact(v.orders)


@entry(
    "a4_discount_binary",
    f"""SELECT CASE WHEN discount_pct > 0 THEN 'Has discount' ELSE 'No discount' END AS discount, count(order_id) AS order_count,
    {_AMOUNT_MEAN} AS avg_order_value, {_rate("completed")} AS completion_rate, {_rate("returned")} AS return_rate
    FROM v_orders GROUP BY 1""",
)
def a4_discount_binary(v):
    return analyses.discount_comparison(v.orders)


_SALES = """(SELECT p.product_id, product_name, category, sum(quantity) AS units, sum(total_amount) AS revenue,
  count(quantity) AS quantities, count(order_id) AS order_count
  FROM v_orders s JOIN v_products p ON p.product_id = s.product_id WHERE total_amount IS NOT NULL GROUP BY ALL) t"""


@entry(
    "q1_top_revenue_products",
    f"""SELECT product_id, product_name, category, CAST(units AS BIGINT) AS total_units_sold,
    CAST(revenue AS DOUBLE) AS total_revenue, {half_away(_mean("units", "quantities"))} AS avg_order_quantity, order_count
    FROM {_SALES} ORDER BY revenue DESC, product_id LIMIT 10""",
)
def q1_top_revenue_products(v):
    return reports.top_revenue_products(v.orders, v.products)


@entry(
    "q2_monthly_trend",
    f"""WITH m AS (SELECT strftime(order_date, '%Y-%m') AS month, CAST(sum(total_amount) AS DOUBLE) AS revenue FROM v_orders
      WHERE total_amount IS NOT NULL GROUP BY 1),
    l AS (SELECT *, lag(revenue) OVER (ORDER BY month) AS prev_revenue FROM m)
    SELECT month, revenue, prev_revenue, {half_away("(revenue - prev_revenue) / nullif(prev_revenue, 0) * 100")} AS mom_growth_pct
    FROM l ORDER BY month DESC LIMIT 12""",
)
def q2_monthly_trend(v):
    return reports.monthly_trend(v.orders)


_SPEND = """(SELECT c.customer_id, first_name || ' ' || last_name AS customer_name, loyalty_tier, city,
  count(order_id) AS total_orders, sum(total_amount) AS spent
  FROM v_orders s JOIN v_customers c ON c.customer_id = s.customer_id WHERE total_amount IS NOT NULL GROUP BY ALL) t"""


@entry(
    "q3_customer_ltv",
    f"""SELECT customer_id, customer_name, loyalty_tier, city, total_orders, CAST(spent AS DOUBLE) AS total_spent,
    {half_away(_mean("spent", "total_orders"))} AS avg_order_value, dense_rank() OVER (ORDER BY spent DESC) AS spend_rank
    FROM {_SPEND} ORDER BY spend_rank, customer_id LIMIT 20""",
)
def q3_customer_ltv(v):
    return reports.customer_lifetime_value(v.orders, v.customers)


@entry(
    "q4_category_running_total",
    """SELECT category, month, CAST(monthly AS DOUBLE) AS monthly_revenue, CAST(sum(monthly) OVER (PARTITION BY category
    ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_total
    FROM (SELECT category, strftime(order_date, '%Y-%m') AS month, sum(total_amount) AS monthly
      FROM v_orders s JOIN v_products p ON p.product_id = s.product_id WHERE total_amount IS NOT NULL GROUP BY ALL) t
    ORDER BY category, month""",
)
def q4_category_running_total(v):
    return reports.category_running_total(v.orders, v.products)


@entry(
    "q5_rating_vs_revenue",
    f"""SELECT p.product_id, product_name, category, avg_rating, review_count, CAST(revenue AS DOUBLE) AS total_revenue,
    CAST(units AS BIGINT) AS total_units_sold, order_count FROM v_products p
    JOIN (SELECT product_id, {half_away("sum(rating) / count(rating)")} AS avg_rating, count(review_id) AS review_count
          FROM v_reviews WHERE rating IS NOT NULL GROUP BY product_id) r ON r.product_id = p.product_id
    JOIN (SELECT product_id, sum(total_amount) AS revenue, sum(quantity) AS units, count(order_id) AS order_count
          FROM v_orders WHERE total_amount IS NOT NULL GROUP BY product_id) s ON s.product_id = p.product_id
    ORDER BY avg_rating DESC, p.product_id""",
)
def q5_rating_vs_revenue(v):
    return reports.rating_vs_revenue(v.orders, v.products, v.reviews)


@entry(
    "q6_repeat_rate_by_tier",
    f"""SELECT loyalty_tier, count(*) AS total_customers, count(*) FILTER (WHERE n > 1) AS repeat_customers,
    {half_away("CAST(count(*) FILTER (WHERE n > 1) AS DOUBLE) / count(*) * 100")} AS repeat_purchase_rate_pct,
    {half_away("CAST(sum(n) AS DOUBLE) / count(*)")} AS avg_orders_per_customer
    FROM (SELECT customer_id, count(order_id) AS n FROM v_orders GROUP BY customer_id) o
    JOIN v_customers c ON c.customer_id = o.customer_id GROUP BY loyalty_tier""",
)
def q6_repeat_rate_by_tier(v):
    return reports.repeat_rate_by_tier(v.orders, v.customers)


@entry(
    "q7_inventory_turnover",
    f"""SELECT product_id, product_name, category, CAST(stock_quantity AS BIGINT) AS current_stock, CAST(units AS BIGINT) AS units_sold,
    {half_away("ratio")} AS turnover_ratio, CASE WHEN stock_quantity = 0 THEN 'Out of Stock' WHEN ratio > 5 THEN 'Fast Moving'
      WHEN ratio < 0.5 THEN 'Slow Moving' ELSE 'Healthy' END AS inventory_flag
    FROM (SELECT *, CAST(units AS DOUBLE) / nullif(CAST(stock_quantity AS DOUBLE), 0) AS ratio
      FROM (SELECT p.product_id, product_name, category, stock_quantity, coalesce(sold, 0) AS units FROM v_products p
        LEFT JOIN (SELECT product_id, sum(quantity) AS sold FROM v_orders GROUP BY product_id) s
          ON s.product_id = p.product_id) a) b
    ORDER BY turnover_ratio DESC NULLS LAST, product_id""",
)
def q7_inventory_turnover(v):
    return reports.inventory_turnover(v.orders, v.products)


_KPIS = f"""SELECT CAST(coalesce(sum(total_amount), 0) AS DOUBLE) AS total_revenue, count(*) AS total_orders,
    (SELECT count(*) FROM v_customers) AS total_customers, (SELECT count(*) FROM v_products) AS total_products,
    coalesce({half_away("CAST(sum(total_amount) AS DOUBLE) / count(total_amount)")}, 0) AS avg_order_value FROM v_orders"""


@entry("m_kpis", _KPIS)
def m_kpis(v):
    return metrics.key_figures(v.orders, v.customers, v.products)


_TOP_PRODUCTS = f"""SELECT product_id, product_name, category, CAST(revenue AS DOUBLE) AS total_revenue,
    CAST(units AS BIGINT) AS units_sold FROM {_SALES} ORDER BY revenue DESC, product_id LIMIT 5"""
_TOP_CUSTOMERS = f"""SELECT customer_id, customer_name, total_orders, CAST(spent AS DOUBLE) AS total_spent
    FROM {_SPEND} ORDER BY spent DESC, customer_id LIMIT 5"""
_STATUSES = f"""SELECT status, orders, {half_away("CAST(orders AS DOUBLE) / sum(orders) OVER () * 100")} AS pct
    FROM (SELECT status, count(*) AS orders FROM v_orders GROUP BY status) t"""


@entry("m_top5_products", _TOP_PRODUCTS)
def m_top5_products(v):
    return metrics.top_products(v.orders, v.products)


@entry("m_top5_customers", _TOP_CUSTOMERS)
def m_top5_customers(v):
    return metrics.top_customers(v.orders, v.customers)


@entry("m_status_distribution", _STATUSES)
def m_status_distribution(v):
    return metrics.status_distribution(v.orders)


@entry(
    "m_summary",
    f"""SELECT k.*,
    (SELECT string_agg(product_id || ' ' || product_name || ' ' || category || ' ' || CAST(total_revenue AS DECIMAL(18,2))
      || ' ' || units_sold, '; ' ORDER BY total_revenue DESC, product_id) FROM ({_TOP_PRODUCTS}) a) AS top_5_products,
    (SELECT string_agg(customer_id || ' ' || customer_name || ' ' || total_orders || ' ' || CAST(total_spent AS DECIMAL(18,2)),
      '; ' ORDER BY total_spent DESC, customer_id) FROM ({_TOP_CUSTOMERS}) b) AS top_5_customers,
    (SELECT string_agg(status || ' ' || orders || ' ' || CAST(pct AS DECIMAL(18,2)), '; ' ORDER BY orders DESC, status)
      FROM ({_STATUSES}) c) AS order_status_dist FROM ({_KPIS}) k""",
)
def m_summary(v):
    """The nested lists are written out as text, one entry per row of the list."""

    def text(column, *fields):
        def line(r):
            parts = [r[f].cast("decimal(18,2)").cast("string") if money else r[f].cast("string") for f, money in fields]
            return F.concat_ws(" ", *parts)

        return F.array_join(F.transform(column, line), "; ").alias(column)

    return metrics.summary(v.orders, v.customers, v.products).select(
        "total_revenue",
        "total_orders",
        "total_customers",
        "total_products",
        "avg_order_value",
        text("top_5_products", ("product_id", 0), ("product_name", 0), ("category", 0), ("total_revenue", 1), ("units_sold", 0)),
        text("top_5_customers", ("customer_id", 0), ("customer_name", 0), ("total_orders", 0), ("total_spent", 1)),
        text("order_status_dist", ("status", 0), ("orders", 0), ("pct", 1)),
    )
