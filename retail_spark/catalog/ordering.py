"""Windows, sorting, top-k, paging and distinct sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from retail_spark.catalog.registry import entry
from retail_spark.functions.expressions import growth_pct, round_half_away, year_month
from retail_spark.operators import ordering
from retail_spark.operators.aggregates import sales_by, with_amount
from retail_spark.operators.dedup import first_per_key
from retail_spark.operators.ranking import rank_descending
from retail_spark.operators.referential import distinct_keys, unexpected_values
from retail_spark.plans.reports import (
    category_running_total,
    inventory_turnover,
    monthly_category_revenue,
    monthly_revenue,
)
from retail_spark.schemas import LOYALTY_TIERS
from retail_spark.sources.scratch import stage

_MONTHS = """SELECT strftime(order_date, '%Y-%m') AS month, CAST(sum(total_amount) AS DOUBLE) AS revenue FROM v_orders
    WHERE total_amount IS NOT NULL GROUP BY ALL"""


@entry(
    "window_lag",
    f"""SELECT month, revenue, lag(revenue) OVER (ORDER BY month) AS prev_revenue,
    CAST(round(CAST((revenue - lag(revenue) OVER (ORDER BY month)) / lag(revenue) OVER (ORDER BY month) * 100
      AS DECIMAL(38,6)), 2) AS DOUBLE) AS growth FROM ({_MONTHS}) t""",
)
def window_lag(v):
    months = monthly_revenue(v.orders).withColumn("revenue", F.col("revenue").cast("double"))
    previous = F.lag("revenue").over(Window.orderBy("month"))
    return months.select(
        year_month(F.col("month")).alias("month"),
        "revenue",
        previous.alias("prev_revenue"),
        round_half_away(growth_pct(F.col("revenue"), previous)).alias("growth"),
    )


@entry(
    "window_dense_rank",
    """SELECT customer_id, CAST(spent AS DOUBLE) AS spent, dense_rank() OVER (ORDER BY spent DESC) AS spend_rank FROM
    (SELECT customer_id, sum(total_amount) AS spent FROM v_orders WHERE total_amount IS NOT NULL GROUP BY customer_id) t""",
)
def window_dense_rank(v):
    spent = with_amount(v.orders).groupBy("customer_id").agg(F.sum("total_amount").alias("spent"))
    return rank_descending(stage(spent), "spent", "spend_rank", dense=True)


@entry(
    "window_running_sum",
    """SELECT category, month, CAST(monthly_revenue AS DOUBLE) AS monthly_revenue, CAST(sum(monthly_revenue) OVER
    (PARTITION BY category ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_total
    FROM (SELECT category, strftime(order_date, '%Y-%m') AS month, sum(total_amount) AS monthly_revenue
      FROM v_orders JOIN v_products ON v_orders.product_id = v_products.product_id
      WHERE total_amount IS NOT NULL GROUP BY ALL) t""",
)
def window_running_sum(v):
    return category_running_total(v.orders, v.products)


@entry(
    "window_rank_min",
    """SELECT product_id, category, CAST(units AS BIGINT) AS units,
    rank() OVER (PARTITION BY category ORDER BY units DESC) AS units_rank FROM
    (SELECT p.product_id, category, coalesce(sum(quantity), 0) AS units FROM v_products p
     LEFT JOIN v_orders s ON s.product_id = p.product_id GROUP BY ALL) t""",
)
def window_rank_min(v):
    sold = v.orders.groupBy("product_id").agg(F.sum("quantity").alias("units"))
    units = v.products.select("product_id", "category").join(sold, "product_id", "left").fillna(0, ["units"])
    return rank_descending(stage(units), "units", "units_rank", by=["category"])


@entry(
    "window_pct_change",
    f"""SELECT month, (revenue - lag(revenue) OVER (ORDER BY month)) / nullif(lag(revenue) OVER (ORDER BY month), 0) * 100
    AS change_pct FROM ({_MONTHS}) t""",
)
def window_pct_change(v):
    months = monthly_revenue(v.orders).withColumn("revenue", F.col("revenue").cast("double"))
    previous = F.lag("revenue").over(Window.orderBy("month"))
    return months.select(
        year_month(F.col("month")).alias("month"), growth_pct(F.col("revenue"), previous).alias("change_pct")
    )


@entry(
    "window_row_first",
    """SELECT user_id, event_id, event_type, value FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) t WHERE rn = 1""",
)
def window_row_first(v):
    events = v.table("events").select("user_id", "event_id", "event_type", "value", F.struct("ts", "event_id").alias("o"))
    return first_per_key(events, ["user_id"], "o").drop("o")


@entry(
    "sort_asc_multi",
    """SELECT category, strftime(order_date, '%Y-%m') AS month, CAST(sum(total_amount) AS DOUBLE) AS revenue
    FROM v_orders JOIN v_products ON v_orders.product_id = v_products.product_id
    WHERE total_amount IS NOT NULL GROUP BY ALL ORDER BY category, month""",
)
def sort_asc_multi(v):
    monthly = monthly_category_revenue(v.orders, v.products).orderBy("category", "month")
    return monthly.select("category", year_month(F.col("month")).alias("month"), F.col("monthly_revenue").alias("revenue"))


@entry(
    "sort_desc_nulls_last",
    """SELECT product_id, CAST(round(CAST(CAST(units AS DOUBLE) / nullif(stock_quantity, 0) AS DECIMAL(38,6)), 2) AS DOUBLE)
    AS turnover_ratio FROM (SELECT p.product_id, stock_quantity, coalesce(sum(quantity), 0) AS units FROM v_products p
    LEFT JOIN v_orders s ON s.product_id = p.product_id GROUP BY ALL) t
    ORDER BY turnover_ratio DESC NULLS LAST, product_id""",
)
def sort_desc_nulls_last(v):
    return inventory_turnover(v.orders, v.products).select("product_id", "turnover_ratio")


@entry(
    "topk_limit",
    """SELECT customer_id, CAST(spent AS DOUBLE) AS spent, orders FROM
    (SELECT customer_id, sum(total_amount) AS spent, count(order_id) AS orders FROM v_orders
     WHERE total_amount IS NOT NULL GROUP BY customer_id) t ORDER BY spent DESC, customer_id LIMIT 10""",
)
def topk_limit(v):
    spend = sales_by(with_amount(v.orders), "customer_id").select(
        "customer_id", F.col("revenue").alias("spent"), F.col("order_count").alias("orders")
    )
    return ordering.top_k(spend, "spent", 10, "customer_id")


@entry(
    "topk_nlargest",
    "SELECT order_id, o_totalprice FROM (SELECT o_orderkey AS order_id, o_totalprice FROM orders) t "
    "ORDER BY o_totalprice DESC, order_id LIMIT 15",
)
def topk_nlargest(v):
    priced = v.table("orders").select(F.col("o_orderkey").alias("order_id"), "o_totalprice")
    return ordering.top_k(priced, "o_totalprice", 15, "order_id")


@entry(
    "page_newest_first",
    """SELECT event_id, event_type, value, (SELECT count(*) FROM events) AS total FROM events
    ORDER BY event_id DESC LIMIT 100 OFFSET 200""",
)
def page_newest_first(v):
    events = v.table("events")
    page = ordering.page_newest_first(events.select("event_id", "event_type", "value"), "event_id", 100, 200)
    return page.withColumn("total", events.agg(F.count("*")).scalar())


@entry("retain_last_n", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 1000")
def retain_last_n(v):
    return ordering.retain_newest(v.table("events").select("event_id", "user_id", "event_type"), "event_id")


@entry(
    "result_preview",
    """WITH head AS (SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, coalesce(CAST(p_size AS VARCHAR), 'None') AS p_size,
      row_number() OVER (ORDER BY p_partkey) AS n FROM part ORDER BY part.p_partkey LIMIT 20),
    w AS (SELECT greatest(max(length(p_partkey)), 9) AS a, greatest(max(length(p_name)), 6) AS b,
      greatest(max(length(p_size)), 6) AS c FROM head)
    SELECT 0 AS line_no, rpad('p_partkey', CAST(a AS INTEGER), ' ') || ' | ' || rpad('p_name', CAST(b AS INTEGER), ' ') || ' | '
      || rpad('p_size', CAST(c AS INTEGER), ' ') AS line FROM w
    UNION ALL SELECT 1, repeat('-', a) || '-+-' || repeat('-', b) || '-+-' || repeat('-', c) FROM w
    UNION ALL SELECT n + 1, rpad(p_partkey, CAST(a AS INTEGER), ' ') || ' | ' || rpad(p_name, CAST(b AS INTEGER), ' ') || ' | '
      || rpad(p_size, CAST(c AS INTEGER), ' ') FROM head, w""",
)
def result_preview(v):
    return ordering.preview_lines(v.table("part").select("p_partkey", "p_name", "p_size"), [F.col("p_partkey")])


@entry("set_distinct_keys", "SELECT DISTINCT product_id FROM v_orders")
def set_distinct_keys(v):
    return distinct_keys(v.orders, "product_id")


@entry(
    "set_distinct_values",
    """SELECT DISTINCT loyalty_tier FROM r_customers
    WHERE loyalty_tier IS NULL OR loyalty_tier NOT IN ('platinum', 'gold', 'silver', 'bronze', 'none')""",
)
def set_distinct_values(v):
    return unexpected_values(v.customers_raw, "loyalty_tier", LOYALTY_TIERS)
