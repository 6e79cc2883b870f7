"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from retail_spark.catalog.oracle_views import half_away, half_even, iso
from retail_spark.catalog.registry import entry
from retail_spark.functions import expressions as x
from retail_spark.operators.ranking import quantile_columns
from retail_spark.plans.analyses import DISCOUNT_EDGES, DISCOUNT_TIERS, PERFORMANCE_TIERS, QUARTILES, SEGMENT_EDGES, SEGMENTS
from retail_spark.schemas import ORDER_STATUSES
from retail_spark.sources.scratch import stage


@entry("expr_year_month", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def expr_year_month(v):
    return v.table("orders").select("o_orderkey", x.year_month(F.col("o_orderdate")).alias("month"))


def _shifted(months: int) -> str:
    # The first of the target month plus the days since the first of the month.
    start = f"date_trunc('month', CAST(o_orderdate AS DATE)) - INTERVAL {months} MONTH"
    return iso(f"CAST({start} AS DATE) + CAST(day(o_orderdate) - 1 AS INTEGER)")


@entry(
    "expr_date_shift_months",
    f"SELECT o_orderkey, {_shifted(6)} AS six_back, {_shifted(1)} AS one_back, {_shifted(12)} AS year_back FROM orders",
)
def expr_date_shift_months(v):
    d = F.col("o_orderdate").cast("date")
    return v.table("orders").select(
        "o_orderkey",
        x.shift_months(d, -6).alias("six_back"),
        x.shift_months(d, -1).alias("one_back"),
        x.shift_months(d, -12).alias("year_back"),
    )


@entry(
    "expr_days_between",
    """SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders))
    AS days FROM orders""",
)
def expr_days_between(v):
    orders = v.table("orders")
    d = F.col("o_orderdate").cast("date")
    dated = orders.select("o_orderkey", d.alias("d"), orders.agg(F.max(d)).scalar().alias("latest"))
    return dated.select("o_orderkey", x.days_between(F.col("latest"), F.col("d")).alias("days"))


@entry(
    "expr_bin_right_closed",
    """SELECT 'discount' AS what, order_id AS id, CASE WHEN discount_pct <= -0.1 THEN NULL WHEN discount_pct <= 0 THEN 'No discount'
      WHEN discount_pct <= 5 THEN '1–5%' WHEN discount_pct <= 10 THEN '6–10%' WHEN discount_pct <= 15 THEN '11–15%'
      WHEN discount_pct <= 100 THEN '16%+' END AS bin FROM v_orders
    UNION ALL SELECT 'recency', o_orderkey, CASE WHEN d <= 90 THEN 'Active' WHEN d <= 180 THEN 'At Risk' ELSE 'Churned' END
    FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS d FROM orders) t
    WHERE d > -1""",
)
def expr_bin_right_closed(v):
    days = x.days_between(F.lit("2001-08-01").cast("date"), F.col("o_orderdate").cast("date"))
    tiers = v.orders.select(
        F.lit("discount").alias("what"),
        F.col("order_id").alias("id"),
        x.bin_right_closed(F.col("discount_pct"), DISCOUNT_EDGES, DISCOUNT_TIERS).alias("bin"),
    )
    recency = v.table("orders").select(
        F.lit("recency").alias("what"),
        F.col("o_orderkey").alias("id"),
        x.bin_right_closed(days, SEGMENT_EDGES, SEGMENTS).alias("bin"),
    )
    return tiers.unionByName(recency)


@entry(
    "expr_quantile_tier",
    """WITH t AS (SELECT customer_id, CAST(sum(total_amount) AS DOUBLE) AS spent FROM v_orders WHERE total_amount IS NOT NULL
      GROUP BY customer_id),
    e AS (SELECT quantile_cont(spent, 0.25) AS a, quantile_cont(spent, 0.5) AS b, quantile_cont(spent, 0.75) AS c FROM t)
    SELECT customer_id, spent, CASE WHEN spent <= a THEN 'Bottom 25%' WHEN spent <= b THEN 'Lower Mid'
      WHEN spent <= c THEN 'Upper Mid' ELSE 'Top 25%' END AS tier FROM t, e""",
)
def expr_quantile_tier(v):
    spent = stage(
        v.orders.where("total_amount IS NOT NULL").groupBy("customer_id").agg(F.sum("total_amount").alias("spent"))
    )
    names = list(QUARTILES)
    edges = quantile_columns(spent, "spent", QUARTILES).select(F.struct(*names)).scalar()
    return spent.withColumn("e", edges).select(
        "customer_id",
        "spent",
        x.tier_by_edges(F.col("spent").cast("double"), [F.col(f"e.{n}") for n in names], PERFORMANCE_TIERS).alias("tier"),
    )


@entry(
    "expr_round_half_away",
    f"SELECT event_id, {half_away('value * 0.125')} AS eighth, {half_away('value / 3', 1)} AS third FROM events",
)
def expr_round_half_away(v):
    value = F.col("value")
    return v.table("events").select(
        "event_id",
        x.round_half_away(value * 0.125).alias("eighth"),
        x.round_half_away(value / 3, 1).alias("third"),
    )


@entry(
    "expr_round_half_even",
    f"SELECT event_id, {half_even('value * 0.125')} AS eighth, {half_even('value / 3', 4)} AS third FROM events",
)
def expr_round_half_even(v):
    value = F.col("value")
    return v.table("events").select(
        "event_id",
        x.round_half_even(value * 0.125).alias("eighth"),
        x.round_half_even(value / 3, 4).alias("third"),
    )


@entry(
    "expr_safe_divide",
    "SELECT product_id, CAST(unit_price AS DOUBLE) / nullif(CAST(stock_quantity AS DOUBLE), 0) AS per_item FROM v_products",
)
def expr_safe_divide(v):
    return v.products.select("product_id", x.safe_divide(F.col("unit_price"), F.col("stock_quantity")).alias("per_item"))


@entry(
    "expr_coalesce",
    """SELECT order_id, CAST(coalesce(total_amount, 0) AS DOUBLE) AS amount,
    coalesce(shipping_address_city, 'unknown') AS city FROM v_orders""",
)
def expr_coalesce(v):
    return v.orders.select(
        "order_id",
        F.coalesce("total_amount", F.lit(0)).alias("amount"),
        F.coalesce("shipping_address_city", F.lit("unknown")).alias("city"),
    )


@entry(
    "expr_case_flag",
    """SELECT order_id, CASE WHEN stock_quantity = 0 THEN 'Out of Stock'
      WHEN CAST(quantity AS DOUBLE) / stock_quantity > 5 THEN 'Fast Moving'
      WHEN CAST(quantity AS DOUBLE) / stock_quantity < 0.5 THEN 'Slow Moving' ELSE 'Healthy' END AS flag
    FROM v_orders JOIN v_products ON v_orders.product_id = v_products.product_id""",
)
def expr_case_flag(v):
    ratio = x.safe_divide(F.col("quantity"), F.col("stock_quantity"))
    joined = v.orders.join(v.products.select("product_id", "stock_quantity"), "product_id")
    return joined.select("order_id", x.stock_flag(F.col("stock_quantity"), ratio).alias("flag"))


@entry(
    "expr_concat_name",
    "SELECT customer_id, first_name || ' ' || last_name AS name, email || ' ' || postal_code AS contact FROM v_customers",
)
def expr_concat_name(v):
    return v.customers.select(
        "customer_id",
        x.full_name(F.col("first_name"), F.col("last_name")).alias("name"),
        x.full_name(F.col("email"), F.col("postal_code")).alias("contact"),
    )


@entry(
    "expr_regex_match",
    r"""SELECT src_ord, regexp_matches(created_date, '^\d{4}-\d{2}-\d{2}$') AS is_iso, contains(product_name, '<') AS has_markup
    FROM r_products""",
)
def expr_regex_match(v):
    return v.products_raw.select(
        "src_ord",
        F.col("created_date").rlike(r"^\d{4}-\d{2}-\d{2}$").alias("is_iso"),
        F.col("product_name").contains("<").alias("has_markup"),
    )


@entry(
    "expr_bool_flags",
    """SELECT order_id, CAST(status = 'completed' AS BIGINT) AS is_completed, CAST(status = 'returned' AS BIGINT) AS is_returned,
    CAST(status = 'cancelled' AS BIGINT) AS is_cancelled, discount_pct > 0 AS has_discount FROM v_orders""",
)
def expr_bool_flags(v):
    status = F.col("status")
    return v.orders.select(
        "order_id",
        *[x.flag(status == s).alias(f"is_{s}") for s in ("completed", "returned", "cancelled")],
        (F.col("discount_pct") > 0).alias("has_discount"),
    )


@entry(
    "expr_in_set",
    """SELECT order_id, status, status IN ('completed', 'shipped', 'processing', 'pending', 'returned', 'cancelled', 'delivered')
    AS known FROM r_orders""",
)
def expr_in_set(v):
    return v.orders_raw.select("order_id", "status", F.col("status").isin(*ORDER_STATUSES).alias("known"))


@entry(
    "expr_elapsed_ms",
    f"""SELECT user_id, {half_away("CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1000")} AS elapsed_ms
    FROM events GROUP BY user_id""",
)
def expr_elapsed_ms(v):
    spans = v.table("events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return spans.select("user_id", x.elapsed_ms(F.col("first"), F.col("last")).alias("elapsed_ms"))
