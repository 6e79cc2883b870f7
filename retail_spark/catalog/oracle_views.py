"""The views of ``sources.bindings`` and the cleaned tables, in ANSI SQL.

``v_*`` are the clean views, ``r_*`` the raw ones, ``c_*`` the cleaned tables and
``k_*`` the facts that are left once orphans are gone.  They are written
independently of the Spark code: windows for first-per-key, ``strptime`` formats
for dates, letter lists for title case.
"""

from __future__ import annotations

import re


def date_of(x: str, day_first: bool = False) -> str:
    slash, dash = ("'%m/%d/%Y', '%d/%m/%Y'", "'%m-%d-%Y', '%d-%m-%Y'")
    if day_first:
        slash, dash = ("'%d/%m/%Y', '%m/%d/%Y'", "'%d-%m-%Y', '%m-%d-%Y'")
    formats = f"['%Y-%m-%d', {slash}, {dash}, '%d %b %Y', '%b %d, %Y', '%B %d, %Y', '%B %d %Y']"
    return f"CAST(try_strptime(trim({x}), {formats}) AS DATE)"


def title(x: str) -> str:
    words = rf"regexp_extract_all(trim({x}), '\p{{L}}+|\P{{L}}+')"
    return f"array_to_string(list_transform({words}, lambda w: upper(w[1]) || lower(w[2:])), '')"


def money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


def half_away(x: str, places: int = 2) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,6)), {places}) AS DOUBLE)"


def half_even(x: str, places: int = 2) -> str:
    scale = float(10**places)
    return f"(round_even(CAST({x} AS DOUBLE) * {scale}, 0) / {scale})"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def rating_value(x: str) -> str:
    text = f"lower(trim({x}))"
    return f"""CASE {text} WHEN 'one' THEN 1 WHEN 'two' THEN 2 WHEN 'three' THEN 3 WHEN 'four' THEN 4
    WHEN 'five' THEN 5 ELSE CASE WHEN contains({text}, '/')
      THEN try_cast(split_part({text}, '/', 1) AS DOUBLE) / nullif(try_cast(split_part({text}, '/', 2) AS DOUBLE), 0) * 5
      ELSE try_cast({text} AS DOUBLE) END END"""


def rating(x: str) -> str:
    value = rating_value(x)
    return f"CASE WHEN ({value}) IS NOT NULL THEN round(least(greatest({value}, 1.0), 5.0), 2) END"


def status(x: str) -> str:
    return f"""CASE lower(trim({x})) WHEN 'complete' THEN 'completed' WHEN 'canceled' THEN 'cancelled'
    ELSE lower(trim({x})) END"""


def payment(x: str) -> str:
    return f"""CASE lower(trim({x})) WHEN 'applepay' THEN 'apple_pay' WHEN 'credit card' THEN 'credit_card'
    ELSE lower(trim({x})) END"""


def flag(x: str, yes: str = "'true','yes','1'", no: str = "'false','no','0'") -> str:
    return f"CASE WHEN lower(trim({x})) IN ({yes}) THEN true WHEN lower(trim({x})) IN ({no}) THEN false END"


def verified(x: str) -> str:
    return flag(x, "'true','yes','y','1'", "'false','no','n','0'")


LINE_ORDER = ", ".join(f"s{i} NULLS FIRST" for i in range(1, 11))

VIEWS = {
    "v_products": """
SELECT p_partkey AS product_id, 'SKU-' || p_partkey AS sku, p_name AS product_name, lower(p_type) AS category,
       CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price, p_size % 10 AS stock_quantity,
       CASE WHEN p_partkey % 19 <> 0 THEN CAST(p_size AS DOUBLE) / 4 END AS weight_kg,
       DATE '2020-01-01' + CAST(p_partkey % 1000 AS INTEGER) AS created_date
FROM part""",
    "v_customers": """
SELECT c_custkey AS customer_id, split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
       CASE WHEN c_custkey % 50 <> 0 THEN 'c' || c_custkey || '@example.com' END AS email,
       c_custkey % 50 <> 0 AS has_email, '+00' || c_custkey AS phone, n_name AS city, r_name AS country,
       CASE WHEN c_custkey % 67 <> 0 THEN 'P' || (c_custkey % 900) END AS postal_code,
       DATE '2018-01-01' + CAST(c_custkey % 1500 AS INTEGER) AS signup_date,
       c_acctbal >= 0 AS is_active, lower(c_mktsegment) AS loyalty_tier
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_lines": """
SELECT l_orderkey AS order_id, o_custkey AS customer_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price,
       CASE WHEN l_orderkey % 37 <> 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2))
            * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) END AS total_amount,
       CAST(o_orderdate AS DATE) AS order_date,
       CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_returnflag = 'A' THEN 'cancelled'
            WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS status,
       o_orderpriority AS payment_method,
       CASE WHEN l_orderkey % 23 <> 0 THEN 'City ' || (o_custkey % 25) END AS shipping_address_city,
       CAST(CAST(l_discount AS DECIMAL(4,2)) * 200 AS DOUBLE) AS discount_pct,
       l_linenumber AS s1, l_partkey AS s2, l_suppkey AS s3, l_quantity AS s4, l_extendedprice AS s5, l_discount AS s6,
       l_tax AS s7, l_returnflag AS s8, l_linestatus AS s9, l_shipdate AS s10
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_orders": """
SELECT order_id, customer_id, product_id, quantity, unit_price, total_amount, order_date, status, payment_method,
       shipping_address_city, discount_pct FROM v_lines""",
    "v_reviews": """
SELECT event_id AS review_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id, user_id AS customer_id,
       CASE WHEN event_id % 41 <> 0 THEN CAST(1 + event_id % 5 AS DOUBLE) END AS rating,
       CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN '  ' ELSE event_type || ' note' END AS review_text,
       event_id % 13 <> 0 AND event_id % 17 <> 0 AS has_review_text,
       CAST(ts AS DATE) AS review_date, event_type = 'purchase' AS verified_purchase,
       CAST(floor(value) AS INTEGER) AS helpful_votes
FROM events""",
    "r_orders": """
SELECT CAST(order_id AS VARCHAR) AS order_id,
       CASE WHEN order_id % 101 <> 0 THEN CAST(customer_id AS VARCHAR) END AS customer_id,
       CAST(CASE WHEN order_id % 97 = 0 THEN product_id + 10000000 ELSE product_id END AS VARCHAR) AS product_id,
       CASE WHEN order_id % 89 = 0 THEN '0' ELSE CAST(quantity AS VARCHAR) END AS quantity,
       CASE order_id % 3 WHEN 0 THEN '$' || unit_price WHEN 1 THEN 'AED ' || unit_price ELSE unit_price || ' USD' END
         AS unit_price,
       CASE WHEN order_id % 41 = 0 THEN 'AED ' || total_amount ELSE CAST(total_amount AS VARCHAR) END AS total_amount,
       CASE WHEN order_id % 211 = 0 THEN 'not known' ELSE
       CASE order_id % 5 WHEN 0 THEN strftime(order_date, '%Y-%m-%d') WHEN 1 THEN strftime(order_date, '%d/%m/%Y')
            WHEN 2 THEN strftime(order_date, '%m-%d-%Y') WHEN 3 THEN strftime(order_date, '%-d %b %Y')
            ELSE strftime(order_date, '%B %-d, %Y') END END AS order_date,
       CASE order_id % 4 WHEN 0 THEN upper(status)
            WHEN 1 THEN CASE status WHEN 'completed' THEN 'complete' WHEN 'cancelled' THEN 'Canceled' ELSE status END
            WHEN 2 THEN '  ' || upper(status[1]) || status[2:] || ' ' ELSE status END AS status,
       CASE payment_method WHEN '1-URGENT' THEN 'ApplePay' WHEN '2-HIGH' THEN 'Credit Card' WHEN '3-MEDIUM' THEN 'PAYPAL'
            WHEN '4-NOT SPECIFIED' THEN ' bank_transfer ' WHEN '5-LOW' THEN 'cash_on_delivery' END AS payment_method,
       shipping_address_city,
       CASE WHEN order_id % 3 <> 1 THEN CAST(CAST(discount_pct AS INTEGER) AS VARCHAR) END AS discount_pct,
       s1, s2, s3, s4, s5, s6, s7, s8, s9, s10
FROM v_lines""",
    "r_products": """
SELECT CAST(product_id AS VARCHAR) AS product_id,
       'SKU-' || (CASE WHEN product_id % 17 = 0 AND product_id > 0 THEN product_id - 1 ELSE product_id END) AS sku,
       CASE WHEN product_id % 7 = 0 THEN '<b>' || padded || '</b>' ELSE padded END AS product_name,
       CASE WHEN product_id % 11 <> 0 THEN upper(category[1]) || category[2:] END AS category,
       CASE WHEN product_id % 13 = 0 THEN '-' || unit_price ELSE CAST(unit_price AS VARCHAR) END AS unit_price,
       CASE WHEN product_id % 23 = 0 THEN '-10' WHEN product_id % 29 = 0 THEN NULL
            ELSE CAST(stock_quantity AS VARCHAR) END AS stock_quantity,
       CAST(weight_kg AS VARCHAR) AS weight_kg,
       CASE product_id % 2 WHEN 0 THEN strftime(created_date, '%Y-%m-%d')
            ELSE strftime(created_date, '%m/%d/%Y') END AS created_date,
       product_id AS src_ord
FROM (SELECT *, CASE WHEN product_id % 3 = 0 THEN '  ' || cased || ' ' ELSE cased END AS padded
      FROM (SELECT *, CASE WHEN product_id % 5 = 0 THEN upper(product_name) ELSE product_name END AS cased
            FROM v_products) a) b""",
    "r_customers": """
SELECT CAST(CASE WHEN customer_id % 53 = 0 AND customer_id > 0 THEN customer_id - 1 ELSE customer_id END AS VARCHAR)
         AS customer_id,
       CASE WHEN customer_id % 7 = 0 THEN ' ' || upper(email) ELSE email END AS email, phone,
       CASE customer_id % 3 WHEN 0 THEN strftime(signup_date, '%Y-%m-%d') WHEN 1 THEN strftime(signup_date, '%b %-d, %Y')
            ELSE strftime(signup_date, '%d-%m-%Y') END AS signup_date,
       CASE WHEN is_active THEN CASE customer_id % 2 WHEN 0 THEN 'true' ELSE 'yes' END
            ELSE CASE customer_id % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'no' ELSE '0' END END AS is_active,
       CASE loyalty_tier WHEN 'automobile' THEN 'Platinum' WHEN 'building' THEN ' gold ' WHEN 'furniture' THEN 'SILVER'
            WHEN 'household' THEN 'bronze' END AS loyalty_tier,
       CASE customer_id % 3 WHEN 0 THEN upper(first_name) WHEN 1 THEN lower(first_name) ELSE first_name END AS first_name,
       'No-' || last_name AS last_name, lower(city) AS city, upper(country) AS country, postal_code,
       customer_id AS src_ord
FROM v_customers""",
    "r_reviews": """
SELECT CAST(CASE WHEN review_id % 29 = 0 AND review_id > 0 THEN review_id - 1 ELSE review_id END AS VARCHAR) AS review_id,
       CAST(CASE WHEN review_id % 19 = 0 THEN product_id + 10000000 ELSE product_id END AS VARCHAR) AS product_id,
       CAST(customer_id AS VARCHAR) AS customer_id,
       CASE review_id % 6 WHEN 0 THEN CAST(CAST(rating AS INTEGER) AS VARCHAR) WHEN 1 THEN CAST(rating AS INTEGER) || '.0'
            WHEN 2 THEN CAST(rating AS INTEGER) || '/5' WHEN 3 THEN 'four' WHEN 4 THEN '5.3' ELSE 'junk' END AS rating,
       review_text,
       CASE review_id % 3 WHEN 0 THEN strftime(review_date, '%Y-%m-%d') WHEN 1 THEN strftime(review_date, '%d/%m/%Y')
            ELSE strftime(review_date, '%-d %b %Y') END AS review_date,
       CASE review_id % 6 WHEN 0 THEN 'Y' WHEN 1 THEN 'yes' WHEN 2 THEN 'True' WHEN 3 THEN '0' WHEN 4 THEN 'N' ELSE '?' END
         AS verified_purchase,
       CASE WHEN review_id % 9 <> 0 THEN CAST(helpful_votes AS VARCHAR) END AS helpful_votes,
       review_id AS src_ord
FROM v_reviews""",
    "c_orders": f"""
SELECT order_id, customer_id, product_id, CAST(quantity AS INTEGER) AS quantity,
       try_cast(regexp_replace(unit_price, '[^0-9.]', '', 'g') AS DECIMAL(18,2)) AS unit_price,
       try_cast(total_amount AS DECIMAL(18,2)) AS total_amount, {date_of("order_date")} AS order_date,
       {status("status")} AS status, {payment("payment_method")} AS payment_method, shipping_address_city,
       coalesce(try_cast(discount_pct AS DOUBLE), 0.0) AS discount_pct
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY {LINE_ORDER}) AS rn FROM r_orders) t
WHERE rn = 1 AND customer_id IS NOT NULL AND product_id IS NOT NULL AND try_cast(quantity AS DOUBLE) > 0""",
    "c_customers": f"""
SELECT customer_id, {title("first_name")} AS first_name, {title("last_name")} AS last_name,
       lower(trim(email)) AS email, email IS NOT NULL AS has_email, phone, {title("city")} AS city,
       {title("country")} AS country, postal_code, {date_of("signup_date")} AS signup_date,
       {flag("is_active")} AS is_active, lower(trim(coalesce(loyalty_tier, 'none'))) AS loyalty_tier
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY src_ord) AS rn FROM r_customers) t
WHERE rn = 1""",
    "c_products": f"""
SELECT product_id, sku, {title("regexp_replace(product_name, '<[^>]*>', '', 'g')")} AS product_name,
       lower(trim(coalesce(category, 'uncategorized'))) AS category, try_cast(unit_price AS DECIMAL(18,2)) AS unit_price,
       coalesce(try_cast(stock_quantity AS INTEGER), 0) AS stock_quantity, try_cast(weight_kg AS DOUBLE) AS weight_kg,
       {date_of("created_date")} AS created_date
FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY src_ord) AS rs
      FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY src_ord) AS rn FROM r_products) t
      WHERE rn = 1) u
WHERE rs = 1 AND try_cast(unit_price AS DECIMAL(18,2)) > 0""",
    # Cleaned product ids in the type of the clean views.
    "c_ids": """
SELECT CAST(product_id AS BIGINT) AS product_id FROM c_products""",
    "c_reviews": f"""
SELECT review_id, product_id, customer_id, {rating("rating")} AS rating, review_text,
       coalesce(trim(review_text) <> '', false) AS has_review_text, {date_of("review_date")} AS review_date,
       {verified("verified_purchase")} AS verified_purchase,
       coalesce(CAST(trunc(try_cast(helpful_votes AS DOUBLE)) AS INTEGER), 0) AS helpful_votes
FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY src_ord) AS rn FROM r_reviews) t
WHERE rn = 1""",
    "k_orders": """
SELECT * FROM c_orders WHERE customer_id IN (SELECT customer_id FROM c_customers)
  AND product_id IN (SELECT product_id FROM c_products)""",
    "k_reviews": """
SELECT * FROM c_reviews WHERE product_id IN (SELECT product_id FROM c_products)""",
}


def _used(sql: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]


def with_views(sql: str) -> str:
    """Prefix a statement with the views it needs, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _used(text):
            if name not in ordered:
                visit(VIEWS[name])
                ordered.append(name)

    visit(sql)
    body = sql.strip()
    if not ordered:
        return body
    prefix = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in ordered)
    if re.match(r"(?i)with\b", body):
        return f"WITH {prefix},\n{body[4:].lstrip()}"
    return f"WITH {prefix}\n{body}"
