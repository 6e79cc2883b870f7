"""Duplicates, filters, orphans, and the cleaning pipelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.catalog import oracle_views as o
from retail_spark.catalog.registry import entry
from retail_spark.functions import cleaning as clean
from retail_spark.operators import dedup, referential
from retail_spark.plans import cleaning as pipelines
from retail_spark.plans.quality_report import quality_report, report_summary
from retail_spark.schemas import PRIMARY_KEYS, STORE_SCHEMAS
from retail_spark.sources.readers import SOURCE_ORDER
from retail_spark.sources.scratch import stage


@entry(
    "dedup_exact",
    "SELECT min(doc_id) AS doc_id, text, lang, source, n_chars FROM documents GROUP BY text, lang, source, n_chars",
)
def dedup_exact(v):
    return dedup.drop_exact_long_text(
        v.table("documents").select("doc_id", "text", "lang", "source", "n_chars"), "doc_id", "text"
    )


@entry(
    "dedup_key_first",
    f"""SELECT order_id, customer_id, product_id, quantity, unit_price, order_date, status,
    CAST(s1 AS BIGINT) AS line_number
    FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY {o.LINE_ORDER}) AS rn FROM r_orders) t
    WHERE rn = 1""",
)
def dedup_key_first(v):
    first = dedup.first_per_key(v.orders_raw, ["order_id"], SOURCE_ORDER)
    return first.select(
        "order_id",
        "customer_id",
        "product_id",
        "quantity",
        "unit_price",
        "order_date",
        "status",
        F.col(f"{SOURCE_ORDER}.l_linenumber").alias("line_number"),
    )


@entry(
    "dup_counts",
    """SELECT 'document text' AS what, CAST(count(*) - count(DISTINCT text) AS BIGINT) AS surplus FROM documents
    UNION ALL SELECT 'order line', CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) FROM lineitem
    UNION ALL SELECT 'review id', CAST(count(*) - count(DISTINCT review_id) AS BIGINT) FROM r_reviews""",
)
def dup_counts(v):
    counted = {
        "document text": (v.table("documents"), ["text"]),
        "order line": (v.table("lineitem"), ["l_orderkey", "l_linenumber"]),
        "review id": (v.reviews_raw, ["review_id"]),
    }
    return reduce(
        DataFrame.unionByName,
        [
            dedup.surplus_count(df, keys).select(F.lit(what).alias("what"), "surplus")
            for what, (df, keys) in counted.items()
        ],
    )


@entry(
    "dup_key_listing",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def dup_key_listing(v):
    return dedup.repeated_keys(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@entry(
    "filter_null_keys",
    """SELECT order_id, customer_id, product_id, CAST(s1 AS BIGINT) AS s1 FROM r_orders
    WHERE customer_id IS NOT NULL AND product_id IS NOT NULL""",
)
def filter_null_keys(v):
    return v.orders_raw.dropna(subset=["customer_id", "product_id"]).select(
        "order_id", "customer_id", "product_id", F.col(f"{SOURCE_ORDER}.l_linenumber").alias("s1")
    )


@entry(
    "filter_positive_quantity",
    """SELECT order_id, try_cast(quantity AS DOUBLE) AS quantity,
    CASE WHEN try_cast(quantity AS DOUBLE) > 0 THEN 'kept' ELSE 'quarantined' END AS fate FROM r_orders""",
)
def filter_positive_quantity(v):
    numbered = v.orders_raw.select("order_id", clean.to_double(F.col("quantity")).alias("quantity"))
    kept, lost = referential.split_positive(numbered, "quantity")
    return kept.withColumn("fate", F.lit("kept")).unionByName(lost.withColumn("fate", F.lit("quarantined")))


@entry(
    "filter_positive_price",
    """SELECT product_id, CAST(try_cast(unit_price AS DECIMAL(18,2)) AS DOUBLE) AS unit_price,
    CASE WHEN try_cast(unit_price AS DECIMAL(18,2)) > 0 THEN 'kept' ELSE 'quarantined' END AS fate FROM r_products""",
)
def filter_positive_price(v):
    priced = v.products_raw.select("product_id", clean.to_money(F.col("unit_price")).alias("unit_price"))
    kept, lost = referential.split_positive(priced, "unit_price")
    return kept.withColumn("fate", F.lit("kept")).unionByName(lost.withColumn("fate", F.lit("quarantined")))


@entry(
    "filter_orphans",
    """SELECT 'orders' AS fact, order_id AS id, product_id FROM k_orders
    UNION ALL SELECT 'reviews', review_id, product_id FROM k_reviews""",
)
def filter_orphans(v):
    kept = pipelines.clean_all(v.raw)
    return (
        kept["orders"]
        .select(F.lit("orders").alias("fact"), F.col("order_id").alias("id"), "product_id")
        .unionByName(kept["reviews"].select(F.lit("reviews").alias("fact"), F.col("review_id").alias("id"), "product_id"))
    )


@entry(
    "orphan_listing",
    """SELECT 'orders.product_id' AS fk, product_id AS id, count(*) AS n FROM r_orders
      WHERE product_id NOT IN (SELECT product_id FROM c_products) GROUP BY product_id
    UNION ALL SELECT 'orders.customer_id', customer_id, count(*) FROM r_orders
      WHERE customer_id NOT IN (SELECT customer_id FROM c_customers) GROUP BY customer_id
    UNION ALL SELECT 'reviews.product_id', product_id, count(*) FROM r_reviews
      WHERE product_id NOT IN (SELECT product_id FROM c_products) GROUP BY product_id""",
)
def orphan_listing(v):
    products = pipelines.clean_products(v.products_raw)
    customers = pipelines.clean_customers(v.customers_raw)

    def listed(fact, dim, fk, name):
        unknown = referential.orphan_keys(fact, dim, fk)
        return unknown.select(F.lit(name).alias("fk"), F.col(fk).alias("id"), "n")

    return (
        listed(v.orders_raw, products, "product_id", "orders.product_id")
        .unionByName(listed(v.orders_raw, customers, "customer_id", "orders.customer_id"))
        .unionByName(listed(v.reviews_raw, products, "product_id", "reviews.product_id"))
    )


# Columns whose missing values cleaning fills: when a raw value counts as missing.
_FILLED = {
    "orders": {"discount_pct": "try_cast(t.discount_pct AS DOUBLE) IS NULL"},
    "customers": {"loyalty_tier": "t.loyalty_tier IS NULL"},
    "products": {"category": "t.category IS NULL", "stock_quantity": "try_cast(t.stock_quantity AS DOUBLE) IS NULL"},
    "reviews": {"helpful_votes": "try_cast(t.helpful_votes AS DOUBLE) IS NULL"},
}


def _null_impact_sql() -> str:
    """NULLs after parsing and before filling, over the rows that cleaning keeps; rows with markup as a row of their own."""
    parts = []
    for table, schema in STORE_SCHEMAS.items():
        key, order = PRIMARY_KEYS[table], o.LINE_ORDER if table == "orders" else "src_ord"
        names = [n for n in schema.fieldNames() if n not in _FILLED[table]]
        counts = [f"count(*) - count(k.{n}) AS {n}" for n in names]
        counts += [f"count(*) FILTER (WHERE {missing}) AS {n}" for n, missing in _FILLED[table].items()]
        if table == "products":
            counts.append("count(*) FILTER (WHERE contains(t.product_name, '<')) AS product_name_with_markup")
        columns = [c.rsplit(" AS ", 1)[1] for c in counts]
        first = f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM r_{table})"
        parts.append(
            f"SELECT '{table}' AS table_name, column_name, CAST(null_count AS BIGINT) AS null_count FROM (UNPIVOT "
            f"(SELECT {', '.join(counts)} FROM c_{table} k JOIN {first} t ON t.{key} = k.{key} AND t.rn = 1) "
            f"ON {', '.join(columns)} INTO NAME column_name VALUE null_count)"
        )
    return "\nUNION ALL ".join(parts)


@entry("null_impact_counts", _null_impact_sql())
def null_impact_counts(v):
    return pipelines.null_impact(v.raw)


@entry(
    "pipeline_clean_orders",
    """SELECT order_id, customer_id, product_id, CAST(quantity AS BIGINT) AS quantity, CAST(unit_price AS DOUBLE) AS unit_price,
    CAST(total_amount AS DOUBLE) AS total_amount, strftime(order_date, '%Y-%m-%d') AS order_date, status, payment_method,
    shipping_address_city, discount_pct FROM c_orders""",
)
def pipeline_clean_orders(v):
    return pipelines.clean_orders(v.orders_raw)


@entry(
    "pipeline_clean_customers",
    "SELECT * REPLACE (strftime(signup_date, '%Y-%m-%d') AS signup_date) FROM c_customers",
)
def pipeline_clean_customers(v):
    return pipelines.clean_customers(v.customers_raw)


@entry(
    "pipeline_clean_products",
    """SELECT * REPLACE (strftime(created_date, '%Y-%m-%d') AS created_date, CAST(unit_price AS DOUBLE) AS unit_price,
    CAST(stock_quantity AS BIGINT) AS stock_quantity) FROM c_products""",
)
def pipeline_clean_products(v):
    return pipelines.clean_products(v.products_raw)


@entry(
    "pipeline_clean_reviews",
    """SELECT * REPLACE (strftime(review_date, '%Y-%m-%d') AS review_date, CAST(helpful_votes AS BIGINT) AS helpful_votes,
    CAST(rating AS DOUBLE) AS rating) FROM c_reviews""",
)
def pipeline_clean_reviews(v):
    return pipelines.clean_reviews(v.reviews_raw)


@entry(
    "pipeline_clean_all",
    """SELECT 'customers' AS table_name, customer_id AS id, loyalty_tier AS label, NULL AS amount FROM c_customers
    UNION ALL SELECT 'products', product_id, category, CAST(unit_price AS DOUBLE) FROM c_products
    UNION ALL SELECT 'orders', order_id, status, CAST(total_amount AS DOUBLE) FROM k_orders
    UNION ALL SELECT 'reviews', review_id, product_id, CAST(rating AS DOUBLE) FROM k_reviews""",
)
def pipeline_clean_all(v):
    kept = pipelines.clean_all(v.raw, stage)

    def slim(table, key, label, amount):
        return kept[table].select(
            F.lit(table).alias("table_name"),
            F.col(key).alias("id"),
            F.col(label).alias("label"),
            amount.cast("double").alias("amount"),
        )

    return (
        slim("customers", "customer_id", "loyalty_tier", F.lit(None))
        .unionByName(slim("products", "product_id", "category", F.col("unit_price")))
        .unionByName(slim("orders", "order_id", "status", F.col("total_amount")))
        .unionByName(slim("reviews", "review_id", "product_id", F.col("rating")))
    )


@entry(
    "pipeline_row_reconciliation",
    """SELECT r.table_name, raw_rows, clean_rows, raw_rows - clean_rows AS dropped_rows FROM
    (SELECT 'customers' AS table_name, count(*) AS raw_rows FROM r_customers
     UNION ALL SELECT 'products', count(*) FROM r_products
     UNION ALL SELECT 'orders', count(*) FROM r_orders
     UNION ALL SELECT 'reviews', count(*) FROM r_reviews) r
    JOIN (SELECT 'customers' AS table_name, count(*) AS clean_rows FROM c_customers
     UNION ALL SELECT 'products', count(*) FROM c_products
     UNION ALL SELECT 'orders', count(*) FROM k_orders
     UNION ALL SELECT 'reviews', count(*) FROM k_reviews) k ON k.table_name = r.table_name""",
)
def pipeline_row_reconciliation(v):
    return pipelines.reconcile_rows(v.raw, pipelines.clean_all(v.raw, stage))


_CUSTOMER_COLUMNS = """customer_id, email, phone, signup_date, is_active, loyalty_tier, first_name, last_name, city, country,
      postal_code"""
_ORDER_COLUMNS = """order_id, customer_id, product_id, quantity, unit_price, total_amount, order_date, status,
      payment_method, shipping_address_city, discount_pct"""
_PRODUCT_COLUMNS = "product_id, sku, product_name, category, unit_price, stock_quantity, weight_kg, created_date"


def _issues_sql() -> str:
    """``(table, issue, count expression over the raw table)`` as one statement."""
    iso_text = r"'^\d{4}-\d{2}-\d{2}$'"

    def hits(condition):
        return f"count(*) FILTER (WHERE {condition})"

    def copies(columns):
        return f"count(*) - count(DISTINCT ({columns}))"

    def titled(x):
        return f"({x} IS NOT NULL AND {x} <> {o.title(x)})"

    raw = {
        "orders": [
            ("exact copies", copies(_ORDER_COLUMNS)),
            ("order_id repeated", copies("order_id")),
            ("order_date not ISO", hits(f"NOT regexp_matches(order_date, {iso_text})")),
            ("unit_price with currency text", hits("regexp_matches(unit_price, '[^0-9.]')")),
            ("status spelling", hits(f"status <> {o.status('status')}")),
            ("payment_method spelling", hits(f"payment_method <> {o.payment('payment_method')}")),
            ("customer_id missing", hits("customer_id IS NULL")),
            ("product_id missing", hits("product_id IS NULL")),
            ("shipping_address_city missing", hits("shipping_address_city IS NULL")),
            ("discount_pct missing", hits("discount_pct IS NULL")),
            ("quantity not positive", hits("try_cast(quantity AS DOUBLE) <= 0")),
        ],
        "customers": [
            ("exact copies", copies(_CUSTOMER_COLUMNS)),
            ("customer_id repeated", copies("customer_id")),
            ("signup_date not ISO", hits(f"NOT regexp_matches(signup_date, {iso_text})")),
            ("is_active spelling", hits("is_active NOT IN ('true', 'false')")),
            ("email missing", hits("email IS NULL")),
            ("loyalty_tier missing", hits("loyalty_tier IS NULL")),
            ("postal_code missing", hits("postal_code IS NULL")),
            ("name casing", hits(f"{titled('first_name')} OR {titled('last_name')}")),
        ],
        "products": [
            ("exact copies", copies(_PRODUCT_COLUMNS)),
            ("product_id repeated", copies("product_id")),
            ("sku repeated", copies("sku")),
            ("product_name with markup", hits("contains(product_name, '<')")),
            ("category missing", hits("category IS NULL")),
            ("unit_price not positive", hits("try_cast(unit_price AS DECIMAL(18,2)) <= 0")),
            ("weight_kg missing", hits("weight_kg IS NULL")),
            ("stock_quantity negative", hits("try_cast(stock_quantity AS INTEGER) < 0")),
        ],
        "reviews": [
            ("review_id repeated", copies("review_id")),
            ("rating spelling", hits(r"NOT regexp_matches(rating, '^\d(\.\d+)?$')")),
            ("rating out of range", hits(f"({o.rating_value('rating')}) NOT BETWEEN 1 AND 5")),
            ("verified_purchase spelling", hits("verified_purchase NOT IN ('true', 'false')")),
            ("review_text missing", hits("review_text IS NULL OR trim(review_text) = ''")),
            ("helpful_votes missing", hits("helpful_votes IS NULL")),
        ],
    }
    parts = [
        f"SELECT '{table}' AS table_name, '{issue}' AS issue, CAST({count} AS BIGINT) AS rows_affected FROM r_{table}"
        for table, issues in raw.items()
        for issue, count in issues
    ]
    buyers = "customer_id IN (SELECT customer_id FROM c_customers)"
    no_product = "product_id NOT IN (SELECT product_id FROM c_products)"
    parts += [
        f"SELECT 'orders', 'customer_id unknown', count(*) FROM c_orders WHERE NOT ({buyers})",
        f"SELECT 'orders', 'product_id unknown', count(*) FROM c_orders WHERE {buyers} AND {no_product}",
        f"SELECT 'reviews', 'product_id unknown', count(*) FROM c_reviews WHERE {no_product}",
    ]
    return "\nUNION ALL ".join(parts)


@entry("dq_report", _issues_sql())
def dq_report(v):
    return quality_report(v.raw, stage).drop("action")


# What was done about an issue, by how its name ends or by the whole of it.
_ACTIONS = {
    "exact copies": "later copies dropped",
    "% repeated": "later copies dropped",
    "% unknown": "row dropped",
    "% not ISO": "rewritten as ISO date",
    "unit_price with currency text": "text dropped, kept as money",
    "status spelling": "mapped to known status",
    "payment_method spelling": "mapped to known method",
    "is_active spelling": "mapped to a flag",
    "verified_purchase spelling": "mapped to a flag",
    "rating spelling": "mapped to a number",
    "customer_id missing": "row dropped",
    "product_id missing": "row dropped",
    "email missing": "kept, has_email is false",
    "review_text missing": "kept, has_review_text is false",
    "discount_pct missing": "filled with 0",
    "helpful_votes missing": "filled with 0",
    "loyalty_tier missing": "filled with none",
    "category missing": "filled with uncategorized",
    "% missing": "kept as NULL",
    "% not positive": "row dropped",
    "name casing": "title case",
    "product_name with markup": "markup stripped",
    "stock_quantity negative": "clamped to 0 when stored",
    "rating out of range": "clamped to 1..5",
}
_ACTION_SQL = "CASE " + " ".join(f"WHEN issue LIKE '{name}' THEN '{action}'" for name, action in _ACTIONS.items()) + " END"


@entry(
    "a5_dq_report",
    f"""WITH issues AS ({_issues_sql()})
    SELECT table_name, issue, rows_affected, {_ACTION_SQL} AS action, CAST(NULL AS BIGINT) AS issues FROM issues
    UNION ALL SELECT coalesce(table_name, 'total'), NULL, CAST(sum(rows_affected) AS BIGINT), NULL, count(*) FROM issues GROUP BY ROLLUP (table_name)""",
)
def a5_dq_report(v):
    """Every issue with its rows and what was done, then the summary: issues and rows of each table and of all."""
    report = stage(quality_report(v.raw, stage), "issues")
    return report.unionByName(report_summary(report), allowMissingColumns=True)


@entry(
    "dq_report_summary",
    f"""SELECT coalesce(table_name, 'total') AS table_name, count(*) AS issues,
    CAST(sum(rows_affected) AS BIGINT) AS rows_affected FROM ({_issues_sql()}) t GROUP BY ROLLUP (table_name)""",
)
def dq_report_summary(v):
    return report_summary(quality_report(v.raw, stage))
