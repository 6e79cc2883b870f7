"""Rules, integrity checks and health counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from retail_spark.catalog.registry import entry
from retail_spark.operators import rules
from retail_spark.plans.cleaning import clean_all, clean_products
from retail_spark.schemas import LOYALTY_TIERS, ORDER_STATUSES, PRIMARY_KEYS, TABLES
from retail_spark.sources.scratch import scratch_path, stage
from retail_spark.sources.store import load_star_schema

_TIERS = ", ".join(f"'{t}'" for t in LOYALTY_TIERS)
_STATUSES = ", ".join(f"'{s}'" for s in ORDER_STATUSES)


def _rule(table: str, source: str, rule: str, violated: str) -> str:
    """Rows of ``source`` that break a rule."""
    return f"""SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) FILTER (WHERE {violated}) AS violations,
    count(*) FILTER (WHERE {violated}) = 0 AS passed FROM {source}"""


def _unique(table: str, source: str, rule: str, column: str) -> str:
    surplus = f"CAST(count(*) - count(DISTINCT {column}) AS BIGINT)"
    return f"SELECT '{table}' AS table_name, '{rule}' AS rule, {surplus} AS violations, {surplus} = 0 AS passed FROM {source}"


def _all(*parts: str) -> str:
    return "\nUNION ALL ".join(parts)


def _bad_date(column: str) -> str:
    return rf"NOT regexp_matches(CAST({column} AS VARCHAR), '^\d{{4}}-\d{{2}}-\d{{2}}$')"


def _unknown(column: str, dim: str) -> str:
    return f"{column} IS NULL OR {column} NOT IN (SELECT {column} FROM {dim})"


def _customers(s: str) -> str:
    return _all(
        _rule("customers", s, "customer_id not null", "customer_id IS NULL"),
        _rule("customers", s, "signup_date format", _bad_date("signup_date")),
        _rule("customers", s, "is_active boolean", "is_active NOT IN (true, false)"),
        _rule("customers", s, "loyalty_tier not null", "loyalty_tier IS NULL"),
        _rule("customers", s, "loyalty_tier known", f"loyalty_tier IS NULL OR loyalty_tier NOT IN ({_TIERS})"),
        _unique("customers", s, "customer_id unique", "customer_id"),
    )


def _products(s: str) -> str:
    return _all(
        _rule("products", s, "product_id not null", "product_id IS NULL"),
        _rule("products", s, "unit_price positive", "unit_price IS NULL OR unit_price <= 0"),
        _rule("products", s, "category not null", "category IS NULL"),
        _rule("products", s, "product_name without markup", "contains(product_name, '<')"),
        _rule("products", s, "created_date format", _bad_date("created_date")),
        _unique("products", s, "product_id unique", "product_id"),
        _unique("products", s, "sku unique", "sku"),
    )


def _orders(s: str, customers: str, products: str) -> str:
    return _all(
        _rule("orders", s, "order_id not null", "order_id IS NULL"),
        _rule("orders", s, "customer_id not null", "customer_id IS NULL"),
        _rule("orders", s, "product_id not null", "product_id IS NULL"),
        _rule("orders", s, "quantity positive", "quantity IS NULL OR quantity <= 0"),
        _rule("orders", s, "unit_price positive", "unit_price IS NULL OR unit_price <= 0"),
        _rule("orders", s, "order_date format", _bad_date("order_date")),
        _rule("orders", s, "status known", f"status IS NULL OR status NOT IN ({_STATUSES})"),
        _unique("orders", s, "order_id unique", "order_id"),
        _rule("orders", s, "customer_id exists", _unknown("customer_id", customers)),
        _rule("orders", s, "product_id exists", _unknown("product_id", products)),
    )


def _reviews(s: str, products: str) -> str:
    return _all(
        _rule("reviews", s, "review_id not null", "review_id IS NULL"),
        _rule("reviews", s, "rating in range", "rating IS NOT NULL AND rating NOT BETWEEN 1 AND 5"),
        _rule("reviews", s, "review_date format", _bad_date("review_date")),
        _unique("reviews", s, "review_id unique", "review_id"),
        _rule("reviews", s, "product_id exists", _unknown("product_id", products)),
    )


_CLEAN = _all(
    _customers("c_customers"),
    _products("c_products"),
    _orders("k_orders", "c_customers", "c_products"),
    _reviews("k_reviews", "c_products"),
)


@entry(
    "validate_summary",
    f"""SELECT table_name, count(*) FILTER (WHERE passed) AS rules_passed, count(*) FILTER (WHERE NOT passed) AS rules_failed,
    count(*) AS rules_total FROM ({_CLEAN}) t GROUP BY table_name""",
)
def validate_summary(v):
    cleaned = {table: stage(df) for table, df in clean_all(v.raw, stage).items()}
    return rules.summarize(rules.validate_all(cleaned))


@entry("validate_customers", _customers("v_customers"))
def validate_customers(v):
    return rules.validate_customers(v.customers)


@entry("validate_products", _products("v_products"))
def validate_products(v):
    return rules.validate_products(v.products)


@entry("validate_orders", _orders("v_orders", "v_customers", "c_ids"))
def validate_orders(v):
    """Order lines against the products that survive cleaning, so both kinds of outcome occur."""
    return rules.validate_orders(v.orders, v.customers, _sellable(v))


def _sellable(v):
    kept = clean_products(v.products_raw).select(F.col("product_id").cast("bigint").alias("product_id"))
    return stage(kept)


@entry("validate_reviews", _reviews("v_reviews", "c_ids"))
def validate_reviews(v):
    return rules.validate_reviews(v.reviews, _sellable(v))


CLEAN_SOURCES = {"customers": "c_customers", "products": "c_products", "orders": "k_orders", "reviews": "k_reviews"}
# What a clean row must fulfil to be stored.
STORABLE = {
    "customers": f"customer_id IS NOT NULL AND first_name IS NOT NULL AND last_name IS NOT NULL AND loyalty_tier IN ({_TIERS})",
    "products": "product_id IS NOT NULL AND sku IS NOT NULL AND product_name IS NOT NULL AND unit_price > 0",
    "orders": f"order_id IS NOT NULL AND quantity > 0 AND unit_price > 0 AND status IN ({_STATUSES}) AND discount_pct >= 0",
    "reviews": "review_id IS NOT NULL AND customer_id IS NOT NULL AND helpful_votes >= 0",
}


def _row_count(table: str) -> str:
    lost = f"count(*) - count(*) FILTER (WHERE {STORABLE[table]})"
    return f"""SELECT '{table}' AS table_name, 'row count' AS rule, {lost} AS violations, {lost} = 0 AS passed
    FROM {CLEAN_SOURCES[table]}"""


_STORED_ROWS = _all(*[_row_count(t) for t in TABLES])


def _loaded(v):
    cleaned = clean_all(v.raw, stage)
    cleaned = {table: stage(df) if table in ("orders", "reviews") else df for table, df in cleaned.items()}
    return load_star_schema(v.spark, scratch_path(v.spark, "store"), cleaned), cleaned


@entry("verify_row_counts", _STORED_ROWS)
def verify_row_counts(v):
    stored, cleaned = _loaded(v)
    return rules.verify_row_counts(stored, cleaned)


def _foreign_keys(orders: str, reviews: str, customers: str, products: str) -> str:
    return _all(
        _rule("orders", orders, "customer_id exists", _unknown("customer_id", customers)),
        _rule("orders", orders, "product_id exists", _unknown("product_id", products)),
        _rule("reviews", reviews, "product_id exists", _unknown("product_id", products)),
    )


def _business_rules(source) -> str:
    return _all(
        _rule("products", source["products"], "unit_price > 0", "unit_price <= 0"),
        _rule("orders", source["orders"], "unit_price > 0", "unit_price <= 0"),
        _rule("orders", source["orders"], "quantity > 0", "quantity <= 0"),
        _rule("orders", source["orders"], "discount_pct >= 0", "discount_pct < 0"),
        _rule("reviews", source["reviews"], "rating 1..5", "rating < 1 OR rating > 5"),
        _rule("reviews", source["reviews"], "helpful_votes >= 0", "helpful_votes < 0"),
        _rule("customers", source["customers"], "loyalty_tier known", f"loyalty_tier NOT IN ({_TIERS})"),
    )


def _primary_keys(source) -> str:
    return _all(*[_unique(t, source[t], f"{PRIMARY_KEYS[t]} unique", PRIMARY_KEYS[t]) for t in TABLES])


VIEW_SOURCES = {table: f"v_{table}" for table in TABLES}


@entry("verify_foreign_keys", _foreign_keys("v_orders", "v_reviews", "v_customers", "c_ids"))
def verify_foreign_keys(v):
    return rules.verify_foreign_keys({**v.clean, "products": _sellable(v)})


@entry("verify_constraints", _business_rules(VIEW_SOURCES))
def verify_constraints(v):
    return rules.verify_constraints(v.clean)


@entry("verify_primary_keys", _primary_keys(VIEW_SOURCES))
def verify_primary_keys(v):
    return rules.verify_primary_keys(v.clean)


_EVERY_CHECK = _all(
    _STORED_ROWS,
    _foreign_keys("k_orders", "k_reviews", "c_customers", "c_products"),
    _business_rules(CLEAN_SOURCES),
    _primary_keys(CLEAN_SOURCES),
)


@entry("verify_all", f"SELECT count(*) AS checks, bool_and(passed) AS all_passed FROM ({_EVERY_CHECK}) t")
def verify_all(v):
    stored, cleaned = _loaded(v)
    return rules.verdict(rules.verify_all(stored, cleaned))


def _constraint_sql() -> str:
    parts = []
    for c in rules.CONSTRAINTS:
        source = f"v_{c.table}"
        if c.kind == "not_null":
            parts.append(_rule(c.table, source, c.name, f"{c.column} IS NULL"))
        elif c.kind == "check":
            check = c.check.replace(" IN (0, 1)", " IN (false, true)")
            parts.append(_rule(c.table, source, c.name, f"NOT ({check})"))
        elif c.kind == "foreign_key":
            parts.append(_rule(c.table, source, c.name, _unknown(c.column, f"v_{c.references}")))
        else:
            parts.append(_unique(c.table, source, c.name, c.column))
    return _all(*parts)


@entry("schema_constraints", _constraint_sql())
def schema_constraints(v):
    """The declared constraints on the bound tables; their tiers are not ours, so some are broken."""
    return rules.check_constraints({table: _flags_as_stored(df) for table, df in v.clean.items()})


def _flags_as_stored(df):
    flags = [name for name, kind in df.dtypes if kind == "boolean"]
    return df.withColumns({name: F.col(name).cast("int") for name in flags})


@entry(
    "health_table_counts",
    _all(*[f"SELECT '{t}' AS table_name, count(*) AS row_count, 'ok' AS status FROM v_{t}" for t in TABLES]),
)
def health_table_counts(v):
    return rules.table_counts(v.clean)
