"""Declared shapes of the four tables, raw and clean, and their allowed values."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

MONEY = DecimalType(18, 2)

# Text that a CSV reader takes as missing.  The match is exact, so
# the loyalty tier "none" is a value.
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# The domains that the store accepts.
LOYALTY_TIERS = ("platinum", "gold", "silver", "bronze", "none")
ORDER_STATUSES = (
    "completed",
    "shipped",
    "processing",
    "pending",
    "returned",
    "cancelled",
    "delivered",
)

TABLES = ("customers", "products", "orders", "reviews")
PRIMARY_KEYS = {
    "customers": "customer_id",
    "products": "product_id",
    "orders": "order_id",
    "reviews": "review_id",
}
# Second unique columns, next to the primary key.
UNIQUE_COLUMNS = {"products": ("sku",)}
# (fact, column) -> dimension whose primary key the column points at.
FOREIGN_KEYS = {
    ("orders", "customer_id"): "customers",
    ("orders", "product_id"): "products",
    ("reviews", "product_id"): "products",
}


def all_text(*names: str) -> StructType:
    return StructType([StructField(name, StringType()) for name in names])


RAW_ORDERS = all_text(
    "order_id",
    "customer_id",
    "product_id",
    "quantity",
    "unit_price",
    "total_amount",
    "order_date",
    "status",
    "payment_method",
    "shipping_address_city",
    "discount_pct",
)
RAW_PRODUCTS = all_text(
    "product_id",
    "sku",
    "product_name",
    "category",
    "unit_price",
    "stock_quantity",
    "weight_kg",
    "created_date",
)
RAW_REVIEWS = all_text(
    "review_id",
    "product_id",
    "customer_id",
    "rating",
    "review_text",
    "review_date",
    "verified_purchase",
    "helpful_votes",
)
RAW_CUSTOMERS = StructType(
    all_text("customer_id", "email", "phone", "signup_date", "is_active", "loyalty_tier").fields
    + [
        StructField("name", all_text("first", "last")),
        StructField("address", all_text("city", "country", "postal_code")),
    ]
)


def _fields(*pairs) -> StructType:
    return StructType([StructField(name, kind) for name, kind in pairs])


# Stored tables.  Flags are 0/1 integers here, dates are real dates.
STORE_SCHEMAS = {
    "customers": _fields(
        ("customer_id", StringType()),
        ("first_name", StringType()),
        ("last_name", StringType()),
        ("email", StringType()),
        ("has_email", IntegerType()),
        ("phone", StringType()),
        ("city", StringType()),
        ("country", StringType()),
        ("postal_code", StringType()),
        ("signup_date", DateType()),
        ("is_active", IntegerType()),
        ("loyalty_tier", StringType()),
    ),
    "products": _fields(
        ("product_id", StringType()),
        ("sku", StringType()),
        ("product_name", StringType()),
        ("category", StringType()),
        ("unit_price", MONEY),
        ("stock_quantity", IntegerType()),
        ("weight_kg", DoubleType()),
        ("created_date", DateType()),
    ),
    "orders": _fields(
        ("order_id", StringType()),
        ("customer_id", StringType()),
        ("product_id", StringType()),
        ("quantity", IntegerType()),
        ("unit_price", MONEY),
        ("total_amount", MONEY),
        ("order_date", DateType()),
        ("status", StringType()),
        ("payment_method", StringType()),
        ("shipping_address_city", StringType()),
        ("discount_pct", DoubleType()),
    ),
    "reviews": _fields(
        ("review_id", StringType()),
        ("product_id", StringType()),
        ("customer_id", StringType()),
        ("rating", DoubleType()),
        ("review_text", StringType()),
        ("has_review_text", IntegerType()),
        ("review_date", DateType()),
        ("verified_purchase", IntegerType()),
        ("helpful_votes", IntegerType()),
    ),
}


def clean_schema(table: str) -> StructType:
    """Schema of a clean table: as stored, but flags are still booleans."""
    from pyspark.sql.types import BooleanType

    flags = {"has_email", "is_active", "has_review_text", "verified_purchase"}
    return StructType(
        [
            StructField(field.name, BooleanType() if field.name in flags else field.dataType)
            for field in STORE_SCHEMAS[table].fields
        ]
    )
