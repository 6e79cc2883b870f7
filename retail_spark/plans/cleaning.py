"""Raw table -> clean table.

Duplicates go first, on the raw text: cleaning then runs once per kept row, and
in the same stage as the filters behind it.  Exact copies always share their key,
so keeping the first row per key drops them as well; a separate pass would cost a
shuffle and change nothing.

Raw frames carry ``src_ord``, the source position that decides which row is first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_spark.functions import cleaning as clean
from retail_spark.operators.dedup import first_per_key
from retail_spark.operators.profiling import null_counts
from retail_spark.operators.referential import keep_members
from retail_spark.schemas import TABLES, clean_schema
from retail_spark.sources.readers import SOURCE_ORDER, flatten

NO_TIER = "none"
NO_CATEGORY = "uncategorized"


def flat_customers(raw: DataFrame) -> DataFrame:
    """Nested customer documents to flat columns with their final names."""
    dotted = flatten(raw, "name", "address")
    names = {"name.first": "first_name", "name.last": "last_name"}
    return dotted.select(
        *[F.col(f"`{c}`").alias(names.get(c, c.removeprefix("address."))) for c in dotted.columns]
    )


def _final(df: DataFrame, table: str) -> DataFrame:
    return df.select(*clean_schema(table).fieldNames())


def _filled(c: Column, default: Column, fill: bool) -> Column:
    """Without ``fill`` a missing value stays NULL, so that it can be counted."""
    return F.coalesce(c, default) if fill else c


def clean_orders(raw: DataFrame, fill: bool = True) -> DataFrame:
    """First row per order, both foreign keys set, quantity above zero."""
    first = first_per_key(raw, ["order_id"], SOURCE_ORDER).dropna(subset=["customer_id", "product_id"])
    kept = first.withColumn("quantity", clean.to_double(F.col("quantity"))).where("quantity > 0")
    return kept.select(
        "order_id",
        "customer_id",
        "product_id",
        F.col("quantity").try_cast("int").alias("quantity"),
        clean.clean_price(F.col("unit_price")).alias("unit_price"),
        clean.to_money(F.col("total_amount")).alias("total_amount"),
        clean.parse_date(F.col("order_date")).alias("order_date"),
        clean.clean_status(F.col("status")).alias("status"),
        clean.clean_payment_method(F.col("payment_method")).alias("payment_method"),
        "shipping_address_city",
        _filled(clean.to_double(F.col("discount_pct")), F.lit(0.0), fill).alias("discount_pct"),
    )


def clean_customers(raw: DataFrame, fill: bool = True) -> DataFrame:
    return first_per_key(flat_customers(raw), ["customer_id"], SOURCE_ORDER).select(
        "customer_id",
        clean.title_case(F.col("first_name")).alias("first_name"),
        clean.title_case(F.col("last_name")).alias("last_name"),
        clean.lower_strip(F.col("email")).alias("email"),
        clean.has_value(F.col("email")).alias("has_email"),
        "phone",
        clean.title_case(F.col("city")).alias("city"),
        clean.title_case(F.col("country")).alias("country"),
        "postal_code",
        clean.parse_date(F.col("signup_date")).alias("signup_date"),
        clean.to_flag(F.col("is_active")).alias("is_active"),
        clean.lower_strip(_filled(F.col("loyalty_tier"), F.lit(NO_TIER), fill)).alias("loyalty_tier"),
    )


def clean_products(raw: DataFrame, fill: bool = True) -> DataFrame:
    """First row per product, then first per SKU, and only then a valid price.

    The order matters: an invalid price still occupies its SKU.
    """
    by_id = first_per_key(raw, ["product_id"], SOURCE_ORDER)
    by_sku = first_per_key(by_id, ["sku"], SOURCE_ORDER)
    return by_sku.select(
        "product_id",
        "sku",
        clean.title_case(clean.strip_html(F.col("product_name"))).alias("product_name"),
        clean.lower_strip(_filled(F.col("category"), F.lit(NO_CATEGORY), fill)).alias("category"),
        clean.to_money(F.col("unit_price")).alias("unit_price"),
        clean.to_whole(F.col("stock_quantity"), default=0 if fill else None).alias("stock_quantity"),
        clean.to_double(F.col("weight_kg")).alias("weight_kg"),
        clean.parse_date(F.col("created_date")).alias("created_date"),
    ).where("unit_price > 0")


def clean_reviews(raw: DataFrame, fill: bool = True) -> DataFrame:
    return first_per_key(raw, ["review_id"], SOURCE_ORDER).select(
        "review_id",
        "product_id",
        "customer_id",
        clean.to_rating(F.col("rating")).alias("rating"),
        "review_text",
        clean.has_text(F.col("review_text")).alias("has_review_text"),
        clean.parse_date(F.col("review_date")).alias("review_date"),
        clean.to_verified(F.col("verified_purchase")).alias("verified_purchase"),
        clean.to_whole(F.col("helpful_votes"), default=0 if fill else None).alias("helpful_votes"),
    )


def drop_orphans(bundle: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Facts lose the rows whose customer or product is not in the bundle."""
    customers, products = bundle["customers"], bundle["products"]
    orders = keep_members(bundle["orders"], customers, "customer_id")
    return {
        "customers": customers,
        "products": products,
        "orders": _final(keep_members(orders, products, "product_id"), "orders"),
        "reviews": _final(keep_members(bundle["reviews"], products, "product_id"), "reviews"),
    }


def clean_all(
    raw: Mapping[str, DataFrame], stage: Callable[[DataFrame], DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Clean every table, then drop orphans across them.

    The dimensions are read by every fact.  With ``stage`` they are written once
    and read back; without, the result stays fully lazy.
    """
    hold = stage or (lambda df: df)
    return drop_orphans(
        {
            "customers": hold(clean_customers(raw["customers"])),
            "products": hold(clean_products(raw["products"])),
            "orders": clean_orders(raw["orders"]),
            "reviews": clean_reviews(raw["reviews"]),
        }
    )


def reconcile_rows(raw: Mapping[str, DataFrame], cleaned: Mapping[str, DataFrame]) -> DataFrame:
    """Raw, clean and dropped rows per table."""

    def counts(bundle: Mapping[str, DataFrame], label: str) -> DataFrame:
        return reduce(
            DataFrame.unionByName,
            [bundle[t].agg(F.lit(t).alias("table_name"), F.count("*").alias(label)) for t in TABLES],
        )

    return (
        counts(raw, "raw_rows")
        .join(counts(cleaned, "clean_rows"), "table_name")
        .withColumn("dropped_rows", F.col("raw_rows") - F.col("clean_rows"))
    )


def null_impact(raw: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, column_name, null_count`` over the rows that cleaning keeps, counted before values are filled.

    What could not be parsed counts as missing.  Product names with markup are a row of their own.
    """
    frames = [
        null_counts(cleaner(raw[table], fill=False), table)
        for table, cleaner in (("customers", clean_customers), ("products", clean_products), ("orders", clean_orders), ("reviews", clean_reviews))
    ]
    kept = clean_products(raw["products"]).select("product_id")
    first = first_per_key(raw["products"], ["product_id"], SOURCE_ORDER).join(kept, "product_id", "left_semi")
    markup = first.agg(
        F.lit("products").alias("table_name"),
        F.lit("product_name_with_markup").alias("column_name"),
        F.count_if(F.contains("product_name", F.lit("<"))).alias("null_count"),
    )
    return reduce(DataFrame.unionByName, [*frames, markup])
