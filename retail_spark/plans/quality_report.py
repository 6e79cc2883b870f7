"""What was wrong with the raw tables, how often, and what was done about it.

Every number is counted on the data.  Row-level issues of a table are counted in
one pass over its raw rows; copies and orphans take one aggregation each.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_spark.functions import cleaning as clean
from retail_spark.operators.dedup import surplus_count
from retail_spark.operators.referential import keep_members, orphan_count
from retail_spark.plans.cleaning import clean_customers, clean_orders, clean_products, clean_reviews, flat_customers
from retail_spark.sources.readers import SOURCE_ORDER


def _rewritten(c: Column, cleaned: Column) -> Column:
    return c.isNotNull() & ~c.eqNullSafe(cleaned)


def _not_iso(name: str) -> Column:
    return ~F.col(name).rlike(r"^\d{4}-\d{2}-\d{2}$")


def order_issues() -> dict[str, tuple[Column, str]]:
    c = F.col
    return {
        "order_date not ISO": (_not_iso("order_date"), "rewritten as ISO date"),
        "unit_price with currency text": (c("unit_price").rlike(r"[^0-9.]"), "text dropped, kept as money"),
        "status spelling": (_rewritten(c("status"), clean.clean_status(c("status"))), "mapped to known status"),
        "payment_method spelling": (
            _rewritten(c("payment_method"), clean.clean_payment_method(c("payment_method"))),
            "mapped to known method",
        ),
        "customer_id missing": (c("customer_id").isNull(), "row dropped"),
        "product_id missing": (c("product_id").isNull(), "row dropped"),
        "shipping_address_city missing": (c("shipping_address_city").isNull(), "kept as NULL"),
        "discount_pct missing": (c("discount_pct").isNull(), "filled with 0"),
        "quantity not positive": (clean.to_double(c("quantity")) <= 0, "row dropped"),
    }


def customer_issues() -> dict[str, tuple[Column, str]]:
    c = F.col
    cased = _rewritten(c("first_name"), clean.title_case(c("first_name"))) | _rewritten(
        c("last_name"), clean.title_case(c("last_name"))
    )
    return {
        "signup_date not ISO": (_not_iso("signup_date"), "rewritten as ISO date"),
        "is_active spelling": (~c("is_active").isin("true", "false"), "mapped to a flag"),
        "email missing": (c("email").isNull(), "kept, has_email is false"),
        "loyalty_tier missing": (c("loyalty_tier").isNull(), "filled with none"),
        "postal_code missing": (c("postal_code").isNull(), "kept as NULL"),
        "name casing": (F.coalesce(cased, F.lit(False)), "title case"),
    }


def product_issues() -> dict[str, tuple[Column, str]]:
    c = F.col
    return {
        "product_name with markup": (c("product_name").contains("<"), "markup stripped"),
        "category missing": (c("category").isNull(), "filled with uncategorized"),
        "unit_price not positive": (clean.to_money(c("unit_price")) <= 0, "row dropped"),
        "weight_kg missing": (c("weight_kg").isNull(), "kept as NULL"),
        "stock_quantity negative": (clean.to_whole(c("stock_quantity")) < 0, "clamped to 0 when stored"),
    }


def review_issues() -> dict[str, tuple[Column, str]]:
    c = F.col
    number = clean.rating_number(c("rating"))
    return {
        "rating spelling": (~c("rating").rlike(r"^\d(\.\d+)?$"), "mapped to a number"),
        "rating out of range": (~number.between(1.0, 5.0), "clamped to 1..5"),
        "verified_purchase spelling": (~c("verified_purchase").isin("true", "false"), "mapped to a flag"),
        "review_text missing": (~clean.has_text(c("review_text")), "kept, has_review_text is false"),
        "helpful_votes missing": (c("helpful_votes").isNull(), "filled with 0"),
    }


def _rows(counts: DataFrame, table: str, issues: Mapping[str, str]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(issue).alias("issue"),
            F.col(f"c{i}").cast("bigint").alias("rows_affected"),
            F.lit(action).alias("action"),
        )
        for i, (issue, action) in enumerate(issues.items())
    ]
    return counts.select(F.inline(F.array(*rows)))


def _counted(df: DataFrame, table: str, issues: Mapping[str, tuple[Column, str]]) -> DataFrame:
    counters = [F.count_if(hit).alias(f"c{i}") for i, (hit, _) in enumerate(issues.values())]
    return _rows(df.agg(*counters), table, {issue: action for issue, (_, action) in issues.items()})


def _single(count: DataFrame, table: str, issue: str, action: str) -> DataFrame:
    return _rows(count.toDF("c0"), table, {issue: action})


def _surplus(df: DataFrame, table: str, issue: str, keys) -> DataFrame:
    return _single(surplus_count(df, keys), table, issue, "later copies dropped")


def quality_report(
    raw: Mapping[str, DataFrame], stage: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The 36 issues as rows ``(table_name, issue, rows_affected, action)``.

    ``stage`` may hold the raw tables and the keys of the cleaned ones, which several counts read.
    """
    hold = stage or (lambda df: df)
    raw = {table: hold(df) for table, df in raw.items()}
    customers, products = flat_customers(raw["customers"]), raw["products"]
    orders, reviews = raw["orders"], raw["reviews"]

    def content(df: DataFrame) -> list[str]:
        return [c for c in df.columns if c != SOURCE_ORDER]

    good_customers = hold(clean_customers(raw["customers"]).select("customer_id"))
    good_products = hold(clean_products(products).select("product_id"))
    good_orders = hold(clean_orders(orders).select("customer_id", "product_id"))
    known_buyers = keep_members(good_orders, good_customers, "customer_id")
    frames = [
        _surplus(orders, "orders", "exact copies", content(orders)),
        _surplus(orders, "orders", "order_id repeated", ["order_id"]),
        _counted(orders, "orders", order_issues()),
        _single(orphan_count(good_orders, good_customers, "customer_id"), "orders", "customer_id unknown", "row dropped"),
        _single(orphan_count(known_buyers, good_products, "product_id"), "orders", "product_id unknown", "row dropped"),
        _surplus(customers, "customers", "exact copies", content(customers)),
        _surplus(customers, "customers", "customer_id repeated", ["customer_id"]),
        _counted(customers, "customers", customer_issues()),
        _surplus(products, "products", "exact copies", content(products)),
        _surplus(products, "products", "product_id repeated", ["product_id"]),
        _surplus(products, "products", "sku repeated", ["sku"]),
        _counted(products, "products", product_issues()),
        _surplus(reviews, "reviews", "review_id repeated", ["review_id"]),
        _counted(reviews, "reviews", review_issues()),
        _single(
            orphan_count(clean_reviews(reviews), good_products, "product_id"),
            "reviews",
            "product_id unknown",
            "row dropped",
        ),
    ]
    return reduce(DataFrame.unionByName, frames)


def report_summary(report: DataFrame) -> DataFrame:
    """Issues and affected rows per table, and over all."""
    return (
        report.rollup("table_name")
        .agg(F.count("*").alias("issues"), F.sum("rows_affected").alias("rows_affected"))
        .withColumn("table_name", F.coalesce("table_name", F.lit("total")))
    )
