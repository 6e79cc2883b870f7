"""The retail tables as views over a TPC-H-like set of Parquet tables.

Clean views stand for the stored tables, raw views are the same rows with dirt
derived from their keys.  ``ORACLE_VIEWS`` states each view in ANSI SQL, for the
cross-check against another engine.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_spark.sources.readers import SOURCE_ORDER

LINE_ORDER = (
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
)
UNKNOWN_OFFSET = 10_000_000
TIERS = {
    "AUTOMOBILE": "Platinum",
    "BUILDING": " gold ",
    "FURNITURE": "SILVER",
    "HOUSEHOLD": "bronze",
}
PAYMENTS = {
    "1-URGENT": "ApplePay",
    "2-HIGH": "Credit Card",
    "3-MEDIUM": "PAYPAL",
    "4-NOT SPECIFIED": " bank_transfer ",
    "5-LOW": "cash_on_delivery",
}


def _every(key: str, n: int, rest: int = 0) -> Column:
    return F.col(key) % n == rest


def _chosen(key: str, *choices: Column) -> Column:
    """The choice that the key's remainder points at."""
    n = len(choices)
    picked = reduce(
        lambda acc, pair: acc.when(_every(key, n, pair[0]), pair[1]), enumerate(choices[:-1]), F
    )
    return picked.otherwise(choices[-1])


def _money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def _lookup(c: Column, words: dict[str, str]) -> Column:
    return reduce(lambda acc, pair: acc.when(c == pair[0], F.lit(pair[1])), words.items(), F)


class RetailViews:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def products(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("product_id"),
            F.concat(F.lit("SKU-"), key.cast("string")).alias("sku"),
            F.col("p_name").alias("product_name"),
            F.lower("p_type").alias("category"),
            _money(F.col("p_retailprice")).alias("unit_price"),
            (F.col("p_size") % 10).alias("stock_quantity"),
            F.when(~_every("p_partkey", 19), F.col("p_size").cast("double") / 4).alias("weight_kg"),
            F.date_add(F.lit("2020-01-01").cast("date"), (key % 1000).cast("int")).alias("created_date"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        key = F.col("c_custkey")
        parts = F.split("c_name", "#")
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                key.alias("customer_id"),
                F.get(parts, F.lit(0)).alias("first_name"),
                F.get(parts, F.lit(1)).alias("last_name"),
                F.when(~_every("c_custkey", 50), F.concat(F.lit("c"), key.cast("string"), F.lit("@example.com"))).alias(
                    "email"
                ),
                (~_every("c_custkey", 50)).alias("has_email"),
                F.concat(F.lit("+00"), key.cast("string")).alias("phone"),
                F.col("n_name").alias("city"),
                F.col("r_name").alias("country"),
                F.when(~_every("c_custkey", 67), F.concat(F.lit("P"), (key % 900).cast("string"))).alias("postal_code"),
                F.date_add(F.lit("2018-01-01").cast("date"), (key % 1500).cast("int")).alias("signup_date"),
                (F.col("c_acctbal") >= 0).alias("is_active"),
                F.lower("c_mktsegment").alias("loyalty_tier"),
            )
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Order lines with their position among the lines of an order."""
        key = F.col("l_orderkey")
        price = _money(F.col("l_extendedprice"))
        discount = F.col("l_discount").cast("decimal(4,2)")
        status = (
            F.when(F.col("l_returnflag") == "R", "returned")
            .when(F.col("l_returnflag") == "A", "cancelled")
            .when(F.col("l_linestatus") == "F", "completed")
            .otherwise("pending")
        )
        joined = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select(
            key.alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            price.alias("unit_price"),
            F.when(~_every("l_orderkey", 37), _money(price * (1 - discount))).alias("total_amount"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            status.alias("status"),
            F.col("o_orderpriority").alias("payment_method"),
            F.when(
                ~_every("l_orderkey", 23), F.concat(F.lit("City "), (F.col("o_custkey") % 25).cast("string"))
            ).alias("shipping_address_city"),
            (discount * 200).cast("double").alias("discount_pct"),
            F.struct(*LINE_ORDER).alias(SOURCE_ORDER),
        )

    @cached_property
    def orders(self) -> DataFrame:
        return self.lines.drop(SOURCE_ORDER)

    @cached_property
    def reviews(self) -> DataFrame:
        key = F.col("event_id")
        text = F.concat(F.col("event_type"), F.lit(" note"))
        review_text = F.when(_every("event_id", 13), F.lit(None)).when(_every("event_id", 17), F.lit("  ")).otherwise(text)
        return self.table("events").select(
            key.alias("review_id"),
            F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
            F.col("user_id").alias("customer_id"),
            F.when(~_every("event_id", 41), (1 + key % 5).cast("double")).alias("rating"),
            review_text.alias("review_text"),
            F.coalesce(F.btrim(review_text) != "", F.lit(False)).alias("has_review_text"),
            F.col("ts").cast("date").alias("review_date"),
            (F.col("event_type") == "purchase").alias("verified_purchase"),
            F.floor("value").cast("int").alias("helpful_votes"),
        )

    @property
    def clean(self) -> dict[str, DataFrame]:
        return {
            "customers": self.customers,
            "products": self.products,
            "orders": self.orders,
            "reviews": self.reviews,
        }

    @cached_property
    def orders_raw(self) -> DataFrame:
        price = F.col("unit_price").cast("string")
        amount = F.col("total_amount").cast("string")
        d = F.col("order_date")
        status = F.col("status")
        spelled = (
            F.when(status == "completed", F.lit("complete"))
            .when(status == "cancelled", F.lit("Canceled"))
            .otherwise(status)
        )
        return self.lines.select(
            F.col("order_id").cast("string").alias("order_id"),
            F.when(~_every("order_id", 101), F.col("customer_id").cast("string")).alias("customer_id"),
            F.when(_every("order_id", 97), F.col("product_id") + UNKNOWN_OFFSET)
            .otherwise(F.col("product_id"))
            .cast("string")
            .alias("product_id"),
            F.when(_every("order_id", 89), F.lit("0")).otherwise(F.col("quantity").cast("string")).alias("quantity"),
            _chosen(
                "order_id",
                F.concat(F.lit("$"), price),
                F.concat(F.lit("AED "), price),
                F.concat(price, F.lit(" USD")),
            ).alias("unit_price"),
            F.when(_every("order_id", 41), F.concat(F.lit("AED "), amount)).otherwise(amount).alias("total_amount"),
            F.when(_every("order_id", 211), F.lit("not known"))
            .otherwise(
                _chosen(
                    "order_id",
                    F.date_format(d, "yyyy-MM-dd"),
                    F.date_format(d, "dd/MM/yyyy"),
                    F.date_format(d, "MM-dd-yyyy"),
                    F.date_format(d, "d MMM yyyy"),
                    F.date_format(d, "MMMM d, yyyy"),
                )
            )
            .alias("order_date"),
            _chosen(
                "order_id",
                F.upper(status),
                spelled,
                F.concat(F.lit("  "), F.initcap(status), F.lit(" ")),
                status,
            ).alias("status"),
            _lookup(F.col("payment_method"), PAYMENTS).alias("payment_method"),
            "shipping_address_city",
            F.when(~_every("order_id", 3, 1), (F.col("discount_pct").cast("int")).cast("string")).alias("discount_pct"),
            SOURCE_ORDER,
        )

    @cached_property
    def products_raw(self) -> DataFrame:
        key = "product_id"
        upper = F.when(_every(key, 5), F.upper("product_name")).otherwise(F.col("product_name"))
        padded = F.when(_every(key, 3), F.concat(F.lit("  "), upper, F.lit(" "))).otherwise(upper)
        sku = F.when(_every(key, 17) & (F.col(key) > 0), F.col(key) - 1).otherwise(F.col(key))
        price = F.col("unit_price").cast("string")
        stock = F.col("stock_quantity").cast("string")
        return self.products.select(
            F.col(key).cast("string").alias("product_id"),
            F.concat(F.lit("SKU-"), sku.cast("string")).alias("sku"),
            F.when(_every(key, 7), F.concat(F.lit("<b>"), padded, F.lit("</b>"))).otherwise(padded).alias("product_name"),
            F.when(~_every(key, 11), F.initcap("category")).alias("category"),
            F.when(_every(key, 13), F.concat(F.lit("-"), price)).otherwise(price).alias("unit_price"),
            F.when(_every(key, 23), F.lit("-10")).when(_every(key, 29), F.lit(None)).otherwise(stock).alias("stock_quantity"),
            F.col("weight_kg").cast("string").alias("weight_kg"),
            _chosen(
                key, F.date_format("created_date", "yyyy-MM-dd"), F.date_format("created_date", "MM/dd/yyyy")
            ).alias("created_date"),
            F.col(key).alias(SOURCE_ORDER),
        )

    @cached_property
    def customers_raw(self) -> DataFrame:
        key = "customer_id"
        source = self.customers.join(
            self.table("customer").select(F.col("c_custkey").alias(key), "c_mktsegment"), key
        )
        repeated = _every(key, 53) & (F.col(key) > 0)
        return source.select(
            F.when(repeated, F.col(key) - 1).otherwise(F.col(key)).cast("string").alias("customer_id"),
            F.when(_every(key, 7), F.concat(F.lit(" "), F.upper("email"))).otherwise(F.col("email")).alias("email"),
            "phone",
            _chosen(
                key,
                F.date_format("signup_date", "yyyy-MM-dd"),
                F.date_format("signup_date", "MMM d, yyyy"),
                F.date_format("signup_date", "dd-MM-yyyy"),
            ).alias("signup_date"),
            F.when(F.col("is_active"), _chosen(key, F.lit("true"), F.lit("yes")))
            .otherwise(_chosen(key, F.lit("false"), F.lit("no"), F.lit("0")))
            .alias("is_active"),
            _lookup(F.col("c_mktsegment"), TIERS).alias("loyalty_tier"),
            F.struct(
                _chosen(key, F.upper("first_name"), F.lower("first_name"), F.col("first_name")).alias("first"),
                F.concat(F.lit("No-"), F.col("last_name")).alias("last"),
            ).alias("name"),
            F.struct(F.lower("city").alias("city"), F.upper("country").alias("country"), "postal_code").alias("address"),
            F.col(key).alias(SOURCE_ORDER),
        )

    @cached_property
    def reviews_raw(self) -> DataFrame:
        key = "review_id"
        rating = F.col("rating").cast("int").cast("string")
        return self.reviews.select(
            F.when(_every(key, 29) & (F.col(key) > 0), F.col(key) - 1).otherwise(F.col(key)).cast("string").alias("review_id"),
            F.when(_every(key, 19), F.col("product_id") + UNKNOWN_OFFSET)
            .otherwise(F.col("product_id"))
            .cast("string")
            .alias("product_id"),
            F.col("customer_id").cast("string").alias("customer_id"),
            _chosen(
                key,
                rating,
                F.concat(rating, F.lit(".0")),
                F.concat(rating, F.lit("/5")),
                F.lit("four"),
                F.lit("5.3"),
                F.lit("junk"),
            ).alias("rating"),
            "review_text",
            _chosen(
                key,
                F.date_format("review_date", "yyyy-MM-dd"),
                F.date_format("review_date", "dd/MM/yyyy"),
                F.date_format("review_date", "d MMM yyyy"),
            ).alias("review_date"),
            _chosen(key, F.lit("Y"), F.lit("yes"), F.lit("True"), F.lit("0"), F.lit("N"), F.lit("?")).alias(
                "verified_purchase"
            ),
            F.when(~_every(key, 9), F.col("helpful_votes").cast("string")).alias("helpful_votes"),
            F.col(key).alias(SOURCE_ORDER),
        )

    @property
    def raw(self) -> dict[str, DataFrame]:
        return {
            "customers": self.customers_raw,
            "products": self.products_raw,
            "orders": self.orders_raw,
            "reviews": self.reviews_raw,
        }
