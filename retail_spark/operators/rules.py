"""Quality rules: one declarative table, one way to evaluate it.

A row rule is a violation predicate; all row rules of a table are counted in a
single pass.  Key rules and foreign-key rules each need one aggregation.  No rule
raises: the outcome is rows ``(table_name, rule, violations, passed)``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_spark.schemas import (
    FOREIGN_KEYS,
    LOYALTY_TIERS,
    ORDER_STATUSES,
    PRIMARY_KEYS,
    TABLES,
)


def _in(column: str, values: Iterable[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


@dataclass(frozen=True)
class Constraint:
    """One declared constraint of a stored table."""

    table: str
    kind: str  # not_null, primary_key, unique, foreign_key, check
    column: str
    check: str | None = None  # a SQL predicate; NULL counts as fulfilled
    references: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.column}"

    def violated(self) -> Column:
        if self.kind == "not_null":
            return F.col(self.column).isNull()
        return F.coalesce(~F.expr(self.check), F.lit(False))


def _not_null(table: str, *columns: str) -> list[Constraint]:
    return [Constraint(table, "not_null", c) for c in columns]


def _check(table: str, column: str, check: str) -> Constraint:
    return Constraint(table, "check", column, check)


CONSTRAINTS: tuple[Constraint, ...] = (
    Constraint("customers", "primary_key", "customer_id"),
    *_not_null("customers", "first_name", "last_name", "has_email", "is_active", "loyalty_tier"),
    _check("customers", "has_email", "has_email IN (0, 1)"),
    _check("customers", "is_active", "is_active IN (0, 1)"),
    _check("customers", "loyalty_tier", _in("loyalty_tier", LOYALTY_TIERS)),
    Constraint("products", "primary_key", "product_id"),
    Constraint("products", "unique", "sku"),
    *_not_null("products", "sku", "product_name", "category", "unit_price", "stock_quantity"),
    _check("products", "unit_price", "unit_price > 0"),
    _check("products", "stock_quantity", "stock_quantity >= 0"),
    Constraint("orders", "primary_key", "order_id"),
    *_not_null("orders", "customer_id", "product_id", "quantity", "unit_price", "status", "discount_pct"),
    Constraint("orders", "foreign_key", "customer_id", references="customers"),
    Constraint("orders", "foreign_key", "product_id", references="products"),
    _check("orders", "quantity", "quantity > 0"),
    _check("orders", "unit_price", "unit_price > 0"),
    _check("orders", "status", _in("status", ORDER_STATUSES)),
    _check("orders", "discount_pct", "discount_pct >= 0"),
    Constraint("reviews", "primary_key", "review_id"),
    *_not_null("reviews", "product_id", "customer_id", "has_review_text", "helpful_votes"),
    Constraint("reviews", "foreign_key", "product_id", references="products"),
    _check("reviews", "rating", "rating IS NULL OR (rating >= 1.0 AND rating <= 5.0)"),
    _check("reviews", "has_review_text", "has_review_text IN (0, 1)"),
    _check("reviews", "verified_purchase", "verified_purchase IS NULL OR verified_purchase IN (0, 1)"),
    _check("reviews", "helpful_votes", "helpful_votes >= 0"),
)


def constraints_of(table: str, *kinds: str) -> list[Constraint]:
    return [c for c in CONSTRAINTS if c.table == table and (not kinds or c.kind in kinds)]


def acceptable(table: str) -> Column:
    """Rows that break no NOT NULL or CHECK; the primary key must be set too."""
    broken = [c.violated() for c in constraints_of(table, "not_null", "check")]
    broken.append(F.col(PRIMARY_KEYS[table]).isNull())
    return ~reduce(lambda a, b: a | b, broken)


def _as_rows(counts: DataFrame, table: str, names: list[str]) -> DataFrame:
    """One row of counters ``c0, c1, ...`` to one row per rule."""
    rows = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(name).alias("rule"),
            F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("bigint").alias("violations"),
        )
        for i, name in enumerate(names)
    ]
    return counts.select(F.inline(F.array(*rows))).withColumn("passed", F.col("violations") == 0)


def row_rules(df: DataFrame, table: str, rules: Mapping[str, Column]) -> DataFrame:
    """All row rules of a table in one aggregation; a rule is a violation predicate."""
    counters = [F.count_if(v).alias(f"c{i}") for i, v in enumerate(rules.values())]
    return _as_rows(df.agg(*counters), table, list(rules))


def unique_rule(df: DataFrame, table: str, rule: str, column: str) -> DataFrame:
    """Rows beyond one per non-NULL key."""
    per_key = df.groupBy(column).agg(F.count("*").alias("n"))
    surplus = F.sum("n") - F.count_if(F.col(column).isNotNull())
    return _as_rows(per_key.agg(surplus.alias("c0")), table, [rule])


def foreign_key_rule(fact: DataFrame, dim: DataFrame, table: str, rule: str, fk: str, key: str) -> DataFrame:
    """Rows whose key is unknown; NULL is no member either.

    Rows are counted per key before the join, so a hot key is one row there, and
    the anti join keeps the NULL group.
    """
    counted = fact.groupBy(fk).agg(F.count("*").alias("n"))
    members = dim.select(F.col(key).alias(fk))
    return _as_rows(counted.join(members, fk, "left_anti").agg(F.sum("n").alias("c0")), table, [rule])


def union_rules(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _bad_date(column: str) -> Column:
    """Set, but not ISO text once written out."""
    return ~F.col(column).cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$")


def _outside(column: str, values: Iterable[str]) -> Column:
    return ~F.coalesce(F.col(column).isin(*values), F.lit(False))


def _not_positive(column: str) -> Column:
    return ~F.coalesce(F.col(column) > 0, F.lit(False))


def validate_customers(customers: DataFrame) -> DataFrame:
    rules = {
        "customer_id not null": F.col("customer_id").isNull(),
        "signup_date format": _bad_date("signup_date"),
        "is_active boolean": _outside_boolean(customers, "is_active"),
        "loyalty_tier not null": F.col("loyalty_tier").isNull(),
        "loyalty_tier known": _outside("loyalty_tier", LOYALTY_TIERS),
    }
    return union_rules(
        [
            row_rules(customers, "customers", rules),
            unique_rule(customers, "customers", "customer_id unique", "customer_id"),
        ]
    )


def _outside_boolean(df: DataFrame, column: str) -> Column:
    if dict(df.dtypes)[column] == "boolean":
        return F.lit(False)
    return ~F.col(column).cast("string").isin("true", "false", "0", "1")


def validate_products(products: DataFrame) -> DataFrame:
    rules = {
        "product_id not null": F.col("product_id").isNull(),
        "unit_price positive": _not_positive("unit_price"),
        "category not null": F.col("category").isNull(),
        "product_name without markup": F.col("product_name").contains("<"),
        "created_date format": _bad_date("created_date"),
    }
    return union_rules(
        [
            row_rules(products, "products", rules),
            unique_rule(products, "products", "product_id unique", "product_id"),
            unique_rule(products, "products", "sku unique", "sku"),
        ]
    )


def validate_orders(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    rules = {
        "order_id not null": F.col("order_id").isNull(),
        "customer_id not null": F.col("customer_id").isNull(),
        "product_id not null": F.col("product_id").isNull(),
        "quantity positive": _not_positive("quantity"),
        "unit_price positive": _not_positive("unit_price"),
        "order_date format": _bad_date("order_date"),
        "status known": _outside("status", ORDER_STATUSES),
    }
    return union_rules(
        [
            row_rules(orders, "orders", rules),
            unique_rule(orders, "orders", "order_id unique", "order_id"),
            foreign_key_rule(orders, customers, "orders", "customer_id exists", "customer_id", "customer_id"),
            foreign_key_rule(orders, products, "orders", "product_id exists", "product_id", "product_id"),
        ]
    )


def validate_reviews(reviews: DataFrame, products: DataFrame) -> DataFrame:
    rules = {
        "review_id not null": F.col("review_id").isNull(),
        "rating in range": ~F.col("rating").between(1.0, 5.0),
        "review_date format": _bad_date("review_date"),
    }
    return union_rules(
        [
            row_rules(reviews, "reviews", rules),
            unique_rule(reviews, "reviews", "review_id unique", "review_id"),
            foreign_key_rule(reviews, products, "reviews", "product_id exists", "product_id", "product_id"),
        ]
    )


def validate_all(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The 28 rules over a clean bundle."""
    customers, products = tables["customers"], tables["products"]
    return union_rules(
        [
            validate_customers(customers),
            validate_products(products),
            validate_orders(tables["orders"], customers, products),
            validate_reviews(tables["reviews"], products),
        ]
    )


def summarize(results: DataFrame) -> DataFrame:
    """Passed, failed and total rules per table."""
    return results.groupBy("table_name").agg(
        F.count_if("passed").alias("rules_passed"),
        F.count_if(~F.col("passed")).alias("rules_failed"),
        F.count("*").alias("rules_total"),
    )


def verify_row_counts(stored: Mapping[str, DataFrame], expected: Mapping[str, DataFrame]) -> DataFrame:
    """Stored rows equal the rows that were to be loaded."""

    def counts(bundle, label):
        return union_rules(
            df.agg(F.lit(table).alias("table_name"), F.count("*").alias(label))
            for table, df in bundle.items()
        )

    both = counts(expected, "expected_rows").join(counts(stored, "stored_rows"), "table_name", "left")
    difference = F.abs(F.col("expected_rows") - F.coalesce(F.col("stored_rows"), F.lit(0)))
    return both.select(
        "table_name",
        F.lit("row count").alias("rule"),
        difference.alias("violations"),
        (difference == 0).alias("passed"),
    )


def verify_foreign_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_rules(
        foreign_key_rule(tables[fact], tables[dim], fact, f"{fk} exists", fk, PRIMARY_KEYS[dim])
        for (fact, fk), dim in FOREIGN_KEYS.items()
    )


def verify_constraints(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Business rules on stored rows; NULL breaks none of them."""
    broken = {
        "products": {"unit_price > 0": F.col("unit_price") <= 0},
        "orders": {
            "unit_price > 0": F.col("unit_price") <= 0,
            "quantity > 0": F.col("quantity") <= 0,
            "discount_pct >= 0": F.col("discount_pct") < 0,
        },
        "reviews": {
            "rating 1..5": (F.col("rating") < 1) | (F.col("rating") > 5),
            "helpful_votes >= 0": F.col("helpful_votes") < 0,
        },
        "customers": {"loyalty_tier known": ~F.col("loyalty_tier").isin(*LOYALTY_TIERS)},
    }
    return union_rules(row_rules(tables[t], t, rules) for t, rules in broken.items())


def verify_primary_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_rules(
        unique_rule(tables[t], t, f"{PRIMARY_KEYS[t]} unique", PRIMARY_KEYS[t]) for t in TABLES
    )


def verify_all(stored: Mapping[str, DataFrame], expected: Mapping[str, DataFrame]) -> DataFrame:
    """All four checks as rows; the load is sound if every row passed."""
    checks = {
        "row_counts": verify_row_counts(stored, expected),
        "foreign_keys": verify_foreign_keys(stored),
        "constraints": verify_constraints(stored),
        "primary_keys": verify_primary_keys(stored),
    }
    return union_rules(df.withColumn("check_name", F.lit(name)) for name, df in checks.items())


def verdict(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("checks"), F.every("passed").alias("all_passed"))


def check_constraints(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every declared constraint as a rule row."""
    frames = []
    for table in TABLES:
        simple = {c.name: c.violated() for c in constraints_of(table, "not_null", "check")}
        frames.append(row_rules(tables[table], table, simple))
        for c in constraints_of(table, "primary_key", "unique"):
            frames.append(unique_rule(tables[table], table, c.name, c.column))
        for c in constraints_of(table, "foreign_key"):
            key = PRIMARY_KEYS[c.references]
            frames.append(foreign_key_rule(tables[table], tables[c.references], table, c.name, c.column, key))
    return union_rules(frames)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table, for a health report."""
    return union_rules(
        df.agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("row_count"),
            F.lit("ok").alias("status"),
        )
        for name, df in tables.items()
    )
