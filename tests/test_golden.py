"""Published sample results: cleaned products, product ranks and tiers, totals."""

import csv
import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from retail_spark.functions.expressions import growth_pct, round_half_even
from retail_spark.operators.aggregates import pivot_sum
from retail_spark.operators.dedup import surplus_count
from retail_spark.operators.profiling import profile_columns, profile_table
from retail_spark.operators.rules import validate_products
from retail_spark.plans import analyses
from retail_spark.plans.cleaning import clean_products
from retail_spark.schemas import RAW_PRODUCTS
from retail_spark.sources.readers import SOURCE_ORDER, read_clean_csv, read_csv_text


def rows_of(path):
    with open(path, newline="", encoding="utf-8") as handle:
        return list(csv.DictReader(handle))


@pytest.fixture(scope="module")
def raw_products(spark):
    from conftest import FIXTURES

    return read_csv_text(spark, f"{FIXTURES}/products_raw.csv", RAW_PRODUCTS, ordered=True).cache()


def test_products_raw_to_clean(raw_products, fixture_path):
    got = {r["product_id"]: r for r in clean_products(raw_products).collect()}
    expected = rows_of(fixture_path("products_clean.csv"))
    assert raw_products.count() == 51 and len(got) == len(expected) == 46
    for row in expected:
        mine = got[row["product_id"]]
        assert (mine["sku"], mine["product_name"], mine["category"]) == (row["sku"], row["product_name"], row["category"])
        assert mine["unit_price"] == Decimal(row["unit_price"]).quantize(Decimal("0.01"))
        assert mine["stock_quantity"] == int(row["stock_quantity"])
        assert mine["weight_kg"] == (float(row["weight_kg"]) if row["weight_kg"] else None)
        assert mine["created_date"] == datetime.date.fromisoformat(row["created_date"])


def test_clean_products_fulfil_the_rules(raw_products):
    outcome = validate_products(clean_products(raw_products)).collect()
    assert len(outcome) == 7 and all(r["passed"] for r in outcome)


def test_clean_csv_reload_equals_cleaning(spark, raw_products, fixture_path):
    reloaded = read_clean_csv(spark, fixture_path("products_clean.csv"), "products")
    cleaned = clean_products(raw_products)
    assert reloaded.exceptAll(cleaned).isEmpty() and cleaned.exceptAll(reloaded).isEmpty()


def test_products_profiles(spark, raw_products, fixture_path):
    """Null and distinct counts of the published raw and clean profiles."""
    raw = raw_products.drop(SOURCE_ORDER)
    assert profile_table(raw, "products_raw").first()["duplicate_rows"] == 1
    assert surplus_count(raw, ["sku"]).first()[0] == 3

    def unique(df):
        return {r["column_name"]: (r["null_count"], r["unique_count"]) for r in profile_columns(df, "p").collect()}

    assert unique(raw) == {
        "product_id": (0, 50),
        "sku": (0, 48),
        "product_name": (0, 50),
        "category": (3, 9),
        "unit_price": (0, 50),
        "stock_quantity": (0, 48),
        "weight_kg": (2, 49),
        "created_date": (0, 49),
    }
    assert unique(clean_products(raw_products)) == {
        "product_id": (0, 46),
        "sku": (0, 46),
        "product_name": (0, 46),
        "category": (0, 9),
        "unit_price": (0, 46),
        "stock_quantity": (0, 44),
        "weight_kg": (2, 45),
        "created_date": (0, 45),
    }


@pytest.fixture(scope="module")
def performance(spark):
    from conftest import FIXTURES

    text = read_csv_text(spark, f"{FIXTURES}/product_performance.csv")
    kinds = {"unit_price": "decimal(18,2)", "units_sold": "long", "total_revenue": "decimal(18,2)", "order_count": "long", "avg_rating": "double", "review_count": "long"}
    return text.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in text.columns]).cache()


def test_ranks_and_tiers(performance):
    totals = performance.drop("revenue_rank_in_category", "performance_tier")
    got = {
        r["product_id"]: (str(r["revenue_rank_in_category"]), r["performance_tier"])
        for r in analyses.product_performance(totals).collect()
    }
    assert got == {r["product_id"]: (r["revenue_rank_in_category"], r["performance_tier"]) for r in performance.collect()}


def test_quartile_edges(performance):
    edges = analyses.quantile_columns(performance, "total_revenue", analyses.QUARTILES).first()
    assert [edges["q25"], edges["q50"], edges["q75"]] == pytest.approx([10653.0975, 12660.89, 15198.2225])


def test_top_products_and_category_totals(performance):
    top = [r["product_id"] for r in analyses.top_products(performance, 5).collect()]
    assert top == ["PROD-139", "PROD-146", "PROD-137", "PROD-111", "PROD-119"]
    summary = analyses.category_summary(performance).collect()
    assert (summary[0]["category"], summary[0]["total_revenue"]) == ("books", 155994.82)
    assert sum(Decimal(str(r["total_revenue"])) for r in summary) == Decimal("607104.32")


def test_revenue_matrix(spark, fixture_path):
    published = rows_of(fixture_path("revenue_pivot.csv"))
    categories = [c for c in published[0] if c not in ("year_month", "TOTAL", "mom_growth_pct")]
    cells = [
        (r["year_month"], c, Decimal(r[c]).quantize(Decimal("0.01"))) for r in published for c in categories if float(r[c])
    ]
    long = spark.createDataFrame(cells, "month string, category string, revenue decimal(18,2)")
    wide = {r["month"]: r for r in pivot_sum(long, "month", "category", "revenue", categories).collect()}
    assert len(wide) == 24 and len(categories) == 9
    for row in published:
        mine = wide[row["year_month"]]
        assert float(mine["TOTAL"]) == pytest.approx(float(row["TOTAL"]))
        assert all(float(mine[c]) == pytest.approx(float(row[c])) for c in categories)
    pairs = spark.createDataFrame(
        [(float(a["TOTAL"]), float(b["TOTAL"]), float(b["mom_growth_pct"])) for a, b in zip(published, published[1:])],
        "before double, after double, growth double",
    )
    for r in pairs.select(growth_pct(F.col("after"), F.col("before")).alias("g"), "growth").collect():
        assert r["g"] == pytest.approx(r["growth"])


def test_customer_segments(spark, fixture_path):
    text = read_csv_text(spark, fixture_path("customer_segments.csv"))
    spent = F.col("total_spent").cast("decimal(18,2)")
    orders = F.col("total_orders").cast("long")
    rows = text.select(
        "customer_id",
        "segment",
        spent.alias("total_spent"),
        orders.alias("total_orders"),
        F.col("avg_order_value").cast("double").alias("published"),
        # The published sums carry binary noise, which decides ties of the mean.
        round_half_even(analyses.mean_of(F.col("total_spent").cast("double"), orders)).alias("mean"),
        analyses.bin_right_closed(F.col("days_since_last_order").cast("int"), analyses.SEGMENT_EDGES, analyses.SEGMENTS).alias("label"),
    ).cache()
    assert rows.where("published <> mean OR segment <> label").count() == 0
    summary = {r["segment"]: (r["customers"], r["total_revenue"]) for r in analyses.segment_revenue(rows).collect()}
    assert summary == {"Active": (96, 332321.18), "At Risk": (52, 156242.08), "Churned": (51, 118541.06)}
    assert rows.where("total_orders > 5").count() == 61
