"""The jobs end to end on a small bundle of files."""

import pytest
from pyspark.sql import functions as F

from retail_spark.plans.jobs import analysis_job, cleaning_job, load_job
from retail_spark.sources import readers, writers
from retail_spark.sources.store import read_store
from test_store import SOURCE_ORDER, raw  # noqa: F401


def test_files_to_analyses(spark, raw, tmp_path):  # noqa: F811
    root, out, store = (str(tmp_path / name) for name in ("raw", "clean", "store"))
    # Only rows that the store accepts, so that every check can pass.
    raw["orders"] = raw["orders"].where("order_id NOT IN ('o7', 'o8')")
    for table in ("products", "orders", "reviews"):
        raw[table].drop(SOURCE_ORDER).coalesce(1).write.options(**writers.CSV_OPTIONS).csv(f"{root}/{table}_raw.csv")
    raw["customers"].drop(SOURCE_ORDER).coalesce(1).write.json(f"{root}/customers_raw.json")

    done = cleaning_job(spark, root, out)
    rows = {r["table_name"]: (r["raw_rows"], r["clean_rows"], r["dropped_rows"]) for r in done["rows"].collect()}
    assert rows == {"customers": (3, 2, 1), "products": (4, 2, 2), "orders": (8, 2, 6), "reviews": (3, 1, 2)}
    outcome = done["validation"].agg(F.count("*").alias("n"), F.count_if("passed").alias("ok")).first()
    assert (outcome["n"], outcome["ok"]) == (28, 28)
    report = readers.read_csv_text(spark, f"{out}/quality_report")
    assert report.count() == 36
    profiles = spark.read.json(f"{out}/profile_raw/profile_tables")
    assert {r["table_name"]: r["duplicate_rows"] for r in profiles.collect()} == {
        "customers_raw": 0,
        "orders_raw": 1,
        "products_raw": 0,
        "reviews_raw": 0,
    }

    verdict = load_job(spark, out, store).first()
    assert (verdict["checks"], verdict["all_passed"]) == (18, True)

    results = analysis_job(read_store(spark, store), str(tmp_path / "reports"))
    saved = {name: spark.read.option("header", True).csv(str(tmp_path / "reports" / name)) for name in results}
    assert [r["year_month"] for r in saved["revenue_pivot"].collect()] == ["2024-01"]
    assert {r["customer_id"]: r["segment"] for r in saved["customer_segments"].collect()} == {"c1": "Active", "c2": "Active"}
    tiers = {r["product_id"]: (r["total_revenue"], r["revenue_rank_in_category"]) for r in saved["product_performance"].collect()}
    assert tiers == {"p1": ("20.00", "1"), "p2": ("0.00", "1")}
    impact = {r["discount_tier"]: r["median_order_value"] for r in saved["discount_impact"].collect()}
    assert impact["No discount"] == "20.0" and len(impact) == 2
    assert pytest.approx(sum(float(r["total_revenue"]) for r in saved["discount_impact"].collect())) == 20.0
