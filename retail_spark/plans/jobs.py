"""The batch jobs end to end: clean and check files, load and verify, analyse.

Each job writes its tables once and does everything else on what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retail_spark.operators.profiling import profile_all
from retail_spark.operators.rules import validate_all, verdict, verify_all
from retail_spark.plans import analyses
from retail_spark.plans.cleaning import clean_all, flat_customers, reconcile_rows
from retail_spark.plans.quality_report import quality_report
from retail_spark.sources.readers import SOURCE_ORDER, read_clean_bundle, read_raw_bundle
from retail_spark.sources.scratch import stage
from retail_spark.sources.store import load_star_schema
from retail_spark.sources.writers import write_clean, write_profile, write_report


def cleaning_job(
    spark: SparkSession, raw_root: str, out_root: str, customers_lines: bool = True
) -> dict[str, DataFrame]:
    """Profile, clean, write, profile again, validate and reconcile.

    ``customers_lines=False`` reads customers from one JSON array per file.  The raw files are parsed
    once: everything works on a staged copy.  Returns the clean tables as written, with ``validation`` and ``rows``.
    """
    raw = read_raw_bundle(spark, raw_root, customers_lines=customers_lines)
    raw = {name: stage(df, f"raw-{name}") for name, df in raw.items()}
    plain = {name: df.drop(SOURCE_ORDER) for name, df in raw.items()}
    plain["customers"] = flat_customers(plain["customers"])
    write_profile(profile_all({f"{name}_raw": df for name, df in plain.items()}), f"{out_root}/profile_raw")
    write_clean(clean_all(raw, stage), out_root)
    clean = read_clean_bundle(spark, out_root)
    write_profile(profile_all({f"{name}_clean": df for name, df in clean.items()}), f"{out_root}/profile_clean")
    validation, rows = stage(validate_all(clean)), stage(reconcile_rows(raw, clean))
    write_report(validation, f"{out_root}/validation", single_file=True)
    write_report(rows, f"{out_root}/rows", single_file=True)
    write_report(quality_report(raw, stage), f"{out_root}/quality_report", single_file=True)
    return {**clean, "validation": validation, "rows": rows}


def load_job(spark: SparkSession, clean_root: str, store_root: str, force_reload: bool = False) -> DataFrame:
    """Load the written clean tables and verify the store: one row ``checks, all_passed``."""
    clean = read_clean_bundle(spark, clean_root)
    stored = load_star_schema(spark, store_root, clean, force_reload)
    return verdict(verify_all(stored, clean))


def analysis_job(tables: dict[str, DataFrame], out_root: str) -> dict[str, DataFrame]:
    """Write the four analyses; the per-customer and per-product ones in parts, the
    matrix and the tiers as single files."""
    orders, products = tables["orders"], tables["products"]
    totals = stage(analyses.product_totals(orders, products, tables["reviews"]))
    results = {
        "revenue_pivot": analyses.revenue_pivot(orders, products),
        "customer_segments": analyses.customer_segments(orders, tables["customers"]),
        "product_performance": analyses.product_performance(totals),
        "discount_impact": analyses.discount_impact(orders),
    }
    for name, df in results.items():
        write_report(df, f"{out_root}/{name}", single_file=name in ("revenue_pivot", "discount_impact"))
    return results
