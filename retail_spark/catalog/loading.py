"""Loading the star schema, run reports and incremental loads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.catalog.registry import entry
from retail_spark.catalog.validation import CLEAN_SOURCES, STORABLE
from retail_spark.plans.cleaning import clean_all, clean_customers, clean_products
from retail_spark.plans.runs import append_run, run_pipeline
from retail_spark.schemas import RAW_ORDERS, RAW_REVIEWS, TABLES
from retail_spark.sources import store
from retail_spark.sources.readers import SOURCE_ORDER
from retail_spark.sources.scratch import scratch_path, stage
from retail_spark.sources.writers import CSV_OPTIONS
from retail_spark.streaming.incremental import incremental_load


def _counted(step: str, tables) -> DataFrame:
    frames = [
        tables[t].agg(F.lit(step).alias("step"), F.lit(t).alias("table_name"), F.count("*").alias("row_count"))
        for t in tables
    ]
    return reduce(DataFrame.unionByName, frames)


def _stored_counts(step: str, tables=TABLES) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{step}' AS step, '{t}' AS table_name, count(*) AS row_count FROM {CLEAN_SOURCES[t]} WHERE {STORABLE[t]}"
        for t in tables
    )


# Every column of the stored tables, as the cleaned views have them.
_CONTENT = {
    "customers": """customer_id, first_name, last_name, email, CAST(has_email AS BIGINT) AS has_email, phone, city, country, postal_code,
    strftime(signup_date, '%Y-%m-%d') AS signup_date, CAST(coalesce(is_active, false) AS BIGINT) AS is_active, loyalty_tier""",
    "products": """product_id, sku, product_name, category, CAST(unit_price AS DOUBLE) AS unit_price,
    CAST(greatest(stock_quantity, 0) AS BIGINT) AS stock_quantity, weight_kg, strftime(created_date, '%Y-%m-%d') AS created_date""",
    "orders": """order_id, customer_id, product_id, CAST(quantity AS BIGINT) AS quantity, CAST(unit_price AS DOUBLE) AS unit_price,
    CAST(total_amount AS DOUBLE) AS total_amount, strftime(order_date, '%Y-%m-%d') AS order_date, status, payment_method,
    shipping_address_city, discount_pct""",
    "reviews": """review_id, customer_id, product_id, rating, review_text, CAST(has_review_text AS BIGINT) AS has_review_text,
    strftime(review_date, '%Y-%m-%d') AS review_date, CAST(verified_purchase AS BIGINT) AS verified_purchase,
    CAST(helpful_votes AS BIGINT) AS helpful_votes""",
}


def _content_sql(*tables: str) -> str:
    return "\nUNION ALL BY NAME ".join(
        f"SELECT '{t}' AS table_name, {_CONTENT[t]} FROM {CLEAN_SOURCES[t]} WHERE {STORABLE[t]}" for t in tables
    )


def _content(spark, root: str, *tables: str) -> DataFrame:
    """All rows of some stored tables, one below the other."""
    stored = store.read_store(spark, root)
    found = [stored[t].withColumn("table_name", F.lit(t)) for t in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


@entry("load_insert_ignore", _content_sql(*TABLES))
def load_insert_ignore(v):
    """All tables go in, products and orders twice, products again under new ids with old SKUs: only first inserts add rows.

    One more batch of products breaks NOT NULL and CHECK rules, and one of orders points at a
    product that is not stored and stops with nothing written.
    """
    root = scratch_path(v.spark, "store")
    store.create_schema(v.spark, root)
    bundle = {table: stage(df, table) for table, df in clean_all(v.raw, stage).items()}
    for table in (*TABLES, "products", "orders"):
        store.load_insert_ignore(v.spark, root, table, bundle[table])
    products = bundle["products"]
    store.load_insert_ignore(v.spark, root, "products", products.withColumn("product_id", F.concat(F.lit("again-"), "product_id")))
    broken = products.select(
        *[
            F.concat(F.lit("new-"), c).alias(c) if c in ("product_id", "sku") else F.col(c)
            for c in products.columns
            if c not in ("product_name", "unit_price")
        ],
        F.when(F.col("unit_price") > 1000, "product_name").alias("product_name"),
        F.when(F.col("unit_price") > 1000, F.col("unit_price")).otherwise(-F.col("unit_price")).alias("unit_price"),
    )
    store.load_insert_ignore(v.spark, root, "products", broken.where("product_name is null or unit_price < 0"))
    dangling = bundle["orders"].withColumn("order_id", F.concat(F.lit("new-"), "order_id")).withColumn("product_id", F.lit("nowhere"))
    try:
        store.load_insert_ignore(v.spark, root, "orders", dangling)
    except store.DanglingKeyError:
        pass
    return _content(v.spark, root, *TABLES)


@entry("load_star_schema", _stored_counts("loaded"))
def load_star_schema(v):
    bundle = {table: stage(df, table) if table in store.FACTS else df for table, df in clean_all(v.raw, stage).items()}
    return _counted("loaded", store.load_star_schema(v.spark, scratch_path(v.spark, "store"), bundle))


@entry(
    "load_full_reload",
    "\nUNION ALL ".join(_stored_counts(step) for step in ("first", "again", "failed", "reloaded")),
)
def load_full_reload(v):
    """Load all tables, load again (nothing new), fail half-way through a reload (nothing changes), reload from scratch."""
    root = scratch_path(v.spark, "store")
    bundle = {table: stage(df, table) for table, df in clean_all(v.raw, stage).items()}
    counts = []
    for step, force in (("first", False), ("again", False), ("failed", True), ("reloaded", True)):
        # Without products the orders of a reload point nowhere, when customers are written already.
        loading = bundle | {"products": bundle["products"].limit(0)} if step == "failed" else bundle
        try:
            store.load_star_schema(v.spark, root, loading, force_reload=force)
        except store.DanglingKeyError:
            pass
        counts.append(stage(_counted(step, store.read_store(v.spark, root)), "counts"))
    return reduce(DataFrame.unionByName, counts)


@entry(
    "etl_run_report",
    f"""SELECT 'completed' AS status, table_name, row_count AS rows_loaded, CAST(0 AS BIGINT) AS errors
    FROM ({_stored_counts("x")}) t""",
)
def etl_run_report(v):
    """The run record, one row per table; its times and job id differ from run to run."""
    report = run_pipeline(v.spark, v.raw, scratch_path(v.spark, "store"))
    log = scratch_path(v.spark, "runs")
    append_run(report, log)
    saved = v.spark.read.schema(report.schema).parquet(log)
    return saved.select("status", F.explode("rows_loaded").alias("table_name", "rows_loaded"), F.size("errors").alias("errors"))


@entry(
    "incremental_clean_load",
    _content_sql("orders", "reviews"),
)
def incremental_clean_load(v):
    """Order and review files arrive before some of their products and customers, which free what waits for them.

    Every second product and every third customer comes late, the customers first; a run after that finds nothing
    new.  The lines of one order lie in one file, in their order, so that "first" means
    the same as in the batch pipeline.
    """
    root = scratch_path(v.spark, "stream")
    customers, products = (stage(df, "dims") for df in (clean_customers(v.customers_raw), clean_products(v.products_raw)))
    late = {
        "customers": (customers, F.crc32(F.col("customer_id").cast("binary")) % 3 == 0),
        "products": (products, F.crc32(F.col("product_id").cast("binary")) % 2 == 0),
    }
    for table, (df, is_late) in late.items():
        store.load_insert_ignore(v.spark, f"{root}/store", table, df.where(~is_late))
    for table, raw, key, schema in (
        ("orders", v.orders_raw, "order_id", RAW_ORDERS),
        ("reviews", v.reviews_raw, "review_id", RAW_REVIEWS),
    ):
        files = raw.repartitionByRange(key).sortWithinPartitions(key, SOURCE_ORDER).select(*schema.fieldNames())
        files.write.options(**CSV_OPTIONS).option("nullValue", "N/A").csv(f"{root}/{table}")

    def arrive():
        for table in ("orders", "reviews"):
            incremental_load(v.spark, f"{root}/{table}", f"{root}/store", f"{root}/checkpoint-{table}", table, files_per_batch=16)

    arrive()
    for table, (df, is_late) in late.items():
        store.load_insert_ignore(v.spark, f"{root}/store", table, df.where(is_late))
    arrive()
    return _content(v.spark, f"{root}/store", "orders", "reviews")
