"""Readers and sinks: tables are written out to the scratch folder and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.catalog import analysis  # noqa: F401  its SQL is used here
from retail_spark.catalog.profiling import labelled_bundle, profile_all_sql, profile_values_sql, tables_and_columns
from retail_spark.catalog.registry import ENTRIES, entry
from retail_spark.operators.profiling import profile_all
from retail_spark.plans.analyses import discount_impact, revenue_pivot
from retail_spark.plans.questions import QUESTIONS, answer_all
from retail_spark.schemas import RAW_CUSTOMERS, RAW_ORDERS, TABLES, clean_schema
from retail_spark.sources import readers, writers
from retail_spark.sources.readers import SOURCE_ORDER
from retail_spark.sources.scratch import scratch_path


def _write_csv(df: DataFrame, path: str) -> None:
    df.drop(SOURCE_ORDER).write.options(**writers.CSV_OPTIONS).option("nullValue", "N/A").csv(path)


def write_raw(v) -> str:
    """The raw views as files: CSV with ``N/A`` for missing text, customers as JSON lines."""
    root = scratch_path(v.spark, "raw")
    for table in ("products", "orders", "reviews"):
        _write_csv(v.raw[table], f"{root}/{table}_raw.csv")
    v.customers_raw.select(*RAW_CUSTOMERS.fieldNames()).write.json(f"{root}/customers_raw.json")
    return root


_ORDERS_TEXT = """SELECT order_id, customer_id, product_id, quantity, unit_price, total_amount, order_date, status,
    payment_method, shipping_address_city, discount_pct FROM r_orders"""


@entry("src_csv_text", _ORDERS_TEXT)
def src_csv_text(v):
    path = scratch_path(v.spark, "orders") + "/orders_raw.csv"
    _write_csv(v.orders_raw, path)
    return readers.read_csv_text(v.spark, path, RAW_ORDERS)


@entry(
    "src_json_nested",
    """SELECT customer_id, email, phone, signup_date, is_active, loyalty_tier, first_name AS name_first, last_name AS name_last,
    city AS address_city, country AS address_country, postal_code AS address_postal_code FROM r_customers""",
)
def src_json_nested(v):
    path = scratch_path(v.spark, "customers")
    v.customers_raw.select(*RAW_CUSTOMERS.fieldNames()).write.json(path)
    flat = readers.flatten(readers.read_customers_json(v.spark, path), "name", "address")
    return flat.toDF(*[name.replace(".", "_") for name in flat.columns])


@entry(
    "src_bundle",
    """SELECT 'customers' AS table_name, count(*) AS row_count, count(DISTINCT customer_id) AS ids FROM r_customers
    UNION ALL SELECT 'products', count(*), count(DISTINCT product_id) FROM r_products
    UNION ALL SELECT 'orders', count(*), count(DISTINCT order_id) FROM r_orders
    UNION ALL SELECT 'reviews', count(*), count(DISTINCT review_id) FROM r_reviews""",
)
def src_bundle(v):
    bundle = readers.read_raw_bundle(v.spark, write_raw(v))
    readers.register(bundle, prefix="raw_")
    keys = {"customers": "customer_id", "products": "product_id", "orders": "order_id", "reviews": "review_id"}
    counts = [
        v.spark.table(f"raw_{t}").agg(
            F.lit(t).alias("table_name"), F.count("*").alias("row_count"), F.count_distinct(key).alias("ids")
        )
        for t, key in keys.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def _write_clean(v, fmt: str) -> str:
    root = scratch_path(v.spark, "clean")
    writers.write_clean(v.clean, root, fmt)
    return root


_BUNDLE_SUMS = """SELECT 'customers' AS table_name, count(*) AS row_count, count(email) AS present,
      strftime(max(signup_date), '%Y-%m-%d') AS latest, CAST(count(*) FILTER (WHERE is_active) AS DOUBLE) AS total FROM v_customers
    UNION ALL SELECT 'products', count(*), count(weight_kg), strftime(max(created_date), '%Y-%m-%d'),
      CAST(sum(unit_price) AS DOUBLE) FROM v_products
    UNION ALL SELECT 'orders', count(*), count(total_amount), strftime(max(order_date), '%Y-%m-%d'),
      CAST(sum(total_amount) AS DOUBLE) FROM v_orders
    UNION ALL SELECT 'reviews', count(*), count(rating), strftime(max(review_date), '%Y-%m-%d'), CAST(sum(rating) AS DOUBLE)
      FROM v_reviews"""
_SUMMED = {
    "customers": ("email", "signup_date", F.count_if),
    "products": ("weight_kg", "created_date", F.sum),
    "orders": ("total_amount", "order_date", F.sum),
    "reviews": ("rating", "review_date", F.sum),
}
_VALUES = {"customers": "is_active", "products": "unit_price", "orders": "total_amount", "reviews": "rating"}


def _bundle_sums(bundle) -> DataFrame:
    frames = []
    for table in TABLES:
        present, date, total = _SUMMED[table]
        frames.append(
            bundle[table].agg(
                F.lit(table).alias("table_name"),
                F.count("*").alias("row_count"),
                F.count(present).alias("present"),
                F.max(date).alias("latest"),
                total(F.col(_VALUES[table])).cast("double").alias("total"),
            )
        )
    return reduce(DataFrame.unionByName, frames)


@entry(
    "src_csv_typed",
    """SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id,
    CAST(product_id AS VARCHAR) AS product_id, CAST(quantity AS BIGINT) AS quantity, CAST(unit_price AS DOUBLE) AS unit_price,
    CAST(total_amount AS DOUBLE) AS total_amount, strftime(order_date, '%Y-%m-%d') AS order_date, status, payment_method,
    shipping_address_city, discount_pct FROM v_orders""",
)
def src_csv_typed(v):
    root = scratch_path(v.spark, "clean")
    writers.write_clean({"orders": v.orders}, root, "csv")
    return readers.read_clean_csv(v.spark, f"{root}/orders_clean.csv", "orders")


@entry("src_clean_reload", _BUNDLE_SUMS)
def src_clean_reload(v):
    return _bundle_sums(readers.read_clean_bundle(v.spark, _write_clean(v, "csv"), "csv"))


@entry("sink_clean_tables", _BUNDLE_SUMS)
def sink_clean_tables(v):
    root = scratch_path(v.spark, "clean")
    writers.write_clean({t: _as_declared(v.clean[t], t) for t in TABLES}, root)
    return _bundle_sums(readers.read_clean_bundle(v.spark, root))


def _as_declared(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in clean_schema(table).fields])


def _report_sql(report: str, sql: str, key: str) -> str:
    cells = f"SELECT {key}, COLUMNS(lambda c: c <> '{key}')::DOUBLE FROM ({sql}) t"
    return f"""SELECT '{report}' AS report, {key} AS row_key, column_name, cell
    FROM (UNPIVOT ({cells}) ON COLUMNS(* EXCLUDE ({key})) INTO NAME column_name VALUE cell)"""


@entry(
    "sink_analysis",
    "\nUNION ALL ".join(
        [
            _report_sql("revenue_pivot", ENTRIES["a1_revenue_pivot"].sql, "year_month"),
            _report_sql("discount_impact", ENTRIES["a4_discount_impact"].sql, "discount_tier"),
        ]
    ),
)
def sink_analysis(v):
    """Two analyses as CSV files, read back whole: every cell that is not empty, by row and column."""
    root = scratch_path(v.spark, "analysis")
    reports = {
        "revenue_pivot": (revenue_pivot(v.orders, v.products), "year_month"),
        "discount_impact": (discount_impact(v.orders), "discount_tier"),
    }
    cells = []
    for name, (report, key) in reports.items():
        writers.write_report(report, f"{root}/{name}", single_file=True)
        # Column names are data here (categories): they are taken as they stand in the file.
        saved = v.spark.read.options(**writers.CSV_OPTIONS).csv(f"{root}/{name}")
        long = saved.unpivot([key], None, "column_name", "cell").where("cell is not null")
        cells.append(long.select(F.lit(name).alias("report"), F.col(key).alias("row_key"), "column_name", F.col("cell").cast("double").alias("cell")))
    return reduce(DataFrame.unionByName, cells)


_PROFILE_SCHEMAS = {
    "tables": "table_name string, row_count bigint, column_count bigint, duplicate_rows bigint",
    "columns": "table_name string, column_name string, data_type string, null_count bigint, null_pct double, unique_count bigint",
    "values": "table_name string, column_name string, value string, value_count bigint, value_pct double",
}


@entry(
    "sink_profile_report",
    f"""SELECT t.*, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS value_count, CAST(NULL AS DOUBLE) AS value_pct FROM ({profile_all_sql()}) t
    UNION ALL SELECT table_name, column_name, NULL, NULL, NULL, NULL, NULL, NULL, value, value_count, value_pct FROM ({profile_values_sql()}) u""",
)
def sink_profile_report(v):
    """All three profile frames of all tables before and after cleaning, written and read back."""
    root = scratch_path(v.spark, "profile")
    writers.write_profile(profile_all(labelled_bundle(v)), root)
    saved = {name: v.spark.read.schema(schema).json(f"{root}/profile_{name}") for name, schema in _PROFILE_SCHEMAS.items()}
    return tables_and_columns(saved).unionByName(saved["values"], allowMissingColumns=True)


_RESULT_ROWS = {
    1: "least((SELECT count(DISTINCT product_id) FROM v_orders WHERE total_amount IS NOT NULL), 5)",
    2: "1",
    3: "1",
    4: "(SELECT count(DISTINCT category) FROM v_orders s JOIN v_products p ON p.product_id = s.product_id)",
    5: """(SELECT count(DISTINCT strftime(order_date, '%Y-%m')) FROM v_orders WHERE total_amount IS NOT NULL
        AND order_date >= (SELECT CAST(date_trunc('month', max(order_date)) - INTERVAL 12 MONTH AS DATE)
        + CAST(day(max(order_date)) - 1 AS INTEGER) FROM v_orders))""",
    6: """(SELECT count(*) FROM (SELECT product_id FROM v_reviews WHERE rating IS NOT NULL GROUP BY product_id
        HAVING round(CAST(sum(rating) / count(rating) AS DECIMAL(38,6)), 2) < 3) t)""",
    7: "1",
    8: "(SELECT count(*) FROM (SELECT customer_id FROM v_orders GROUP BY customer_id HAVING count(*) > 5) t)",
    9: "1",
    10: "1",
}


@entry(
    "sink_query_results",
    "\nUNION ALL ".join(
        f"SELECT CAST({n} AS BIGINT) AS question_number, '{question}' AS question, true AS success, CAST({_RESULT_ROWS[n]} AS BIGINT) AS row_count"
        for n, (question, _) in enumerate(QUESTIONS.values(), 1)
    ),
)
def sink_query_results(v):
    path = scratch_path(v.spark, "answers")
    records = answer_all(v.spark, v.clean)
    writers.write_records(records, path)
    saved = v.spark.read.schema(records.schema).json(path)
    return saved.select("question_number", "question", "success", "row_count")
