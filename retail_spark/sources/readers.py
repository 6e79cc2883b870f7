"""Readers for raw text tables and reloaded clean tables.  Schemas are declared,
never inferred, so nothing is read twice."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retail_spark.functions.cleaning import clean_names, missing_to_null
from retail_spark.schemas import (
    RAW_CUSTOMERS,
    RAW_ORDERS,
    RAW_PRODUCTS,
    RAW_REVIEWS,
    TABLES,
    clean_schema,
)

SOURCE_ORDER = "src_ord"
# Tables with free text, which may hold line breaks.
FREE_TEXT = ("products", "reviews")
# Quotes inside quoted text are doubled, as spreadsheet exports write them.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def source_order() -> Column:
    """Position of a row in its files: file, split, then row within the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_csv_text(
    spark: SparkSession, path: str, schema: StructType | None = None, ordered: bool = False, multiline: bool = False
) -> DataFrame:
    """CSV with a header, every column text, missing tokens NULL.

    Columns go by their header name; ``schema`` says which ones to take.
    ``multiline`` admits line breaks inside quoted text, at the price that a file
    is then read by one task.
    """
    raw = spark.read.options(**CSV_OPTIONS).option("multiLine", multiline).csv(path)
    text = text_to_missing(raw, ordered)
    if schema is None:
        return text
    return text.select(*schema.fieldNames(), *([SOURCE_ORDER] if ordered else []))


def text_to_missing(raw: DataFrame, ordered: bool = False) -> DataFrame:
    columns = [
        missing_to_null(F.col(f"`{field.name}`")).alias(name)
        for field, name in zip(raw.schema.fields, clean_names(raw.columns), strict=True)
    ]
    if ordered:
        columns.append(source_order().alias(SOURCE_ORDER))
    return raw.select(*columns)


def read_customers_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Nested customer documents; one per line, or (``lines=False``) one array per file.

    A record that is no document stops the read: an array spread over lines, read
    as lines, would otherwise become rows of NULLs.
    """
    return spark.read.schema(RAW_CUSTOMERS).options(multiLine=not lines, mode="FAILFAST").json(path)


def flatten(df: DataFrame, *structs: str, separator: str = ".") -> DataFrame:
    """Named structs of one level to dotted top-level columns."""
    columns = []
    for field in df.schema.fields:
        if field.name in structs:
            columns += [
                F.col(field.name).getField(inner).alias(f"{field.name}{separator}{inner}")
                for inner in field.dataType.fieldNames()
            ]
        else:
            columns.append(F.col(f"`{field.name}`"))
    return df.select(*columns)


def read_raw_bundle(
    spark: SparkSession,
    root: str,
    ordered: bool = True,
    customers_lines: bool = True,
    multiline: Collection[str] = FREE_TEXT,
) -> dict[str, DataFrame]:
    """All four raw tables under ``root`` (``<name>_raw.csv``, ``customers_raw.json``).

    ``customers_lines=False`` reads one array per file.  The tables named in
    ``multiline`` may hold line breaks inside quoted text; their files are not split, so
    large ones should come in parts.
    """
    customers = read_customers_json(spark, f"{root}/customers_raw.json", customers_lines)
    if ordered:
        customers = customers.withColumn(SOURCE_ORDER, source_order())
    schemas = {"products": RAW_PRODUCTS, "orders": RAW_ORDERS, "reviews": RAW_REVIEWS}
    texts = {
        table: read_csv_text(spark, f"{root}/{table}_raw.csv", schema, ordered, table in multiline)
        for table, schema in schemas.items()
    }
    return {"customers": customers, **texts}


def register(bundle: dict[str, DataFrame], prefix: str = "") -> None:
    for name, df in bundle.items():
        df.createOrReplaceTempView(f"{prefix}{name}")


def read_clean_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A clean CSV with its declared types; missing tokens are NULL, line breaks in free text are kept."""
    text = read_csv_text(spark, path, multiline=table in FREE_TEXT)
    return text.select(
        *[F.col(field.name).try_cast(field.dataType).alias(field.name) for field in clean_schema(table).fields]
    )


def read_clean_bundle(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The four clean tables as written by ``writers.write_clean``."""
    if fmt == "csv":
        return {t: read_clean_csv(spark, f"{root}/{t}_clean.csv", t) for t in TABLES}
    return {t: spark.read.schema(clean_schema(t)).parquet(f"{root}/{t}_clean.parquet") for t in TABLES}
