"""Profiles of customer, part and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from retail_spark.catalog.oracle_views import half_even
from retail_spark.catalog.registry import entry
from retail_spark.operators import profiling
from retail_spark.plans.cleaning import clean_all, flat_customers
from retail_spark.schemas import clean_schema
from retail_spark.sources.scratch import stage

# Column types of the given tables, as Spark names them.
TYPES = {
    "customer": {
        "c_custkey": "bigint",
        "c_name": "string",
        "c_nationkey": "int",
        "c_acctbal": "double",
        "c_mktsegment": "string",
    },
    "part": {
        "p_partkey": "bigint",
        "p_name": "string",
        "p_brand": "string",
        "p_type": "string",
        "p_size": "int",
        "p_retailprice": "double",
    },
    "documents": {
        "doc_id": "bigint",
        "text": "string",
        "lang": "string",
        "source": "string",
        "n_chars": "bigint",
    },
}


def _tables(v) -> dict[str, DataFrame]:
    return {name: v.table(name) for name in TYPES}


def _union(frames):
    return reduce(DataFrame.unionByName, frames)


def _table_sql(source: str, name: str, columns) -> str:
    return f"""SELECT '{name}' AS table_name, count(*) AS row_count, CAST({len(columns)} AS BIGINT) AS column_count,
    CAST(count(*) - count(DISTINCT ({", ".join(columns)})) AS BIGINT) AS duplicate_rows FROM {source}"""


def _column_sql(source: str, name: str, column: str, kind: str) -> str:
    nulls = f"(count(*) - count({column}))"
    return f"""SELECT '{name}' AS table_name, '{column}' AS column_name, '{kind}' AS data_type,
    CAST({nulls} AS BIGINT) AS null_count, {half_even(f"CAST({nulls} AS DOUBLE) / count(*) * 100")} AS null_pct,
    CAST(count(DISTINCT {column}) + CASE WHEN {nulls} > 0 THEN 1 ELSE 0 END AS BIGINT) AS unique_count FROM {source}"""


def _value_sql(source: str, name: str, column: str) -> str:
    share = f"CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM {source}) * 100"
    distinct = f"(SELECT count(*) FROM (SELECT DISTINCT {column} FROM {source}) d)"
    return f"""SELECT '{name}' AS table_name, '{column}' AS column_name, {column} AS value, count(*) AS value_count,
    {half_even(share, 1)} AS value_pct FROM {source} WHERE {distinct} <= 20 GROUP BY {column}"""


def _each(make, types=TYPES) -> str:
    return "\nUNION ALL ".join(make(table, columns) for table, columns in types.items())


@entry("profile_table", _each(lambda t, cols: _table_sql(t, t, cols)))
def profile_table(v):
    return _union(profiling.profile_table(df, name) for name, df in _tables(v).items())


@entry(
    "profile_columns",
    _each(lambda t, cols: "\nUNION ALL ".join(_column_sql(t, t, c, kind) for c, kind in cols.items())),
)
def profile_columns(v):
    return _union(profiling.profile_columns(df, name) for name, df in _tables(v).items())


@entry(
    "profile_value_counts",
    _each(
        lambda t, cols: "\nUNION ALL ".join(_value_sql(t, t, c) for c, kind in cols.items() if kind == "string")
    ),
)
def profile_value_counts(v):
    return _union(profiling.profile_values(df, name) for name, df in _tables(v).items())


_PROFILED = {
    "customers": "customer_id first_name last_name email phone city country postal_code signup_date is_active loyalty_tier",
    "products": "product_id sku product_name category unit_price stock_quantity weight_kg created_date",
    "orders": "order_id customer_id product_id quantity unit_price total_amount order_date status payment_method "
    "shipping_address_city discount_pct",
    "reviews": "review_id product_id customer_id rating review_text review_date verified_purchase helpful_votes",
}


def _unpivoted(source: str, columns: list[str], measure: str, name: str) -> str:
    counts = ", ".join(f"CAST({measure.format(c=c)} AS BIGINT) AS {c}" for c in columns)
    return f"(UNPIVOT (SELECT {counts} FROM {source}) ON {', '.join(columns)} INTO NAME column_name VALUE {name})"


def _states():
    """Label, source and columns of every table before and after cleaning."""
    for table, names in _PROFILED.items():
        yield f"{table}_raw", f"r_{table}", names.split()
        more = {"customers": ["has_email"], "reviews": ["has_review_text"]}.get(table, [])
        yield f"{table}_clean", f"k_{table}" if table in ("orders", "reviews") else f"c_{table}", names.split() + more


def profile_all_sql() -> str:
    """Rows of the ``tables`` frame (no column name) and of the ``columns`` frame, before and after cleaning."""
    parts = []
    for label, source, columns in _states():
        whole = f"(SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(columns)} FROM {source}) d) AS twice FROM {source})"
        parts.append(
            f"SELECT '{label}' AS table_name, CAST(NULL AS VARCHAR) AS column_name, CAST(n AS BIGINT) AS row_count, "
            f"CAST({len(columns)} AS BIGINT) AS column_count, CAST(twice AS BIGINT) AS duplicate_rows, CAST(NULL AS BIGINT) AS null_count, "
            f"CAST(NULL AS DOUBLE) AS null_pct, CAST(NULL AS BIGINT) AS unique_count FROM {whole} w"
        )
        share = half_even("CAST(null_count AS DOUBLE) / row_count * 100")
        parts.append(
            f"SELECT '{label}', column_name, NULL, NULL, NULL, null_count, {share}, unique_count "
            f"FROM {_unpivoted(source, columns, 'count(*) - count({c})', 'null_count')} a "
            f"JOIN {_unpivoted(source, columns, 'count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)', 'unique_count')} b "
            f"USING (column_name), (SELECT count(*) AS row_count FROM {source}) c"
        )
    return "\nUNION ALL ".join(parts)


def profile_values_sql() -> str:
    """Rows of the ``values`` frame: every text column of the raw tables, and those that stay text."""
    parts = []
    for label, source, columns in _states():
        table, state = label.split("_")
        text = {f.name for f in clean_schema(table).fields if f.dataType.simpleString() == "string"}
        parts += [_value_sql(source, label, c) for c in columns if state == "raw" or c in text]
    return "\nUNION ALL ".join(parts)


def labelled_bundle(v) -> dict[str, DataFrame]:
    """All tables before and after cleaning, under one name each.  The raw ones are written once, with the order that cleaning needs."""
    held = {table: stage(df, "raw") for table, df in v.raw.items()}
    raw = {t: df.drop("src_ord") for t, df in dict(held, customers=flat_customers(held["customers"])).items()}
    clean = {table: stage(df, "clean") for table, df in clean_all(held, stage).items()}
    return {f"{t}_raw": df for t, df in raw.items()} | {f"{t}_clean": df for t, df in clean.items()}


def tables_and_columns(profile: dict[str, DataFrame]) -> DataFrame:
    return profile["tables"].unionByName(profile["columns"].drop("data_type"), allowMissingColumns=True)


@entry("profile_all", profile_all_sql())
def profile_all(v):
    """All tables before and after cleaning."""
    return tables_and_columns(profiling.profile_all(labelled_bundle(v), ("tables", "columns")))
