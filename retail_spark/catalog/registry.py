"""Registration of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DateType, DecimalType, FloatType, IntegerType, ShortType

from retail_spark.catalog.oracle_views import with_views
from retail_spark.session import configure
from retail_spark.sources.bindings import RetailViews


@dataclass(frozen=True)
class Entry:
    key: str
    build: Callable[[RetailViews], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def entry(key: str, sql: str | None = None):
    """Register a query; ``sql`` may use the views of ``oracle_views``."""

    def register(build: Callable[[RetailViews], DataFrame]):
        if key in ENTRIES:
            raise ValueError(f"{key} is registered twice")
        ENTRIES[key] = Entry(key, build, sql)
        return build

    return register


def portable(df: DataFrame) -> DataFrame:
    """Types that every engine prints alike: whole numbers as bigint, other
    numbers as double, dates as ISO text."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (ByteType, ShortType, IntegerType)):
            c = c.cast("bigint")
        elif isinstance(kind, DecimalType):
            c = c.cast("bigint" if kind.scale == 0 else "double")
        elif isinstance(kind, FloatType):
            c = c.cast("double")
        elif isinstance(kind, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(item: Entry):
        return lambda spark, folder: portable(item.build(RetailViews(configure(spark), folder)))

    return {key: bound(item) for key, item in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: with_views(item.sql) for key, item in ENTRIES.items() if item.sql}
