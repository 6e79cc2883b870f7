"""Run records: the query log and the report of a pipeline run."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from retail_spark.operators.ordering import LOG_ENTRIES, page_newest_first, retain_newest
from retail_spark.plans.cleaning import clean_all
from retail_spark.schemas import TABLES
from retail_spark.sources.scratch import stage
from retail_spark.sources.store import FACTS, DanglingKeyError, load_star_schema

RUN_SCHEMA = (
    "job_id string, status string, started_at timestamp, completed_at timestamp, duration_sec double, "
    "rows_loaded map<string, bigint>, errors array<string>"
)


def query_history(log: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """One page of the retained log, newest first, with the retained total."""
    total = log.agg(F.least(F.count("*"), F.lit(LOG_ENTRIES))).scalar()
    return page_newest_first(retain_newest(log, "id"), "id", limit, offset).withColumn("total", total)


def run_pipeline(
    spark: SparkSession, raw: Mapping[str, DataFrame], root: str, force_reload: bool = False
) -> DataFrame:
    """Clean, load and report: one row for the run log.

    Row counts are observed while the tables are written, so no table is read
    again to count it.  A failure is recorded, not raised.
    """
    started = datetime.now(timezone.utc)
    observed = {table: Observation(f"{table}-{uuid4().hex}") for table in TABLES}

    def counted(table: str, df: DataFrame) -> DataFrame:
        return df.observe(observed[table], F.count("*").alias("rows"))

    errors: list[str] = []
    loaded: dict[str, int] = {}
    try:
        # Written first: the conditions of the load would be pushed below cleaning and clean the rows once more.
        cleaned = {table: stage(df, table) if table in FACTS else df for table, df in clean_all(raw, stage).items()}
        load_star_schema(spark, root, cleaned, force_reload, counted)
        loaded = {table: observed[table].get["rows"] for table in TABLES}
    except (PySparkException, DanglingKeyError) as failure:
        errors.append(str(failure).splitlines()[0])
    ended = datetime.now(timezone.utc)
    record = (
        f"etl_{started:%Y%m%d_%H%M%S}_{uuid4().hex[:6]}",
        "failed" if errors else "completed",
        started,
        ended,
        round((ended - started).total_seconds(), 2),
        loaded,
        errors,
    )
    return spark.createDataFrame([record], RUN_SCHEMA)


def append_run(report: DataFrame, path: str) -> None:
    report.write.mode("append").parquet(path)
