"""Sinks for clean tables, analyses, profiles and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from retail_spark.schemas import clean_schema

# Text is written as it is: quotes doubled, blanks at the ends kept.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "dateFormat": "yyyy-MM-dd",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_clean(bundle: dict[str, DataFrame], root: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Every clean table as ``<name>_clean.<fmt>``; one file per task, no collecting."""
    for name, df in bundle.items():
        columns = [field.name for field in clean_schema(name).fields]
        writer = df.select(*columns).write.mode(mode)
        path = f"{root}/{name}_clean.{fmt}"
        if fmt == "csv":
            writer.options(**CSV_OPTIONS).csv(path)
        else:
            writer.format(fmt).save(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv", single_file: bool = False) -> None:
    """An analysis result.  ``single_file`` is for results that are small by design."""
    out = df.coalesce(1) if single_file else df
    options = CSV_OPTIONS if fmt == "csv" else {}
    out.write.mode("overwrite").options(**options).format(fmt).save(path)


def write_profile(profile: dict[str, DataFrame], root: str) -> None:
    """The profile frames as JSON lines, one folder per frame."""
    for name, df in profile.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{root}/profile_{name}")


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
