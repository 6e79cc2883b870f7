"""Read-only gate for SQL text, as a column operator, and guarded execution."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_spark.functions.cleaning import strip

# Words that mark a statement as changing something.
BLOCKED_WORDS = (
    "insert",
    "update",
    "delete",
    "drop",
    "alter",
    "create",
    "replace",
    "truncate",
    "attach",
    "detach",
    "pragma",
    "vacuum",
)


# Calls that reach outside the tables, and paths read as tables.
OUTSIDE_CALLS = ("reflect", "try_reflect", "java_method")
FILES_AS_TABLES = "spark.sql.runSQLOnFiles"


def without_comments(statement: Column) -> Column:
    no_lines = F.regexp_replace(statement, r"--[^\n]*", "")
    return strip(F.regexp_replace(no_lines, r"(?s)/\*.*?\*/", ""))


def refusal(statement: Column) -> Column:
    """Why a statement is refused, or NULL if it may run.

    A statement must begin with SELECT, so ``WITH`` is refused; a blocked word is
    refused anywhere, even inside a string literal.  The leftmost one is named.
    """
    bare = F.lower(without_comments(statement))
    blocked = F.regexp_extract(bare, rf"\b({'|'.join(BLOCKED_WORDS)})\b", 1)
    outside = F.regexp_extract(bare, rf"\b({'|'.join(OUTSIDE_CALLS)})`?\s*\(", 1)
    return F.when(
        ~F.startswith(bare, F.lit("select")),
        F.concat(F.lit("not a SELECT: "), F.substring(bare, 1, 30)),
    ).when(blocked != "", F.concat(F.lit("blocked word: "), F.upper(blocked))).when(
        outside != "", F.concat(F.lit("blocked call: "), F.upper(outside))
    )


def audit(df: DataFrame, statement: str) -> DataFrame:
    """Adds ``is_safe`` and ``reason`` for a column of statements."""
    why = refusal(F.col(statement))
    return df.withColumn("is_safe", why.isNull()).withColumn(
        "reason", F.coalesce(why, F.lit("safe SELECT statement"))
    )


def read_query(spark: SparkSession, statement: str) -> tuple[DataFrame | None, str | None]:
    """(rows, None) for a read-only statement that analyses, else (None, error)."""
    why = spark.range(1).select(refusal(F.lit(statement)).alias("why")).first()["why"]
    if why is not None:
        return None, why
    before = spark.conf.get(FILES_AS_TABLES)
    spark.conf.set(FILES_AS_TABLES, "false")
    try:
        return spark.sql(statement), None
    except PySparkException as error:
        return None, str(error).splitlines()[0]
    finally:
        spark.conf.set(FILES_AS_TABLES, before)


def run_named(spark: SparkSession, statements: list[tuple[str, str]]) -> DataFrame:
    """Run a fixed list of (question, statement) and record how each went.

    Only the row count of each result comes back, so a record is one small row.
    """
    records = []
    for number, (question, statement) in enumerate(statements, 1):
        rows, error = read_query(spark, statement)
        count = 0
        if rows is not None:
            try:
                count = rows.count()
            except PySparkException as failure:
                error = str(failure).splitlines()[0]
        records.append((number, question, statement, error is None, count, error))
    return spark.createDataFrame(
        records,
        "question_number int, question string, statement string, success boolean, row_count bigint, error string",
    )
