"""Table and column profiles.

Every column is counted on its own, in its own type, so that only its values are read and
shuffled; repeated values collapse on the map side.  A table given as files of columns is read once that way.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_spark.functions.expressions import round_half_even
from retail_spark.operators.dedup import LONG_TEXT, compact_key, copies, repeated_keys
from retail_spark.sources.scratch import stage

# A text column with at most this many distinct values is listed value by value.
LISTED_VALUES = 20


#: Types whose values are told apart as they are just as by their text.
PLAIN_KINDS = ("bigint", "int", "smallint", "tinyint", "boolean", "date")


def profile_table(df: DataFrame, name: str) -> DataFrame:
    """Rows, columns and exact duplicate rows of one table.

    A hash of each row is counted first; only rows whose hash occurs again are compared whole, so a
    table with few copies shuffles a number per row.
    """
    kinds = dict(df.dtypes)
    slim = df.select(*[compact_key(c, kinds[c]).alias(c) for c in df.columns])
    marked = slim.withColumn("_hash", F.xxhash64(*slim.columns))
    again = stage(repeated_keys(marked, ["_hash"]).select("_hash"), "again")
    surplus = copies(marked.join(again, "_hash", "left_semi"), df.columns, "_n").agg(F.sum(F.col("_n") - 1).alias("_surplus"))
    # Two rows of totals, one beside the other.
    return df.agg(F.count("*").alias("_rows")).crossJoin(surplus).select(
        F.lit(name).alias("table_name"),
        F.col("_rows").alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.coalesce("_surplus", F.lit(0)).alias("duplicate_rows"),
    )


def value_counts_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, value, n)`` over the given columns; long text by digest."""
    kinds = dict(df.dtypes)
    texts = [
        F.struct(
            F.lit(c).alias("column_name"),
            compact_key(c, kinds[c]).cast("string").alias("value"),
        )
        for c in columns
    ]
    long = df.select(F.inline(F.array(*texts)))
    return copies(long, ["column_name", "value"])


def null_counts(df: DataFrame, name: str) -> DataFrame:
    """NULLs per column, all in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in df.columns]
    return counted.select(F.inline(F.array(*rows)))


def profile_columns(df: DataFrame, name: str) -> DataFrame:
    """Per column: type, nulls, null share and distinct values (NULL counts as one)."""
    return _union(_profile_column(df, name, c, kind) for c, kind in df.dtypes)


def _profile_column(df: DataFrame, name: str, column: str, kind: str) -> DataFrame:
    value = compact_key(column, kind)
    if kind not in PLAIN_KINDS and not kind.startswith("decimal"):
        value = value.cast("string")
    counts = copies(df.select(value.alias("value")), ["value"]).agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
        F.count("*").alias("unique_count"),
    )
    return counts.where("row_count is not null").select(
        F.lit(name).alias("table_name"),
        F.lit(column).alias("column_name"),
        F.lit(kind).alias("data_type"),
        "null_count",
        round_half_even(F.col("null_count") / F.col("row_count") * 100, 2).alias("null_pct"),
        "unique_count",
    )


def approx_profile_columns(df: DataFrame, name: str, error: float = 0.02) -> DataFrame:
    """``profile_columns`` with sketched distinct counts, in one pass without a shuffle of values."""
    stats = [
        F.struct(
            F.lit(name).alias("table_name"),
            F.lit(c).alias("column_name"),
            F.lit(kind).alias("data_type"),
            F.count_if(F.col(c).isNull()).alias("null_count"),
            round_half_even(F.count_if(F.col(c).isNull()) / F.count("*") * 100, 2).alias("null_pct"),
            (F.approx_count_distinct(c, error) + F.max(F.col(c).isNull().cast("int"))).alias("unique_count"),
        )
        for c, kind in df.dtypes
    ]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def profile_values(df: DataFrame, name: str, limit: int = LISTED_VALUES) -> DataFrame:
    """Every value of each text column that has few of them, with its share.

    A first pass sketches how many values each column has, and how long they are: its shuffle does not
    depend on the data.  Only columns that may have few values are counted, so no value of any other is shuffled.
    """
    names = [c for c, kind in df.dtypes if kind == "string"]
    sketches = [f(c).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("n", _about), ("size", _longest))]
    seen = df.agg(F.lit(1), *sketches).first()
    # A sketch of so few values is right but for a value or two.
    few = [c for i, c in enumerate(names) if seen[f"n{i}"] <= 2 * limit]
    if not few:
        kinds = "table_name string, column_name string, value string, value_count bigint, value_pct double"
        return df.sparkSession.createDataFrame([], kinds)
    long = stage(value_counts_long(df, few), "values")
    listed = (
        long.groupBy("column_name")
        .agg(F.sum("n").alias("row_count"), F.count("*").alias("distinct_values"))
        .where(F.col("distinct_values") <= limit)
    )
    # At most one row per column of the table, so it may be broadcast.
    listed = long.join(F.broadcast(listed), "column_name").withColumn("full_text", F.lit(None).cast("string"))
    if texts := [c for i, c in enumerate(names) if c in few and (seen[f"size{i}"] or 0) > LONG_TEXT]:
        listed = _with_full_text(df, listed.drop("full_text"), texts)
    return listed.select(
        F.lit(name).alias("table_name"),
        "column_name",
        F.coalesce("full_text", "value").alias("value"),
        F.col("n").alias("value_count"),
        round_half_even(F.col("n") / F.col("row_count") * 100, 1).alias("value_pct"),
    )


def _about(column: str) -> Column:
    return F.approx_count_distinct(column, 0.02)


def _longest(column: str) -> Column:
    return F.max(F.length(column))


def _with_full_text(df: DataFrame, listed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Digests stood for long text in the shuffle: put back the text of those listed, at most a few a column."""
    texts = [
        F.struct(F.lit(c).alias("column_name"), compact_key(c, "string").alias("value"), F.col(c).alias("full_text"))
        for c in columns
    ]
    digests = listed.where(F.startswith("value", F.lit("sha256:"))).select("column_name", "value")
    full = (
        df.select(F.inline(F.array(*texts)))
        .where(F.col("full_text") != F.col("value"))
        .join(F.broadcast(digests), ["column_name", "value"])
        .groupBy("column_name", "value")
        .agg(F.min("full_text").alias("full_text"))
    )
    return listed.join(full, ["column_name", "value"], "left")


def profile_all(tables: dict[str, DataFrame], frames: Sequence[str] = ("tables", "columns", "values")) -> dict[str, DataFrame]:
    """Profile frames over a labelled bundle: ``tables``, ``columns``, ``values``."""
    makers = {"tables": profile_table, "columns": profile_columns, "values": profile_values}
    return {frame: _union(makers[frame](df, name) for name, df in tables.items()) for frame in frames}


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
