"""Top-k, paging and previews.  Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREVIEW_ROWS = 20
LOG_ENTRIES = 1000
MAX_PAGE = 100


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The ``k`` largest; planned as a per-task heap, not a global sort."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie)).limit(k)


def page_newest_first(df: DataFrame, key: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """One page of a log, newest first.  For deep pages use ``page_before``."""
    _check_page(limit, offset)
    return df.orderBy(F.col(key).desc()).offset(offset).limit(limit)


def page_before(df: DataFrame, key: str, last_seen: int, limit: int = 10) -> DataFrame:
    """The page behind ``last_seen``: its cost does not grow with the depth."""
    _check_page(limit, 0)
    return df.where(F.col(key) < last_seen).orderBy(F.col(key).desc()).limit(limit)


def _check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be within 1..{MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def retain_newest(df: DataFrame, key: str, n: int = LOG_ENTRIES) -> DataFrame:
    return df.orderBy(F.col(key).desc()).limit(n)


def preview_lines(df: DataFrame, order: list[Column], rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows as padded text: a header, a rule, then one line per row."""
    names = df.columns
    head = df.orderBy(*order).limit(rows)
    numbered = head.select(
        F.row_number().over(Window.orderBy(*order)).alias("_no"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in names],
    )
    everything = Window.partitionBy(F.lit(0))
    widths = {c: F.greatest(F.max(F.length(c)).over(everything), F.lit(len(c))) for c in names}

    def line(cells, glue):
        return F.concat_ws(glue, *cells)

    padded = numbered.select(
        (F.col("_no") + 1).alias("line_no"),
        line([F.rpad(F.col(c), widths[c], " ") for c in names], " | ").alias("line"),
        line([F.rpad(F.lit(c), widths[c], " ") for c in names], " | ").alias("_header"),
        line([F.repeat(F.lit("-"), widths[c]) for c in names], "-+-").alias("_rule"),
    )
    headed = padded.where("line_no = 2").select(
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("line_no"), F.col("_header").alias("line")),
                F.struct(F.lit(1).alias("line_no"), F.col("_rule").alias("line")),
            )
        )
    )
    return headed.unionByName(padded.select("line_no", "line"))
