"""Foreign-key membership: keep, drop, count and list orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _key_set(dim: DataFrame, fk: str, key: str) -> DataFrame:
    return dim.select(F.col(key).alias(fk))


def keep_members(fact: DataFrame, dim: DataFrame, fk: str, key: str | None = None) -> DataFrame:
    """Rows whose ``fk`` exists in the dimension.

    No broadcast hint: the planner takes the small side if its size allows, and
    adaptive execution splits a hot key on the fact side otherwise.
    """
    return fact.join(_key_set(dim, fk, key or fk), fk, "left_semi")


def orphans(fact: DataFrame, dim: DataFrame, fk: str, key: str | None = None) -> DataFrame:
    """Rows whose ``fk`` is set but unknown."""
    return fact.where(F.col(fk).isNotNull()).join(_key_set(dim, fk, key or fk), fk, "left_anti")


def orphan_keys(fact: DataFrame, dim: DataFrame, fk: str, key: str | None = None) -> DataFrame:
    """Unknown keys with their number of rows.

    Counts first and joins the counts, so the join sees each key once.
    """
    counted = fact.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count("*").alias("n"))
    return counted.join(_key_set(dim, fk, key or fk), fk, "left_anti")


def orphan_count(fact: DataFrame, dim: DataFrame, fk: str, key: str | None = None) -> DataFrame:
    """Number of orphan rows, as one row ``orphans``."""
    listed = orphan_keys(fact, dim, fk, key)
    return listed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))


def split_positive(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): rows with a positive value, and all others."""
    positive = F.coalesce(F.col(column) > 0, F.lit(False))
    return df.where(positive), df.where(~positive)


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def unexpected_values(df: DataFrame, column: str, allowed) -> DataFrame:
    """Distinct values outside the allowed set, NULL included."""
    outside = ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return df.where(outside).select(column).distinct()
