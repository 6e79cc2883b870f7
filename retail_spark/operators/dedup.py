"""Duplicate removal and counting.

"First" always means first by a given order column, since rows of a DataFrame
have no order of their own.  Copies collapse on the map side, in an aggregation or
as a limit of one row per key: a key that holds a third of all rows sends one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Longer text is shuffled as its digest; equality is what matters.
LONG_TEXT = 64


def compact_key(name: str, kind: str):
    """A short stand-in for a grouping column."""
    if kind != "string":
        return F.col(name)
    c = F.col(name)
    return F.when(F.length(c) > LONG_TEXT, F.concat(F.lit("sha256:"), F.sha2(c, 256))).otherwise(c)


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of every key by ``order``; NULL keys form one group.

    A place of 1 lets every map task pass on one row per key.  Rows stay flat: an aggregate of whole rows
    would be sorted without compiled code and hold each row twice.  Of a key whose orders are all NULL only the key is known.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last()))
    first = df.withColumn("_place", place).where("_place = 1")
    return first.select(
        *[F.col(name) if name in keys else F.when(F.col(order).isNotNull(), F.col(name)).alias(name) for name in df.columns]
    )


def drop_exact(df: DataFrame, order: str) -> DataFrame:
    """One row per distinct content, keeping the smallest ``order``."""
    content = [name for name in df.columns if name != order]
    return df.groupBy(*content).agg(F.min(order).alias(order)).select(*df.columns)


def drop_exact_long_text(df: DataFrame, order: str, text: str) -> DataFrame:
    """As ``drop_exact``, for rows with one long text column.

    Groups on the digest of the text and keeps the text of the first row, so a
    document is shuffled at most once per map task that holds it.
    """
    content = [name for name in df.columns if name not in (order, text)]
    keyed = df.withColumn("_digest", F.sha2(text, 256))
    return (
        keyed.groupBy(*content, "_digest")
        .agg(F.min(order).alias(order), F.min(text).alias(text))
        .select(*df.columns)
    )


def copies(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Rows per distinct key: ``keys..., n``; ``out`` must not be one of the keys."""
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def surplus_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows a dedup on ``keys`` removes, as one row ``surplus``."""
    kinds = dict(df.dtypes)
    slim = df.select(*[compact_key(k, kinds[k]).alias(k) for k in keys])
    return copies(slim, keys, "_n").agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("surplus"))


def repeated_keys(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return copies(df, keys, out).where(F.col(out) > 1)


def first_per_each_key(df: DataFrame, keys: Sequence[str], order: str, stage) -> DataFrame:
    """Rows that survive inserting one by one while every key stays unique.

    Mostly nothing is repeated; that is found out on the key columns alone, and
    the rows are passed on without a shuffle.  With one key the rest is
    ``first_per_key``.  With several, a row that was itself refused blocks nobody:
    ``_inserted`` finds out on the key columns which rows get in.  ``order`` must differ from row to
    row.  ``stage`` writes an intermediate result and reads it back.
    """
    if not _any_repeated(df, keys):
        return df
    if len(keys) == 1:
        return first_per_key(df, keys, order)
    return df.join(_inserted(stage(df.select(order, *keys)), keys, order, stage), order, "left_semi").select(*df.columns)


def _inserted(rows: DataFrame, keys: Sequence[str], order: str, stage) -> DataFrame:
    """The ``order`` of the rows that a one-by-one insert accepts.

    A row is *free* if no undecided row before it shares a key with it: it is accepted.  A row with
    exactly one such row before it is accepted if and only if that one is refused, so chains of
    these rows follow from their first row: links are doubled until they point at it, which
    takes the logarithm of the longest chain, and the number of links followed tells the outcome.  What
    shares a key with an accepted row is refused; rows that had several before them are looked at again among
    what is left.
    """
    accepted = []
    while not rows.isEmpty():
        marked = rows
        for k in keys:
            marked = marked.join(_first_two(rows, k, order), k, "left")
        before, several = [], F.lit(False)
        for k in keys:
            first, second = F.col(f"_first_{k}"), F.col(f"_second_{k}")
            later = F.col(k).isNotNull() & (F.col(order) != first)
            before.append(F.when(later, first))
            several = several | (later & (F.col(order) != second))
        apart = reduce(lambda a, b: a | b, [(a != b) for a in before for b in before if a is not b])
        marked = stage(
            marked.select(
                order, *keys, F.coalesce(*before).alias("_before"), (several | F.coalesce(apart, F.lit(False))).alias("_open")
            )
        )
        free = marked.where("_before is null").select(order)
        links = marked.where("_before is not null and not _open").select(
            F.col(order).alias("_row"), F.col("_before").alias("_to"), F.lit(True).alias("_other")
        )
        links = _to_the_first(stage(links), stage)
        same = links.where("not _other").join(free.select(F.col(order).alias("_to")), "_to", "left_semi")
        won = stage(rows.join(free.unionByName(same.select(F.col("_row").alias(order))), order, "left_semi"))
        accepted.append(won.select(order))
        left = rows.join(won.select(order), order, "left_anti")
        for k in keys:
            left = left.join(won.select(k).where(F.col(k).isNotNull()), k, "left_anti")
        rows = stage(left.select(order, *keys))
    return reduce(DataFrame.unionByName, accepted)


def _first_two(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The smallest and second smallest order of every key."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(f"_first_{key}"))
    rest = rows.join(first, key).where(F.col(order) != F.col(f"_first_{key}"))
    return first.join(rest.groupBy(key).agg(F.min(order).alias(f"_second_{key}")), key, "left")


def _to_the_first(links: DataFrame, stage) -> DataFrame:
    """Links ``_row`` to ``_to`` followed to where no link goes on; ``_other`` tells whether their number is odd."""
    while True:
        on = links.select(F.col("_row").alias("_to"), F.col("_to").alias("_far"), F.col("_other").alias("_turn"))
        links = stage(
            links.join(on, "_to", "left").select(
                "_row",
                F.coalesce("_far", "_to").alias("_to"),
                (F.col("_other") != F.coalesce("_turn", F.lit(False))).alias("_other"),
                F.col("_far").isNotNull().alias("_moved"),
            )
        )
        if links.where("_moved").isEmpty():
            return links.drop("_moved")
        links = links.drop("_moved")


def _any_repeated(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a non-NULL key value occurs twice; NULL keys collide with nothing."""
    checks = [repeated_keys(df.where(F.col(k).isNotNull()), [k], "_n").select(F.lit(1)).limit(1) for k in keys]
    return not reduce(DataFrame.union, checks).isEmpty()
