"""Ranks and quantiles that stay distributed.

A window over a whole category, or a percentile over a whole table, would pull an
unbounded group into one task.  Here equal values are counted first, and the distinct ones are
dealt to range partitions at sampled splitters, whatever group they belong to.  Of every
group and partition only the total goes on: totals are added up from partition to partition, and exact
work happens inside one partition's part of a group, which shrinks as partitions grow in number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.sources.scratch import stage


def _preceding(by: Sequence[str], order: Column):
    window = Window.partitionBy(*by).orderBy(order)
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _sum_over(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def _present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _placed(df: DataFrame, by: Sequence[str], value: str, weight: Column) -> DataFrame:
    """``by..., value, _n, _part`` per distinct value; parts of a group ascend with the value.

    NULL and NaN values and NULL groups are left out.  Written, so that a value keeps its part.
    """
    numbers = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).isNotNull()
    counted = df.where(_present([*by, value]) & numbers).groupBy(*by, value).agg(weight.alias("_n"))
    return stage(counted.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "ranges")


def _ranked_values(df: DataFrame, by: Sequence[str], value: str, dense: bool) -> DataFrame:
    """``by..., value, _rank`` in descending order of the value."""
    values = _placed(df, by, value, F.lit(1).cast("bigint") if dense else F.count("*"))
    parts = values.groupBy(*by, "_part").agg(F.sum("_n").alias("_part_n"))
    above = parts.select(*by, "_part", _sum_over("_part_n", _preceding(by, F.col("_part").desc())).alias("_above"))
    ahead = _sum_over("_n", _preceding([*by, "_part"], F.col(value).desc()))
    return (
        values.withColumn("_ahead", ahead)
        .join(above, [*by, "_part"])
        .select(*by, value, (F.col("_above") + F.col("_ahead") + 1).alias("_rank"))
    )


def rank_descending(df: DataFrame, value: str, out: str, by: Sequence[str] = (), dense: bool = False) -> DataFrame:
    """RANK (or DENSE_RANK) by descending value within ``by``; ties share the best rank.

    ``df`` is read twice; pass a staged frame when it is costly.

    A row without a value (NULL or NaN) or without a group gets no rank.
    """
    ranks = _ranked_values(df, by, value, dense).withColumnRenamed("_rank", out)
    return df.join(ranks, [*by, value], "left").select(*df.columns, out)


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles with linear interpolation: ``by..., probability, quantile``.

    NULL and NaN values are skipped, and so is a NULL group.  The input is read once.
    """
    values = _placed(df, by, value, F.count("*"))
    parts = values.groupBy(*by, "_part").agg(F.sum("_n").alias("_part_n"))
    placed = parts.select(
        *by,
        "_part",
        "_part_n",
        _sum_over("_part_n", _preceding(by, F.col("_part"))).alias("_start"),
        F.sum("_part_n").over(Window.partitionBy(*by)).alias("_total"),
    )
    # Each quantile needs the values at two neighbouring zero-based positions.
    slots = []
    for p in probabilities:
        exact = (F.col("_total") - 1) * F.lit(float(p))
        low = F.floor(exact)
        for side, position in (("low", low), ("high", F.ceil(exact))):
            slots.append(
                F.struct(
                    F.lit(float(p)).alias("probability"),
                    F.lit(side).alias("_side"),
                    position.alias("_position"),
                    (exact - low).alias("_fraction"),
                )
            )
    wanted = (
        placed.select(*by, "_part", "_part_n", "_start", F.inline(F.array(*slots)))
        .where((F.col("_position") >= F.col("_start")) & (F.col("_position") < F.col("_start") + F.col("_part_n")))
        .drop("_part_n")
    )
    # Two rows per probability and group.  Written out, its true size decides on the
    # join; without groups it is small by design.
    wanted = stage(wanted, "quantiles") if by else wanted
    hit = wanted.select(*by, "_part", "_start").distinct()
    if not by:
        hit, wanted = F.broadcast(hit), F.broadcast(wanted)
    located = (
        values.join(hit, [*by, "_part"])
        .withColumn("_from", F.col("_start") + _sum_over("_n", _preceding([*by, "_part"], F.col(value))))
        .withColumn("_to", F.col("_from") + F.col("_n"))
    )
    found = located.join(wanted.drop("_start"), [*by, "_part"]).where(
        (F.col("_position") >= F.col("_from")) & (F.col("_position") < F.col("_to"))
    )

    def side(name):
        return F.max(F.when(F.col("_side") == name, F.col(value).cast("double")))

    low, high = side("low"), side("high")
    return found.groupBy(*by, "probability").agg(
        (low + (high - low) * F.max("_fraction")).alias("quantile")
    )


def quantile_columns(df: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``exact_quantiles`` with one named column per probability."""
    long = exact_quantiles(df, value, list(probabilities.values()), by)
    return long.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("probability") == float(p), F.col("quantile"))).alias(name)
            for name, p in probabilities.items()
        ]
    )
