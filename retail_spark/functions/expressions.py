"""Scalar expressions shared by the analyses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def shift_months(d: Column, months: int) -> Column:
    """Move by months; a day past the end of the month runs over into the next.

    So 31 December less six months is 1 July, where ``add_months`` alone would
    stop at 30 June.
    """
    return F.date_add(F.add_months(F.trunc(d, "MM"), months), F.dayofmonth(d) - 1)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def bin_right_closed(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(edges[i], edges[i+1]]``; NULL outside all of them."""
    label = F.when(c <= edges[0], F.lit(None).cast("string"))
    for upper, text in zip(edges[1:], labels, strict=True):
        label = label.when(c <= upper, F.lit(text))
    return label


def ordinal(c: Column, labels: Sequence[str]) -> Column:
    """Position of a label, to sort by it."""
    return F.array_position(F.array(*[F.lit(label) for label in labels]), c)


def tier_by_edges(c: Column, edges: Sequence[Column], labels: Sequence[str]) -> Column:
    """Right-closed tiers between run-time edges; the lowest value is included."""
    tier = F
    for edge, text in zip(edges, labels[:-1], strict=True):
        tier = tier.when(c <= edge, F.lit(text))
    return tier.when(c.isNotNull(), F.lit(labels[-1]))


def round_half_away(c: Column, places: int = 2) -> Column:
    """SQL ROUND.  Decimal, so that 0.125 is a tie on every engine."""
    return F.round(c.cast("decimal(38,6)"), places).cast("double")


def round_half_even(c: Column, places: int = 2) -> Column:
    """Data-frame rounding: ties go to the even neighbour."""
    scale = float(10**places)
    return F.rint(c.cast("double") * scale) / scale


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Division in doubles; NULL instead of an error on zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def growth_pct(current: Column, previous: Column) -> Column:
    return safe_divide(current - previous, previous) * 100


def mean_of(total: Column, count: Column) -> Column:
    """Mean from an exact sum, so it does not depend on the order of addition."""
    return safe_divide(total, count)


def full_name(first: Column, last: Column) -> Column:
    """NULL when either part is."""
    return F.concat(first, F.lit(" "), last)


def flag(condition: Column) -> Column:
    return condition.cast("int")


def stock_flag(stock: Column, ratio: Column) -> Column:
    """Stock turnover label.  The bounds 5 and 0.5 are fixed values."""
    return (
        F.when(stock == 0, F.lit("Out of Stock"))
        .when(ratio > 5, F.lit("Fast Moving"))
        .when(ratio < 0.5, F.lit("Slow Moving"))
        .otherwise(F.lit("Healthy"))
    )


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, to two places."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return round_half_away(micros / 1000)
