"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its share of all tokens, raised to an exponent and normalised.  The
exponent is 1 if the natural mix is even enough, and else the largest one between 0 and 1 that reaches the
target entropy (as a part of the entropy of equal weights), but never so small
that a source would be repeated more often than the limit.  It is found by bisection;
one aggregation over the table of sources answers five steps at a time, so neither sources nor
documents are gathered.

A source's budget is its weight times the token budget.  It is filled with whole passes
over the source and a part of one more.  In every pass the blocks of a source (hash
buckets of about ``BLOCK_ROWS`` documents) come in another order, and so do the documents of a
block.  The part ends inside one block, at the last document that still fits.  Running
sums are over bands of about ``BAND_BLOCKS`` blocks, over the blocks of a band, and over documents inside that
one last block alone: a source with a third of all rows is many bands, and no task sees all of its blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.llm.common import n_words
from retail_spark.sources.scratch import stage

TARGET_ENTROPY = 0.98
MOST_REPEATS = 4.0
BLOCK_ROWS = 1024
BAND_BLOCKS = 1024
STEPS_AT_ONCE = 5
ROUNDS = 6


def _source_key(column: str) -> Column:
    """Tells a missing source from an empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _mix_figures(sources: DataFrame, exponents: list[float], total: float, budget: float) -> list[tuple[float, float]]:
    """Entropy of the weights and most repeats of a source, for every exponent."""
    share = F.col("__mix_tokens") / F.lit(total)
    sums = []
    for k, a in enumerate(exponents):
        power = F.pow(share, F.lit(a))
        sums += [F.sum(power).alias(f"z{k}"), F.sum(power * F.log(share)).alias(f"l{k}"), F.max(power / share).alias(f"r{k}")]
    row = sources.agg(*sums).first()
    return [
        (math.log(row[f"z{k}"]) - a * row[f"l{k}"] / row[f"z{k}"], row[f"r{k}"] / row[f"z{k}"] * budget / total)
        for k, a in enumerate(exponents)
    ]


def find_exponent(sources: DataFrame, budget: float, target_entropy: float, most_repeats: float) -> float:
    """The exponent for a table of sources (``__mix_tokens``, all above 0)."""
    total, n = sources.agg(F.sum("__mix_tokens"), F.count("*")).first()
    if not n or n == 1:
        return 1.0
    total, wanted = float(total), target_entropy * math.log(n)

    def even_enough(figures: tuple[float, float]) -> bool:
        entropy, repeats = figures
        return entropy >= wanted or repeats > most_repeats

    low, high = 0.0, 1.0
    if even_enough(_mix_figures(sources, [1.0], total, budget)[0]):
        return 1.0
    for _ in range(ROUNDS):
        parts = 1 << STEPS_AT_ONCE
        inner = [low + (high - low) * k / parts for k in range(1, parts)]
        answers = [even_enough(f) for f in _mix_figures(sources, inner, total, budget)]
        # Even enough below some exponent, not above: five halvings, all answered already.
        a, b = 0, parts
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (middle, b) if answers[middle - 1] else (a, middle)
        low, high = low + (high - low) * a / parts, low + (high - low) * b / parts
    # At the limit of repeats the near side of the last interval is the one that keeps it.
    limited = _mix_figures(sources, [low], total, budget)[0][1] > most_repeats
    return math.ceil(high * 1e8) / 1e8 if limited else math.floor(low * 1e8) / 1e8


def _running(passes: DataFrame) -> DataFrame:
    """Adds ``__mix_before``, the tokens of the blocks that come before one in its source's order of a pass.

    ``passes`` has a row per source, pass and block, with the block's place ``__mix_turn`` among the 64-bit numbers.
    Bands are stretches of these, so their order is that of the blocks in them.
    """
    bands = F.ceil(F.col("__mix_blocks") / F.lit(BAND_BLOCKS))
    banded = passes.withColumn("__mix_band", F.floor((F.col("__mix_turn") / F.lit(2.0**64) + F.lit(0.5)) * bands))
    of_pass = ["__mix_source", "mix_epoch"]
    start = Window.partitionBy(*of_pass).orderBy("__mix_band").rowsBetween(Window.unboundedPreceding, -1)
    totals = banded.groupBy(*of_pass, "__mix_band").agg(F.sum("__mix_in_block").alias("__mix_in_band"))
    starts = totals.select(*of_pass, "__mix_band", F.coalesce(F.sum("__mix_in_band").over(start), F.lit(0)).alias("__mix_band_start"))
    inside = Window.partitionBy(*of_pass, "__mix_band").orderBy("__mix_turn", "__mix_block").rowsBetween(Window.unboundedPreceding, -1)
    summed = banded.withColumn("__mix_inside", F.coalesce(F.sum("__mix_in_block").over(inside), F.lit(0)))
    joined = summed.join(starts, [*of_pass, "__mix_band"])
    return joined.withColumn("__mix_before", F.col("__mix_band_start") + F.col("__mix_inside"))


def mix_sources(
    documents: DataFrame,
    budget_tokens: int | None = None,
    target_entropy: float = TARGET_ENTROPY,
    most_repeats: float = MOST_REPEATS,
    seed: int = 17,
) -> DataFrame:
    """The rows of ``documents`` (doc_id, text, source, any others) as often as the mix has them.

    Adds ``mix_epoch`` (from 0), ``mix_tokens`` (the row's words) and ``mix_position`` (0 to 1, even
    per source: sorted by it, every stretch has the target weights); columns of these names that came in give way.  The budget is the
    number of tokens there are unless given.  A NULL source is a source of its own.  A
    NULL or empty text has no tokens and goes along with every pass that reaches its
    place; a source of such texts alone is passed once.  Rows that repeat are separate rows, and equal
    ones come and go together.  An empty table gives no rows.
    """
    own = [c for c in documents.columns if c not in ("mix_epoch", "mix_tokens", "mix_position")]
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit(seed))
    marked = documents.select(
        *own,
        _source_key("source").alias("__mix_source"),
        n_words(F.col("text").cast("string")).alias("mix_tokens"),
        key.alias("__mix_key"),
    )
    slim = stage(marked.select("__mix_source", "mix_tokens", "__mix_key"), "tokens")
    sources = stage(
        slim.groupBy("__mix_source").agg(F.sum("mix_tokens").alias("__mix_tokens"), F.count("*").alias("__mix_rows")), "sources"
    )
    full = sources.where("__mix_tokens > 0")
    total = full.agg(F.sum("__mix_tokens")).first()[0] or 0
    budget = float(total if budget_tokens is None else budget_tokens)
    exponent = find_exponent(full, budget, target_entropy, most_repeats)
    share = F.col("__mix_tokens") / F.lit(float(total or 1))
    power = F.when(F.col("__mix_tokens") > 0, F.pow(share, F.lit(exponent)))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    # Rounded, so that the order in which shares were added cannot move a budget.
    target = F.floor(F.round(power / F.lit(z) * F.lit(budget), 3)).cast("long")
    plan = sources.select(
        "__mix_source",
        "__mix_tokens",
        F.ceil(F.col("__mix_rows") / BLOCK_ROWS).cast("long").alias("__mix_blocks"),
        F.coalesce(target, F.lit(0)).alias("__mix_target"),
    ).withColumn(
        "__mix_passes", F.when(F.col("__mix_tokens") > 0, F.floor(F.col("__mix_target") / F.col("__mix_tokens"))).otherwise(1)
    )
    plan = plan.withColumn("__mix_part", F.col("__mix_target") - F.col("__mix_passes") * F.col("__mix_tokens"))
    plan = stage(plan, "plan")

    def blocked(rows: DataFrame) -> DataFrame:
        size = plan.select("__mix_source", "__mix_blocks")
        return rows.join(size, "__mix_source").withColumn("__mix_block", F.pmod("__mix_key", "__mix_blocks"))

    blocks = stage(
        blocked(slim).groupBy("__mix_source", "__mix_block").agg(F.sum("mix_tokens").alias("__mix_in_block")), "blocks"
    )
    passes = blocks.join(plan, "__mix_source").withColumn(
        "mix_epoch", F.explode(F.expr("sequence(0L, __mix_passes - if(__mix_part > 0, 0L, 1L))"))
    )
    passes = passes.where("mix_epoch < __mix_passes or __mix_part > 0")
    turn = F.xxhash64("__mix_source", "__mix_block", "mix_epoch", F.lit(seed))
    passes = _running(stage(passes.withColumn("__mix_turn", turn), "turns"))
    last = F.col("mix_epoch") == F.col("__mix_passes")
    room = F.col("__mix_part") - F.col("__mix_before")
    passes = passes.withColumn("__mix_room", F.when(last, room)).where("__mix_room is null or __mix_room > 0")
    passes = stage(passes, "passes")
    # The one block of a source that the part ends in: its documents in their order of that pass.
    order = F.xxhash64("__mix_key", "mix_epoch")
    ends_in = passes.where("__mix_room < __mix_in_block").select("__mix_source", "__mix_block", "mix_epoch", "__mix_room")
    inside = blocked(slim).join(ends_in, ["__mix_source", "__mix_block"]).withColumn("__mix_order", order)
    upto = Window.partitionBy("__mix_source", "__mix_block").orderBy("__mix_order").rangeBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("__mix_upto", F.sum("mix_tokens").over(upto)).where("__mix_upto <= __mix_room")
    last_fit = inside.groupBy("__mix_source", "__mix_block", "mix_epoch").agg(F.max("__mix_order").alias("__mix_last"))
    schedule = (
        passes.join(last_fit, ["__mix_source", "__mix_block", "mix_epoch"], "left")
        .where("__mix_room is null or __mix_room >= __mix_in_block or __mix_last is not null")
        .select(
            "__mix_source", "__mix_block", "mix_epoch", "__mix_last", "__mix_in_block",
            (F.col("mix_epoch") * F.col("__mix_tokens") + F.col("__mix_before")).alias("__mix_start"),
            "__mix_target",
        )
    )
    schedule = stage(schedule, "schedule")
    mixed = blocked(marked).join(schedule, ["__mix_source", "__mix_block"]).withColumn("__mix_order", order)
    mixed = mixed.where("__mix_last is null or __mix_order <= __mix_last")
    inner = (F.col("__mix_order") / F.lit(2.0**64) + F.lit(0.5)) * F.col("__mix_in_block")
    position = F.coalesce(F.try_divide(F.col("__mix_start") + inner, F.greatest("__mix_target", F.lit(1)).cast("double")), F.lit(0.0))
    return mixed.select(*own, "mix_epoch", "mix_tokens", F.least(position, F.lit(1.0)).alias("mix_position"))
