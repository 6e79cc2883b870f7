"""Quality rules whose limits follow the data: quantile sketches per language and source.

Every document is measured once.  Measures of the documents that pass the base rules go
into one sketch per language, source and measure: a table of counts per value bucket,
where a bucket keeps the six leading bits of a value, so any quantile is right within
1/32 of its value.  Such sketches merge by adding counts, in any order and with the same
result, so a source with a third of all rows is counted on the map side like any other.

The limits of a measure are ``FENCE`` spreads outside its quartiles; the spread is the
distance of the quartiles, or the measure's least spread where that is larger.  The limits of a source
in a language are drawn towards those of the whole language (the merged sketch), and these towards those of the whole
table, as if the larger group had added ``PRIOR_ROWS`` documents: few documents decide little, many decide all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.llm.common import WORD, map_texts
from retail_spark.sources.scratch import stage

LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"
FENCE = 3
PRIOR_ROWS = 200
#: Measures as whole numbers, with their least spread: symbols per 10,000 characters of words,
#: repeated lines and repeated words per 1,000, length of words in hundredths.
LEAST_SPREAD = {"symbol_rate": 50, "dup_line_rate": 150, "repeat_rate": 100, "word_length": 50}
#: Measures that may also be too low.
TWO_SIDED = ("word_length",)

_WORD = re.compile(WORD)
_BLANKS = " \t\n\x0b\x0c\r"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[str]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    word = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    _, pair = np.unique(word[:-1] * len(number) + word[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * len(number) + word[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The counts that the rules use, in the order of ``_COUNTS``."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _count(texts: Iterator[list[str | None]]) -> Iterator[list[pa.Array]]:
    for batch in texts:
        counts = np.array([counts_of(t) for t in batch], np.int64).reshape(-1, len(_COUNTS))
        yield [pa.array(c) for c in counts.T]


def _rate(part: Column, whole: Column, scale: int) -> Column:
    return F.coalesce(F.floor(F.try_divide(part * scale, whole)), F.lit(0)).cast("long")


def measured(documents: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts, measures and the base verdict per row of ``documents`` (lang, source, text), behind ``keep``, lang and source."""
    kinds = {"doc_id": "long", "lang": "string", "source": "string", "text": "string"}
    names = list(dict.fromkeys((*keep, "lang", "source")))
    docs = documents.select(
        *[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in dict.fromkeys((*names, "text"))]
    )
    counted = map_texts(docs, names, _count, [f"{c} long" for c in _COUNTS])
    return counted.select(
        *names,
        *_COUNTS,
        _rate(F.col("n_symbols"), F.col("word_chars"), 10_000).alias("symbol_rate"),
        _rate(F.col("n_dup_lines"), F.col("n_lines"), 1_000).alias("dup_line_rate"),
        _rate(F.col("n_repeat_words"), F.col("n_words"), 1_000).alias("repeat_rate"),
        _rate(F.col("word_chars"), F.col("n_words"), 100).alias("word_length"),
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def value_sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per bucket of every measure: ``*keys, measure, bucket, times``."""
    value = F.explode(F.create_map(*[x for m in LEAST_SPREAD for x in (F.lit(m), F.col(m))])).alias("measure", "value")
    drop = F.expr("cast(pow(2, greatest(0, length(bin(value)) - 6)) as bigint)")
    return (
        rows.select(*keys, value)
        .select(*keys, "measure", (F.col("value") - F.col("value") % drop).alias("bucket"))
        .groupBy(*keys, "measure", "bucket")
        .agg(F.count("*").alias("times"))
    )


def limits(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, the number of rows and a low and a high limit of every measure, from its quartiles.

    A sketch has at most some hundred buckets per key and measure, whatever its rows.
    """
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("times").alias("times"))
    by = Window.partitionBy(*keys, "measure")
    below = merged.withColumn("upto", F.sum("times").over(by.orderBy("bucket"))).withColumn("total", F.sum("times").over(by))
    quartiles = below.groupBy(*keys, "measure").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bucket"))).alias("q3"),
        F.max("total").alias("total"),
    )
    least = F.create_map(*[x for m, v in LEAST_SPREAD.items() for x in (F.lit(m), F.lit(v))])
    spread = FENCE * F.greatest(F.col("q3") - F.col("q1"), least[F.col("measure")].cast("long"))

    def of(measure: str, c: Column) -> Column:
        return F.max(F.when(F.col("measure") == measure, c))

    return quartiles.groupBy(*keys).agg(
        F.max("total").alias("rows"),
        *[of(m, F.col("q3") + spread).alias(f"{m}_high") for m in LEAST_SPREAD],
        *[of(m, F.greatest(F.col("q1") - spread, F.lit(0))).alias(f"{m}_low") for m in TWO_SIDED],
    )


def _named(frame: DataFrame, keys: list[str], prefix: str, names: list[str]) -> DataFrame:
    return frame.select(*[F.col(n).alias(f"{prefix}_{n}") for n in (*keys, "rows", *names)])


def _drawn(prefix: str, name: str, towards: Column) -> Column:
    """A group's limit drawn towards that of a larger group, rounded down; no limit is below 0."""
    rows = F.col(f"{prefix}_rows")
    total = rows * F.col(f"{prefix}_{name}") + PRIOR_ROWS * towards
    return F.coalesce(F.call_function("div", total, rows + PRIOR_ROWS), towards)


def quality_rules(documents: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts, limits and verdict per row of ``documents`` (doc_id, text, lang, source), behind the columns ``keep``.

    ``kept`` is false where ``base_failed`` (fewer than 50 words, or more than half of
    them in repeated windows) and where a measure lies outside the limits of the row's
    language and source.  A NULL text is an empty one and fails.  A NULL language or
    source is a group of its own.  Equal rows get equal verdicts, also if they repeat.  Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = stage(measured(documents, keep), "measures")
    sketch = stage(value_sketch(rows.where("not base_failed"), ["lang", "source"]), "quantiles")
    names = [f"{m}_high" for m in LEAST_SPREAD] + [f"{m}_low" for m in TWO_SIDED]
    both, lang = ["lang", "source"], ["lang"]
    own = _named(limits(sketch, both), both, "own", names)
    spoken = _named(limits(sketch, lang), lang, "lang", names)
    every = _named(limits(sketch.withColumn("all", F.lit(1)), ["all"]), ["all"], "every", names)
    groups = rows.groupBy(*both).agg(F.lit(1).alias("one"))
    found = (
        groups.join(own, groups["lang"].eqNullSafe(F.col("own_lang")) & groups["source"].eqNullSafe(F.col("own_source")), "left")
        .join(spoken, groups["lang"].eqNullSafe(F.col("lang_lang")), "left")
        .join(every, F.col("one") == F.col("every_all"), "left")
        .select(
            groups["lang"].alias("of_lang"),
            groups["source"].alias("of_source"),
            *[_drawn("own", n, _drawn("lang", n, F.col(f"every_{n}"))).alias(n) for n in names],
        )
    )
    found = stage(found, "limits")
    inside = F.lit(True)
    for m in LEAST_SPREAD:
        inside &= F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True))
    for m in TWO_SIDED:
        inside &= F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True))
    same = rows["lang"].eqNullSafe(F.col("of_lang")) & rows["source"].eqNullSafe(F.col("of_source"))
    return rows.join(found, same, "left").select(
        *[rows[c] for c in keep],
        *[c for c in _COUNTS if c != "n_lines"],
        "base_failed",
        (~F.col("base_failed") & inside).alias("kept"),
        *LEAST_SPREAD,
        *names,
    )


ORACLE_SQL = r"""
WITH words AS (
  SELECT rowid AS r, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
triples AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times
  FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words))),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM triples WHERE times > 1) GROUP BY r),
lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counted AS (
  SELECT r, doc_id, lang, source, len(w) AS n_words,
         coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lines.n, 0) AS n_lines, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM words LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         coalesce(n_symbols * 10000 // nullif(word_chars, 0), 0) AS symbol_rate,
         coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) AS dup_line_rate,
         coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS repeat_rate,
         coalesce(word_chars * 100 // nullif(n_words, 0), 0) AS word_length FROM counted),
long AS (
  SELECT lang, source, unnest([{'m': 'symbol_rate', 'v': symbol_rate, 's': 50}, {'m': 'dup_line_rate', 'v': dup_line_rate, 's': 150},
         {'m': 'repeat_rate', 'v': repeat_rate, 's': 100}, {'m': 'word_length', 'v': word_length, 's': 50}], recursive := true)
  FROM measured WHERE NOT base_failed),
bucketed AS (
  SELECT lv, CASE WHEN lv < 3 THEN lang END AS lang, CASE WHEN lv < 2 THEN source END AS source, m, s,
         CASE WHEN v < 64 THEN v ELSE v - v % (1::BIGINT << (length(bin(v)) - 6)::BIGINT) END AS b
  FROM long, (SELECT unnest([1, 2, 3]) AS lv)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lv, lang, source, m ORDER BY b) AS rk, count(*) OVER (PARTITION BY lv, lang, source, m) AS total FROM bucketed),
quart AS (
  SELECT lv, lang, source, m, max(s) AS s, max(total) AS total,
         min(b) FILTER (WHERE 4 * rk >= total) AS q1, min(b) FILTER (WHERE 4 * rk >= 3 * total) AS q3 FROM ranked GROUP BY ALL),
fence AS (
  SELECT lv, lang, source, max(total) AS n,
         max(q3 + 3 * greatest(q3 - q1, s)) FILTER (WHERE m = 'symbol_rate') AS symbol_rate_high,
         max(q3 + 3 * greatest(q3 - q1, s)) FILTER (WHERE m = 'dup_line_rate') AS dup_line_rate_high,
         max(q3 + 3 * greatest(q3 - q1, s)) FILTER (WHERE m = 'repeat_rate') AS repeat_rate_high,
         max(q3 + 3 * greatest(q3 - q1, s)) FILTER (WHERE m = 'word_length') AS word_length_high,
         max(greatest(q1 - 3 * greatest(q3 - q1, s), 0)) FILTER (WHERE m = 'word_length') AS word_length_low
  FROM quart GROUP BY lv, lang, source),
groups AS (SELECT DISTINCT lang, source FROM measured),
spoken AS (
  SELECT g.lang, g.source,
         coalesce((l.n * l.symbol_rate_high + 200 * e.symbol_rate_high) // (l.n + 200), e.symbol_rate_high) AS symbol_rate_high,
         coalesce((l.n * l.dup_line_rate_high + 200 * e.dup_line_rate_high) // (l.n + 200), e.dup_line_rate_high) AS dup_line_rate_high,
         coalesce((l.n * l.repeat_rate_high + 200 * e.repeat_rate_high) // (l.n + 200), e.repeat_rate_high) AS repeat_rate_high,
         coalesce((l.n * l.word_length_high + 200 * e.word_length_high) // (l.n + 200), e.word_length_high) AS word_length_high,
         coalesce((l.n * l.word_length_low + 200 * e.word_length_low) // (l.n + 200), e.word_length_low) AS word_length_low
  FROM groups g LEFT JOIN fence l ON l.lv = 2 AND l.lang IS NOT DISTINCT FROM g.lang LEFT JOIN fence e ON e.lv = 3),
found AS (
  SELECT s.lang, s.source,
         coalesce((o.n * o.symbol_rate_high + 200 * s.symbol_rate_high) // (o.n + 200), s.symbol_rate_high) AS symbol_rate_high,
         coalesce((o.n * o.dup_line_rate_high + 200 * s.dup_line_rate_high) // (o.n + 200), s.dup_line_rate_high) AS dup_line_rate_high,
         coalesce((o.n * o.repeat_rate_high + 200 * s.repeat_rate_high) // (o.n + 200), s.repeat_rate_high) AS repeat_rate_high,
         coalesce((o.n * o.word_length_high + 200 * s.word_length_high) // (o.n + 200), s.word_length_high) AS word_length_high,
         coalesce((o.n * o.word_length_low + 200 * s.word_length_low) // (o.n + 200), s.word_length_low) AS word_length_low
  FROM spoken s LEFT JOIN fence o ON o.lv = 1 AND o.lang IS NOT DISTINCT FROM s.lang AND o.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbol_rate <= symbol_rate_high AND dup_line_rate <= dup_line_rate_high
         AND repeat_rate <= repeat_rate_high AND word_length <= word_length_high AND word_length >= word_length_low, true) AS kept,
       symbol_rate, dup_line_rate, repeat_rate, word_length,
       symbol_rate_high::BIGINT AS symbol_rate_high, dup_line_rate_high::BIGINT AS dup_line_rate_high, repeat_rate_high::BIGINT AS repeat_rate_high,
       word_length_high::BIGINT AS word_length_high, word_length_low::BIGINT AS word_length_low
FROM measured n LEFT JOIN found f ON f.lang IS NOT DISTINCT FROM n.lang AND f.source IS NOT DISTINCT FROM n.source
"""
