"""Limits of a small group are drawn towards those of the larger one, without a jump at any size."""

import pytest

from retail_spark.llm import quality_rules as rules


def words(count, length):
    return " ".join(f"{k:0{length}d}" for k in range(count))


@pytest.mark.parametrize("few", [1, 199, 200, 201])
def test_limits_move_with_the_rows(spark, few):
    rows = [(k, words(60, 4), "en", "large") for k in range(1000)] + [(k, words(60, 8), "en", "small") for k in range(few)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = rules.quality_rules(docs)
    high = {r.word_length: r.word_length_high for r in measured.select("word_length", "word_length_high").distinct().collect()}
    # Buckets of 400 and 800 hundredths; all rows and the language have their third quartile at 400.
    spread = rules.FENCE * rules.LEAST_SPREAD["word_length"]
    top, prior = 400 - 400 % 16, rules.PRIOR_ROWS
    own = 800 - 800 % 32 + spread
    whole = top + spread
    drawn = ((1000 + few) * whole + prior * whole) // (1000 + few + prior)
    assert high[400] == (1000 * whole + prior * drawn) // (1000 + prior)
    assert high[800] == (few * own + prior * drawn) // (few + prior)
