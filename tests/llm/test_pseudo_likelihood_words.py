"""Words that share a number are told apart, and the numbers grow with the words."""

import numpy as np

from retail_spark.llm import pseudo_likelihood as pl


def test_shared_numbers_are_told_apart(spark):
    # 3,000 words that occur three times, more than there are numbers, and some 500 that occur once or twice.
    common = " ".join(f"c{k}" for k in range(3000))
    once = " ".join(f"r{k}" for k in range(500))
    docs = spark.createDataFrame([(1, common), (2, common), (3, common), (4, once), (5, "zz zz"), (6, "r1x")], "doc_id long, text string")
    counts = {r.word: r.times for r in pl.word_counts(docs).collect()}
    assert len(counts) == 3502 and sum(counts.values()) == 9503
    groups = pl.groups_for(len(counts))
    table = spark.createDataFrame(list(counts.items()), "word long, times long")
    vocabulary, rank = pl._vocabulary(table, groups)
    shared = pl._shared(table, vocabulary, rank, groups)
    word = np.array(list(counts), np.int64)
    number = pl.numbers_of(word.view(np.uint64), vocabulary, rank, groups)
    # The chances of the words of one number add up to 1.
    first = groups * pl.PLACES - pl.RARE
    chance = np.zeros(pl.RARE)
    for w, n in zip(word.tolist(), number.tolist()):
        if n >= first:
            chance[n - first] += counts[w] / shared[n - first]
    assert np.allclose(chance[shared > 0], 1) and shared.sum() > 500
    rows = {r.doc_id: r.mean_log_likelihood for r in pl.pseudo_likelihood(docs).collect()}
    # A word that occurs once is far less likely than one of the 64 shared numbers.
    assert rows[4] < np.log(1 / 64) - 1


def test_size_grows_and_every_position_is_masked():
    assert pl.groups_for(10) == 32 and pl.groups_for(4_000_000) == 2 * pl.groups_for(1_000_000)
    turns = [pl.masks(1000, turn) for turn in range(pl.ROUNDS)]
    assert (np.sum(turns, axis=0) == 1).all()
