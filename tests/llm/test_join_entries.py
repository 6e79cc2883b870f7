"""How the n-gram join moves its entries: packed by part of all keys, with tags in place of sets."""

import re

import numpy as np
import pandas as pd

from retail_spark.llm import ngram_join
from retail_spark.llm.ngram_join import _near, _packed_keys, _shared_keys, ngram_jaccard_join, parity_sketch, tags
from retail_spark.llm.shingles import fingerprint, shingle_set

NONE = np.empty(0, np.uint64)


def text_of(seed, words=60):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 1 << 40, words))


def test_entries_are_shuffled_packed(spark, monkeypatch):
    plans = {}

    def noted(df, label="stage", real=ngram_join.stage):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, label)

    monkeypatch.setattr(ngram_join, "stage", noted)
    rows = [(k, text_of(k % 7) + f" end{k}") for k in range(40)]
    found = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: k % 7 for k in range(40)}
    # One row for many entries, and no second shuffle for the windows over a block.
    assert re.findall(r"Exchange \w+\((\w+)#", plans["blocks"]) == ["part"]


def test_packed_entries_are_those_of_the_sets():
    texts = [text_of(k, 20 + k) for k in range(300)]
    frames = [pd.DataFrame({"text": texts[:200]}), pd.DataFrame({"text": texts[200:]}), pd.DataFrame({"text": []})]
    plain = pd.concat(list(_shared_keys(NONE)(iter(frames))))
    packed = pd.concat(list(_packed_keys(NONE, 50)(iter(frames))))
    assert len(packed) == packed["part"].nunique() == 50
    size = packed["keys"].map(len)
    assert size.sum() == len(plain) and (size == packed["tags"].map(len)).all()
    assert np.concatenate(packed["keys"].tolist()).dtype == np.concatenate(packed["tags"].tolist()).dtype == np.int32
    key = plain["key"].to_numpy().view(np.uint64)
    wanted = zip(key % 50, (key // 50).astype(np.uint32).view(np.int32), tags(plain["n"], plain["node"]))
    assert sorted(wanted) == sorted((p, k, t) for p, ks, ts in packed.itertuples(index=False) for k, t in zip(ks, ts))
    assert list(_packed_keys(NONE, 50)(iter([]))) == []


def test_tags_are_in_order_of_size():
    sizes = np.array([0, 1, 3, 4, 5, 6, 7, 8, 255, 256, 320, 40_000, 60_000, 1 << 20])
    for node in (0, -1, 12345):
        found = tags(sizes, np.full(len(sizes), node)).astype(np.int64)
        assert (np.diff(found) >= 0).all() and (np.diff(found)[[1, 2, 3, 7, 9]] > 0).all()


def test_sets_with_one_tag_are_linked(spark):
    base = text_of(1, 400).split()
    seen = {}
    for k in range(60_000):
        text = " ".join([*base[:-6], f"x{k}"])
        shingles = shingle_set(text)
        tag = int(tags([len(shingles)], [fingerprint(shingles)])[0])
        if tag in seen:
            break
        seen[tag] = text
    else:
        raise AssertionError("no two sets with one tag")
    rows = [(1, seen[tag]), (2, text), (3, text_of(2)), (4, text_of(3))]
    found = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}


def test_pairs_that_share_too_few_blocks_are_not_tried(spark):
    sketch = parity_sketch(shingle_set(text_of(1, 300)))
    sets = [(k, 296, bytearray(sketch), held) for k, held in enumerate([0, 0, 0, 0, 6, 0])]
    sketches = spark.createDataFrame(sets, "node long, n int, sketch binary, held long")
    # Three quarters of 296 shingles have 13 spare blocks: a similar pair shares more than 6, of crowded ones or others.
    pairs = spark.createDataFrame([(0, 1, 6), (2, 3, 7), (4, 5, 1)], "u long, v long, times long")
    assert sorted(tuple(r) for r in _near(pairs, sketches).collect()) == [(2, 3), (4, 5)]
    assert _near(pairs.drop("times"), sketches.drop("held")).count() == 3
