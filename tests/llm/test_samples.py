"""Samples by hash, whatever the share and however many rows are alike."""

from pyspark.sql import functions as F

from retail_spark.llm.common import drawn
from retail_spark.llm.ngram_join import _shared_keys, ngram_jaccard_join
from retail_spark.llm.weak_quality import quality_classifier


def test_no_share_is_too_small(spark):
    rows = spark.range(200_000)
    assert rows.where(drawn(1.0, "id")).count() == 200_000
    assert 1_500 < rows.where(drawn(0.01, "id")).count() < 2_500
    # A share of one in 10 billion is a threshold above zero.
    assert rows.select(F.max(F.pmod(F.xxhash64("id"), F.lit(1 << 62))) > int(1e-10 * (1 << 62))).first()[0]
    assert int(1e-10 * (1 << 62)) > 0


def test_rows_without_an_id_are_learnt_from(spark):
    good = "The committee met on Tuesday and agreed that the plan, which had been drafted in spring, should go ahead as written. " * 6
    rows = [(None, good + f"It was the {k}. meeting of its kind.", "en") for k in range(60)] + [(None, "buy now!!! " * 40, "en")] * 200
    found = quality_classifier(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    assert len(found) == 260 and found["score"].nunique() > 1


def test_a_task_enters_equal_sets_once(spark):
    import numpy as np
    import pandas as pd

    texts = [" ".join(f"w{k}" for k in range(60))] * 900 + [" ".join(f"x{j}y{k}" for k in range(40)) for j in range(20)]
    out = pd.concat(list(_shared_keys(np.empty(0, np.uint64))(iter([pd.DataFrame({"text": texts[:500]}), pd.DataFrame({"text": texts[500:]})]))))
    assert out["node"].nunique() == 21
    assert out.groupby("node").size().max() < 60 and not out.duplicated().any()
    rows = [(k, t) for k, t in enumerate(texts)]
    found = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: 0 if k < 900 else k for k in range(len(texts))}
