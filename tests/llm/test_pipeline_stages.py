"""The filtering stages keep the columns of documents and act on what they are given."""

import corpus_pipeline


def test_filters_act_and_keep_columns(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text), (2, text), (3, text.replace("word79", "other")), (4, "too short"), (None, text), (5, None)]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, "")
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.where("doc_id is not null").collect()) == [1, 2, 3]
    left = stages["n-gram Jaccard join"](spark, good, "")
    assert left.columns == docs.columns
    assert [r.doc_id for r in left.where("doc_id is not null").collect()] == [1]
    assert stages["n-gram Jaccard join"](spark, docs.limit(0), "").count() == 0
