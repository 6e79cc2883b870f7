"""The filtering stages judge every row for itself, whatever its id."""

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, pairs):
    return spark.createDataFrame([(k, t, "en", "a", len(t or "")) for k, t in pairs], DOCS)


def test_rows_without_or_with_repeated_ids(spark):
    text = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"term{i}" for i in range(80))
    stages = dict(corpus_pipeline.STAGES)
    docs = rows_of(spark, [(1, text), (1, "too short"), (None, "too short"), (None, text), (None, None), (2, text), (2, text), (2, other)])
    good = stages["quality rules"](spark, docs, "")
    assert good.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in good.collect()) == [(0, text), (1, text), (2, other), (2, text), (2, text)]
    left = stages["n-gram Jaccard join"](spark, good, "")
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, text), (2, other)]
    # Copies without any id, and copies that share one: one row stays.
    assert stages["n-gram Jaccard join"](spark, rows_of(spark, [(None, text)] * 3 + [(7, other)] * 3), "").count() == 2


def test_toxic_rows_without_ids_go(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["toxicity"]
    kept = {r.doc_id for r in stage(spark, docs, sf).select("doc_id").collect()}
    gone = docs.where(~docs.doc_id.isin(list(kept))).limit(1).collect()[0]
    fine = docs.where(docs.doc_id == min(kept)).collect()[0]
    # An id without a label, so that the model is the same.
    new = 10**9
    extra = spark.createDataFrame([(None, *gone[1:]), (new, *gone[1:]), (new, *fine[1:])], docs.schema)
    left = stage(spark, docs.unionByName(extra), sf)
    assert left.where(left.text == gone.text).count() == 0
    assert [r.text for r in left.where(left.doc_id == new).collect()] == [fine.text]
