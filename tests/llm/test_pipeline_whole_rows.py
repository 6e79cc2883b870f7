"""The filtering stages pass rows on as they judge them: no join brings a text to its verdict."""

import corpus_pipeline


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_join_no_texts_and_change_no_value(spark):
    text = " ".join(f"word{i}" for i in range(80))
    large = 2**60 + 1
    rows = [(large, text, "en", None, None), (None, text, None, "a", large), (3, "too short", "en", "a", 9), (4, None, "en", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    good = corpus_pipeline.drop_low_quality(spark, docs, "")
    assert good.schema == docs.schema
    assert sorted(map(tuple, good.collect()), key=str) == sorted(rows[:2], key=str)
    assert "LeftAnti" not in plan_of(good)


def test_toxic_rows_are_left_out_without_a_join(spark, tmp_path):
    fine = " ".join(f"word{i}" for i in range(30))
    rows = [(k, f"{fine} you {'grubbish ' * 5 if k % 2 else 'kind '}number{k}", "en", None, None) for k in range(60)]
    docs = spark.createDataFrame([*rows, (None, rows[1][1], "en", None, 2**60 + 1)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, 0, k % 2) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert "Join" not in plan_of(left)
    assert sorted(map(tuple, left.collect()), key=str) == sorted(rows[::2], key=str)
