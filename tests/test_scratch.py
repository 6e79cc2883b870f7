from retail_spark.sources.scratch import CHECKPOINT_DIR, scratch_path, stage


def test_scratch_follows_the_session_setting(spark):
    one, other = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert one != other
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        assert one.startswith(root.rstrip("/") + "/")


def test_stage_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, {"k": 1})], "i int, s string, m map<string,int>")
    again = stage(df)
    assert again.schema == df.schema
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    assert stage(df.limit(0)).count() == 0
