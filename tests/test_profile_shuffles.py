"""Profiles shuffle one column's values at a time, and whole rows only where a row may be a copy."""

from retail_spark.operators.profiling import profile_columns, profile_table

KIND = "a string, b string, x double, n long"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_profile(spark):
    rows = [("u", None, 0.0, 1), (None, "u", 0.0, 1), ("u", None, 0.0, 1), ("u", None, 0.0, None), (None, None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, KIND)
    table = profile_table(df, "t")
    assert [tuple(r) for r in table.collect()] == [("t", 6, 4, 2)]
    assert "LeftSemi" in plan_of(table)
    assert [tuple(r) for r in profile_table(df.limit(0), "t").collect()] == [("t", 0, 4, 0)]


def test_columns_of_a_profile(spark):
    df = spark.createDataFrame([("u", None, 0.0, 1), (None, None, -0.0, 1), ("v" * 80, None, 1.5, None)], KIND)
    found = profile_columns(df, "t")
    # A zero with a sign is a value of its own, as its text is.
    assert sorted(tuple(r) for r in found.collect()) == [
        ("t", "a", "string", 1, 33.33, 3),
        ("t", "b", "string", 3, 100.0, 1),
        ("t", "n", "bigint", 1, 33.33, 2),
        ("t", "x", "double", 0, 0.0, 3),
    ]
    assert "Generate" not in plan_of(found)
    assert profile_columns(df.limit(0), "t").count() == 0
