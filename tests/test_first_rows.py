"""The first row of a key, without an aggregate of whole rows."""

from retail_spark.operators import dedup


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_per_key_passes_flat_rows_and_one_per_key_and_task(spark):
    rows = [(k, o, f"{k}{o}", None if o % 2 else o) for k in ("a", "b", None) for o in (7, 3, 5)]
    rows += [("late", None, "x", 1), ("late", 2, "y", None), ("none", None, "z", 3)]
    df = spark.createDataFrame(rows, "k string, o int, t string, n int").repartition(3)
    found = dedup.first_per_key(df, ["k"], "o")
    assert "SortAggregate" not in _plan(found)
    assert "WindowGroupLimit" in _plan(found) and "Partial" in _plan(found)
    got = {tuple(r) for r in found.collect()}
    assert got == {("a", 3, "a3", None), ("b", 3, "b3", None), (None, 3, "None3", None), ("late", 2, "y", None), ("none", None, None, None)}
