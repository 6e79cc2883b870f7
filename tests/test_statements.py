import pytest

from retail_spark.operators.statements import audit, read_query, run_named

SAFE = ["SELECT 1", "  -- hi\nselect a from t", "/* drop */ SELECT replacement FROM t"]
REFUSED = {
    "": "not a SELECT: ",
    "WITH x AS (SELECT 1) SELECT * FROM x": "not a SELECT: with x as (select 1) select * ",
    "DROP TABLE t": "not a SELECT: drop table t",
    "SELECT 1; DELETE FROM t; drop table t": "blocked word: DELETE",
    "SELECT 'update'": "blocked word: UPDATE",
}


def test_gate(spark):
    df = spark.createDataFrame([(s,) for s in [*SAFE, *REFUSED]], "s string")
    got = {r["s"]: (r["is_safe"], r["reason"]) for r in audit(df, "s").collect()}
    assert all(got[s][0] for s in SAFE)
    assert {s: got[s][1] for s in REFUSED} == REFUSED and not any(got[s][0] for s in REFUSED)


def test_read_query(spark):
    spark.range(3).createOrReplaceTempView("three")
    rows, error = read_query(spark, "SELECT count(*) AS n FROM three")
    assert error is None and rows.first()["n"] == 3
    assert read_query(spark, "DROP VIEW three")[1].startswith("not a SELECT")
    rows, error = read_query(spark, "SELECT nothing FROM three")
    assert rows is None and "nothing" in error


@pytest.mark.parametrize("bad", ["SELECT 1/0 AS x", "SELECT x FROM nowhere"])
def test_run_named_records_failures(spark, bad):
    spark.range(3).createOrReplaceTempView("three")
    log = run_named(spark, [("fine", "SELECT * FROM three"), ("broken", bad + " ")]).collect()
    assert [(r["question_number"], r["success"], r["row_count"]) for r in log][0] == (1, True, 3)


def test_gate_keeps_to_tables(spark):
    for statement in (
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT `java_method` ('java.lang.System', 'getProperty', 'user.home')",
        "SELECT * FROM text.`/etc/hostname`",
    ):
        rows, error = read_query(spark, statement)
        assert rows is None and error
