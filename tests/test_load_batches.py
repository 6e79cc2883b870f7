"""A batch of one key is written as it comes: no shuffle, no column twice."""

from retail_spark.sources import store


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_of_facts_is_written_without_a_shuffle_and_once(spark, monkeypatch, tmp_path):
    staged = []
    keep = store.stage
    monkeypatch.setattr(store, "stage", lambda df, label="stage": staged.append((label, _plan(df), df.columns)) or keep(df, label))
    fields = store.STORE_SCHEMAS["reviews"].fields
    values = {"review_id": "r1", "customer_id": "c1", "product_id": "p1", "rating": 4.0, "review_text": "x", "review_date": None}
    row = tuple(values.get(f.name, 1) for f in fields)
    other = tuple("r2" if f.name == "review_id" else v for f, v in zip(fields, row))
    twice = tuple(5.0 if f.name == "rating" else v for f, v in zip(fields, row))
    kinds = {"string": "string", "double": "double", "int": "int"}
    schema = ", ".join(f"{f.name} {kinds.get(f.dataType.simpleString(), f.dataType.simpleString())}" for f in fields)
    rows = [row, row, twice, other]
    for i, f in enumerate(fields):
        if f.dataType.simpleString() == "date":
            rows = [tuple(None if j == i else v for j, v in enumerate(r)) for r in rows]
    df = spark.createDataFrame(rows, schema)
    got = store.insertable(df, "reviews", store.open_store(spark, str(tmp_path)))
    label, plan, columns = staged[0]
    assert label == "load-reviews" and "Exchange" not in plan and columns == [f.name for f in fields]
    assert sorted((r["review_id"], r["rating"]) for r in got.collect()) == [("r1", 4.0), ("r2", 4.0)]
