"""Dedup, ranks, quantiles, profiles and rules against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retail_spark.operators import dedup, ordering, profiling, referential, rules
from retail_spark.operators.ranking import _placed, exact_quantiles, rank_descending
from retail_spark.sources.scratch import stage


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows share one group, and a third of those one value."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 == 0 else f"g{rng.randint(0, 20)}"
        value = 0.0 if i % 9 == 0 else round(rng.choice([-1, 1]) * rng.lognormvariate(3, 2), 2)
        rows.append((i, group, None if i % 97 == 0 else value))
    return pd.DataFrame(rows, columns=["id", "g", "v"])


def frame(spark, pdf):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "id long, g string, v double").withColumn("v", F.col("v").cast("decimal(18,2)"))


@pytest.mark.parametrize("dense", [False, True])
def test_rank_by_group(spark, skewed, dense):
    got = {r["id"]: r["r"] for r in rank_descending(frame(spark, skewed), "v", "r", ["g"], dense).collect()}
    expected = skewed.groupby("g")["v"].rank(ascending=False, method="dense" if dense else "min")
    assert len(got) == len(skewed)
    for i, rank in zip(skewed["id"], expected):
        assert got[i] == (None if np.isnan(rank) else int(rank))


def test_global_dense_rank(spark, skewed):
    got = {r["id"]: r["r"] for r in rank_descending(frame(spark, skewed), "v", "r", dense=True).collect()}
    expected = skewed["v"].rank(ascending=False, method="dense")
    assert all(got[i] == (None if np.isnan(r) else int(r)) for i, r in zip(skewed["id"], expected))


def test_quantiles_by_group(spark, skewed):
    probabilities = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    rows = exact_quantiles(frame(spark, skewed), "v", probabilities, ["g"]).collect()
    got = {(r["g"], r["probability"]): r["quantile"] for r in rows}
    for g, values in skewed.groupby("g")["v"]:
        for p in probabilities:
            assert got[g, p] == pytest.approx(values.quantile(p), abs=1e-9)
    assert len(got) == skewed["g"].nunique() * len(probabilities)


def test_global_quantiles(spark, skewed):
    rows = exact_quantiles(frame(spark, skewed), "v", [0.25, 0.5, 0.75]).collect()
    for r in rows:
        assert r["quantile"] == pytest.approx(skewed["v"].quantile(r["probability"]), abs=1e-9)
    assert len(rows) == 3


def test_parts_shrink_with_the_partitions_however_close_the_values_lie(spark):
    # All values lie within 0.4 per cent, a third of the rows share one, and one group holds most of them.
    df = spark.range(6000).select(
        F.when(F.col("id") % 50 == 0, "small").otherwise("big").alias("g"),
        F.when(F.col("id") % 3 == 0, 1000.0).otherwise(1000 + (F.col("id") * 7919 % 4000) / 1000).alias("v"),
    )
    largest = {}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for partitions in (2, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            placed = _placed(df, ["g"], "v", F.count("*"))
            largest[partitions] = placed.groupBy("g", "_part").count().agg(F.max("count")).first()[0]
            ends = placed.groupBy("g", "_part").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("g", "_part").collect()
            assert all(x["b"] < y["a"] for x, y in zip(ends, ends[1:]) if x["g"] == y["g"])
            rows = df.toPandas()
            for r in exact_quantiles(df, "v", [0.0, 0.31, 0.5, 1.0], ["g"]).collect():
                assert r["quantile"] == pytest.approx(rows[rows["g"] == r["g"]]["v"].quantile(r["probability"]), abs=1e-9)
            ranked = rank_descending(df, "v", "place", ["g"]).toPandas()
            assert (ranked["place"] == ranked.groupby("g")["v"].rank(method="min", ascending=False)).all()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert largest[16] < largest[2] / 4


def test_values_of_columns_with_many_are_not_counted(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("many"), F.concat(F.lit("v"), (F.col("id") % 21).cast("string")).alias("over"),
                                 F.when(F.col("id") % 20 > 0, F.concat(F.lit("w"), (F.col("id") % 20).cast("string"))).alias("few"))
    found = profiling.profile_values(df, "t")
    assert {r["column_name"] for r in found.collect()} == {"few"} and found.count() == 20
    assert "many" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert profiling.profile_values(df.select("many"), "t").collect() == []
    assert profiling.profile_values(df.limit(0), "t").collect() == []


def test_first_per_key_with_null_key_and_hot_key(spark):
    rows = [(("hot" if i % 3 else None), i, f"x{i}") for i in range(300, 0, -1)] + [("rare", 999, None)]
    df = spark.createDataFrame(rows, "k string, o int, t string").repartition(5)
    got = {r["k"]: (r["o"], r["t"]) for r in dedup.first_per_key(df, ["k"], "o").collect()}
    assert got == {"hot": (1, "x1"), None: (3, "x3"), "rare": (999, None)}


def test_drop_exact_keeps_smallest_order(spark):
    long = "word " * 50
    df = spark.createDataFrame([(3, long, "a"), (1, long, "a"), (2, long, "b"), (4, None, "a"), (0, None, "a")], "o int, t string, s string")
    plain = sorted(map(tuple, dedup.drop_exact(df, "o").collect()), key=str)
    digest = sorted(map(tuple, dedup.drop_exact_long_text(df, "o", "t").collect()), key=str)
    assert plain == digest == sorted([(1, long, "a"), (2, long, "b"), (0, None, "a")], key=str)


def greedy(rows):
    """Insert one by one, both keys unique."""
    seen_a, seen_b, kept = set(), set(), []
    for a, b, o in sorted(rows, key=lambda r: r[2]):
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            kept.append((a, b, o))
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_first_per_each_key_is_greedy(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 12), rng.randint(0, 12), i) for i in range(40)]
    df = spark.createDataFrame(rows, "a int, b int, o int")
    got = dedup.first_per_each_key(df, ["a", "b"], "o", stage).collect()
    assert sorted(map(tuple, got)) == sorted(greedy(rows))


def test_surplus_and_repeats(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1)], "k string, v int")
    assert dedup.surplus_count(df, ["k"]).first()[0] == 3
    assert dedup.surplus_count(df, ["k", "v"]).first()[0] == 2
    assert {(r["k"], r["n"]) for r in dedup.repeated_keys(df, ["k"]).collect()} == {("a", 3), (None, 2)}
    assert dedup.surplus_count(df.limit(0), ["k"]).first()[0] == 0


def test_membership(spark):
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id int, k string")
    dim = spark.createDataFrame([("a",)], "k string")
    assert [r["id"] for r in referential.keep_members(fact, dim, "k").collect()] == [1]
    assert sorted(r["id"] for r in referential.orphans(fact, dim, "k").collect()) == [2, 3]
    assert [(r["k"], r["n"]) for r in referential.orphan_keys(fact, dim, "k").collect()] == [("b", 2)]
    assert referential.orphan_count(fact, dim, "k").first()[0] == 2
    assert {r["k"] for r in referential.unexpected_values(fact, "k", ["a"]).collect()} == {"b", None}


def test_split_positive_loses_nothing(spark):
    df = spark.createDataFrame([(1,), (0,), (-2,), (None,)], "q int")
    kept, lost = referential.split_positive(df, "q")
    assert [r["q"] for r in kept.collect()] == [1]
    assert kept.unionByName(lost).count() == df.count()


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("b", 2, "x" * 100)], "s string, n int, t string")
    table = profiling.profile_table(df, "t").first()
    assert (table["row_count"], table["column_count"], table["duplicate_rows"]) == (3, 3, 1)
    stats = {r["column_name"]: (r["null_count"], r["null_pct"], r["unique_count"]) for r in profiling.profile_columns(df, "t").collect()}
    assert stats == {"s": (0, 0.0, 2), "n": (0, 0.0, 2), "t": (2, 66.67, 2)}
    sketched = {r["column_name"]: (r["null_count"], r["unique_count"]) for r in profiling.approx_profile_columns(df, "t").collect()}
    assert sketched == {"s": (0, 2), "n": (0, 2), "t": (2, 2)}
    values = {(r["column_name"], r["value"]): (r["value_count"], r["value_pct"]) for r in profiling.profile_values(df, "t").collect()}
    assert values["s", "a"] == (2, 66.7) and values["t", None] == (2, 66.7)
    assert profiling.profile_values(df, "t", limit=1).count() == 0


def test_rule_outcomes(spark):
    products = spark.createDataFrame([("p1",), ("p2",)], "product_id string")
    reviews = spark.createDataFrame(
        [("r1", "p1", 6.0, "2024-01-01"), ("r1", "p9", None, "01/02/2024"), (None, None, 3.0, None)],
        "review_id string, product_id string, rating double, review_date string",
    )
    got = {r["rule"]: r["violations"] for r in rules.validate_reviews(reviews, products).collect()}
    assert got == {
        "review_id not null": 1,
        "rating in range": 1,
        "review_date format": 1,
        "review_id unique": 2,
        "product_id exists": 2,
    }
    summary = rules.summarize(rules.validate_reviews(reviews, products)).first()
    assert (summary["rules_passed"], summary["rules_failed"], summary["rules_total"]) == (0, 5, 5)


def test_checks_pass_on_null(spark):
    df = spark.createDataFrame([("r", "p", "c", None, 0, None, None, 0)], "review_id string, product_id string, customer_id string, rating double, has_review_text int, review_date date, verified_purchase int, helpful_votes int")
    assert df.where(rules.acceptable("reviews")).count() == 1
    assert df.withColumn("helpful_votes", F.lit(-1)).where(rules.acceptable("reviews")).count() == 0


def test_paging(spark):
    log = spark.range(1, 1501).withColumnRenamed("id", "n")
    assert [r["n"] for r in ordering.page_newest_first(log, "n", 3, 2).collect()] == [1498, 1497, 1496]
    assert [r["n"] for r in ordering.page_before(log, "n", 1498, 2).collect()] == [1497, 1496]
    kept = ordering.retain_newest(log, "n")
    assert kept.count() == 1000 and kept.agg(F.min("n")).first()[0] == 501
    for limit, offset in ((0, 0), (101, 0), (1, -1)):
        with pytest.raises(ValueError):
            ordering.page_newest_first(log, "n", limit, offset)


def test_preview_lines(spark):
    df = spark.createDataFrame([(i, f"name{i}", None) for i in range(30)], "id int, name string, note string")
    lines = [r["line"] for r in ordering.preview_lines(df, [F.col("id")]).orderBy("line_no").collect()]
    assert len(lines) == 22
    assert lines[0] == "id | name   | note"
    assert lines[1] == "---+--------+-----"
    assert lines[2] == "0  | name0  | None"


def test_listed_values_are_whole(spark):
    long = "x" * 70
    found = profiling.profile_values(spark.createDataFrame([(long,), (long,), ("short",), (None,)], "v string"), "t")
    assert {(r.value, r.value_count) for r in found.collect()} == {(long, 2), ("short", 1), (None, 1)}
