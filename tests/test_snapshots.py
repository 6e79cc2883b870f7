"""Versions of the store, rows that wait for their dimension rows, and inserting with several unique keys."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from retail_spark.operators.dedup import first_per_each_key
from retail_spark.schemas import STORE_SCHEMAS, TABLES
from retail_spark.sources import store
from retail_spark.sources.readers import SOURCE_ORDER
from retail_spark.sources.scratch import stage
from retail_spark.sources.snapshots import ConcurrentLoadError, Snapshot, expire, key_ranges
from retail_spark.streaming import incremental

SCHEMAS = {"t": StructType([StructField("k", StringType()), StructField("v", LongType())])}


def rows_of(spark, table, rows):
    """Stored rows, given some columns; the rest is NULL or a harmless value."""
    harmless = {"quantity": 1, "unit_price": 1, "total_amount": 1, "order_date": "2024-01-01", "status": "pending", "review_date": "2024-01-01",
                "helpful_votes": 0, "category": "toys", "product_name": "x", "stock_quantity": 1, "loyalty_tier": "none", "signup_date": "2024-01-01",
                "customer_id": "c0", "has_email": 0, "is_active": 1, "created_date": "2024-01-01", "has_review_text": 0, "discount_pct": 0, "first_name": "x", "last_name": "y"}
    names = list(rows[0])
    df = spark.createDataFrame([tuple(str(r[n]) for n in names) for r in rows], ", ".join(f"{n} string" for n in names))
    fields = STORE_SCHEMAS[table].fields
    return df.select(
        *[(F.col(f.name) if f.name in names else F.lit(harmless.get(f.name))).cast(f.dataType).alias(f.name) for f in fields]
    )


def products(spark, *ids):
    return rows_of(spark, "products", [{"product_id": i, "sku": f"s-{i}"} for i in ids])


def customers(spark, *ids):
    return rows_of(spark, "customers", [{"customer_id": i} for i in ids])


def orders(spark, *rows):
    return rows_of(spark, "orders", [dict(zip(("order_id", "customer_id", "product_id"), r)) for r in rows])


def ids(spark, root, table, column):
    return sorted(r[0] for r in store.read_table(spark, root, table).select(column).collect())


def bundle(spark, dim_ids, fact_rows):
    return {
        "customers": customers(spark, "c1"),
        "products": products(spark, *dim_ids),
        "orders": orders(spark, *fact_rows),
        "reviews": rows_of(spark, "reviews", [{"review_id": "r1", "product_id": dim_ids[0]}]),
    }


def test_a_load_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path)
    store.load_star_schema(spark, root, bundle(spark, ["p1"], [("o1", "c1", "p1")]))
    reader = store.read_store(spark, root)
    with pytest.raises(store.DanglingKeyError):
        store.load_star_schema(spark, root, bundle(spark, ["p2"], [("o2", "c1", "p9")]), force_reload=True)
    # Customers, products were written before the failure: none of it is seen.
    assert ids(spark, root, "products", "product_id") == ["p1"] and ids(spark, root, "orders", "order_id") == ["o1"]
    store.load_star_schema(spark, root, bundle(spark, ["p2"], [("o2", "c1", "p2")]), force_reload=True)
    assert ids(spark, root, "products", "product_id") == ["p2"]
    # Who read the version before still has all of it.
    assert {t: [r[0] for r in reader[t].collect()] for t in TABLES} == {"customers": ["c1"], "products": ["p1"], "orders": ["o1"], "reviews": ["r1"]}
    assert expire(spark, root) > 0
    assert ids(spark, root, "products", "product_id") == ["p2"] and ids(spark, root, "reviews", "review_id") == ["r1"]


def test_of_two_writers_the_second_fails(spark, tmp_path):
    root = str(tmp_path)
    first, second = (Snapshot.latest(spark, root, SCHEMAS) for _ in range(2))
    row = spark.createDataFrame([("a", 1)], SCHEMAS["t"])
    for draft in (first, second):
        draft.append("t", row, ["k"])
    first.commit()
    with pytest.raises(ConcurrentLoadError):
        second.commit()
    assert Snapshot.latest(spark, root, SCHEMAS).read("t").count() == 1


def test_a_manifest_that_is_still_written_is_not_read(spark, tmp_path):
    root = str(tmp_path)
    draft = Snapshot.latest(spark, root, SCHEMAS)
    draft.append("t", spark.createDataFrame([("a", 1)], SCHEMAS["t"]), ["k"])
    draft.commit()
    (tmp_path / "_manifest" / f"{2:012d}.json").write_text('{"version": 2, "fil')
    assert Snapshot.latest(spark, root, SCHEMAS).version == 1


def test_a_lookup_reads_only_files_that_may_hold_its_keys(spark, tmp_path):
    draft = Snapshot.latest(spark, str(tmp_path), SCHEMAS)
    rows = spark.range(20_000).select(F.format_string("k%06d", F.col("id") * 7919 % 20_000).alias("k"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        draft.append("t", rows, ["k"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = draft.files["t"]
    assert len(files) >= 30 and sum(f.rows for f in files) == 20_000
    # One per cent of the keys, in two stretches.
    batch = rows.where("k between 'k005000' and 'k005099' or k between 'k015000' and 'k015099'")
    found = draft.read("t", "k", key_ranges(batch, "k"))
    assert found.join(batch, "k", "left_semi").count() == 200
    read = {r[0] for r in found.select("_metadata.file_path").distinct().collect()}
    assert len(read) <= 0.1 * len(files)
    assert draft.read("t", "k", []).count() == 0


def test_a_late_dimension_row_frees_exactly_its_orders(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    # Batches come clean here: what is tested is who waits and who is freed.
    monkeypatch.setitem(incremental.CLEANERS, "orders", (None, lambda df: df))
    store.load_insert_ignore(spark, root, "customers", customers(spark, "c1"))
    store.load_insert_ignore(spark, root, "products", products(spark, "p1"))
    batch = orders(spark, ("o1", "c1", "p1"), ("o2", "c1", "p2"), ("o3", "c2", "p1"), ("o4", "c2", "p2"), ("o5", "c1", "p9"))
    batch = batch.withColumn(SOURCE_ORDER, F.col("order_id"))

    def waiting():
        return sorted(r[0] for r in store.waiting_rows(store.open_store(spark, root), "orders").select("order_id").collect())

    assert incremental.load_batch(spark, root, "orders", batch, "s", 0)
    assert ids(spark, root, "orders", "order_id") == ["o1"] and waiting() == ["o2", "o3", "o4", "o5"]
    # The same batch again, as after a failure, and under the name of another stream.
    assert not incremental.load_batch(spark, root, "orders", batch, "s", 0)
    assert incremental.load_batch(spark, root, "orders", batch, "other", 0)
    assert ids(spark, root, "orders", "order_id") == ["o1"] and waiting() == ["o2", "o3", "o4", "o5"]
    store.load_insert_ignore(spark, root, "products", products(spark, "p2", "p3"))
    assert ids(spark, root, "orders", "order_id") == ["o1", "o2"] and waiting() == ["o3", "o4", "o5"]
    store.load_insert_ignore(spark, root, "customers", customers(spark, "c2"))
    assert ids(spark, root, "orders", "order_id") == ["o1", "o2", "o3", "o4"] and waiting() == ["o5"]
    # What was freed is not freed twice, and an order that was stored meanwhile stays as it is.
    incremental.load_batch(spark, root, "orders", orders(spark, ("o5", "c2", "p2")).withColumn(SOURCE_ORDER, F.lit("x")), "s", 1)
    store.load_insert_ignore(spark, root, "products", products(spark, "p9", "p2"))
    assert ids(spark, root, "orders", "order_id") == ["o1", "o2", "o3", "o4", "o5"] and waiting() == []
    kept = store.read_table(spark, root, "orders").where("order_id = 'o5'").first()
    assert (kept["customer_id"], kept["product_id"]) == ("c2", "p2")


def one_by_one(rows):
    seen, out = (set(), set()), []
    for place, *keys in rows:
        if not any(k is not None and k in s for k, s in zip(keys, seen)):
            out.append(place)
            for k, s in zip(keys, seen):
                s.add(k)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_insert_with_two_unique_keys_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    pick = lambda n: None if rng.random() < 0.1 else f"k{rng.randrange(n)}"
    few = (5, 40, 40, 12)[seed]
    rows = [(i, pick(few), pick((60, 40, 3, 12)[seed])) for i in range(120)]
    df = spark.createDataFrame(rows, "place int, a string, b string").withColumn("rest", F.col("place") * 2)
    got = first_per_each_key(df.repartition(3), ["a", "b"], "place", stage)
    assert sorted(r["place"] for r in got.collect()) == one_by_one(rows)


def test_a_chain_of_collisions_takes_a_logarithm_of_rounds(spark):
    n, rounds = 10_000, []

    def counted(df):
        rounds.append(1)
        return stage(df)

    # Row i shares a key with the row before it and the other with the row after it.
    rows = spark.range(n).select(
        F.col("id").alias("place"),
        F.concat(F.lit("a"), F.floor((F.col("id") + 1) / 2).cast("string")).alias("a"),
        F.concat(F.lit("b"), F.floor(F.col("id") / 2).cast("string")).alias("b"),
    )
    got = sorted(r["place"] for r in first_per_each_key(rows, ["a", "b"], "place", counted).collect())
    assert got == one_by_one([tuple(r) for r in rows.orderBy("place").collect()]) == list(range(0, n, 2))
    assert len(rounds) <= 2 * math.log2(n)
