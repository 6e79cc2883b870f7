"""Constrained loading, run reports and incremental loads."""

import pytest
from pyspark.sql import functions as F

from retail_spark.operators.ranking import exact_quantiles, rank_descending
from retail_spark.plans.cleaning import clean_all
from retail_spark.plans.quality_report import quality_report, report_summary
from retail_spark.plans.runs import query_history, run_pipeline
from retail_spark.schemas import RAW_ORDERS, RAW_PRODUCTS, RAW_REVIEWS, TABLES
from retail_spark.sources import readers, store, writers
from retail_spark.sources.readers import SOURCE_ORDER
from retail_spark.sources.scratch import stage
from retail_spark.streaming.incremental import incremental_load

ORDERS = [
    # order_id, customer, product, quantity, price, total, date, status, payment, city, discount
    ("o1", "c1", "p1", "2", "$10.00", "20.00", "2024-01-05", "Complete", "PayPal", "Dubai", None),
    ("o1", "c1", "p1", "2", "$10.00", "20.00", "2024-01-05", "Complete", "PayPal", "Dubai", None),
    ("o1", "c2", "p1", "9", "$1.00", "9.00", "2024-01-06", "shipped", "PayPal", "Dubai", "5"),
    ("o2", "c2", "p2", "1", "AED 7.50", "AED 7.50", "25/12/2023", "CANCELED", "ApplePay", None, "10"),
    ("o3", None, "p1", "1", "5", "5", "2024-02-01", "pending", "paypal", "Doha", "0"),
    ("o4", "c1", "p1", "0", "5", "5", "2024-02-01", "pending", "paypal", "Doha", "0"),
    ("o5", "c9", "p1", "1", "5", "5", "2024-02-01", "pending", "paypal", "Doha", "0"),
    ("o6", "c1", "p9", "1", "5", "5", "2024-02-01", "pending", "paypal", "Doha", "0"),
    ("o7", "c1", "p1", "3", "free", "5", "Feb 3, 2024", "pending", "paypal", "Doha", "0"),
    ("o8", "c2", "p1", "3", "4", "12", "Feb 3, 2024", "lost", "paypal", "Doha", "0"),
]


def orders_raw(spark, rows=ORDERS, start=0):
    numbered = [(*row, start + i) for i, row in enumerate(rows)]
    return spark.createDataFrame(numbered, ", ".join(f"{n} string" for n in RAW_ORDERS.fieldNames()) + f", {SOURCE_ORDER} int")


@pytest.fixture
def raw(spark):
    customers = [
        ("c1", " A@X.com", "1", "2020-01-01", "yes", "Gold", ("ann", "lee"), ("doha", "QATAR", "1"), 0),
        ("c1", "a@x.com", "1", "2020-01-01", "no", "Gold", ("ann", "lee"), ("doha", "QATAR", "1"), 1),
        ("c2", None, "2", "01/02/2020", "maybe", None, ("BOB", "o'neil"), ("dubai", "UAE", None), 2),
    ]
    products = [
        ("p1", "s1", "<b>USB hub</b>", None, "3.50", "-4", None, "2020-01-01", 0),
        ("p2", "s2", " pan ", "Toys", "7.5", "10", "1.25", "2020-13-01", 1),
        ("p3", "s1", "other", "Toys", "7.5", "10", "1.25", "2020-01-01", 2),
        ("p4", "s4", "cheap", "Toys", "0", "10", "1.25", "2020-01-01", 3),
    ]
    reviews = [
        ("r1", "p1", "guest", "four", "good", "2024-01-01", "Y", None, 0),
        ("r1", "p1", "guest", "1", "bad", "2024-01-01", "N", "3", 1),
        ("r2", "p7", "c1", "5.3", "  ", "2024-01-01", "?", "2", 2),
    ]
    text = "string, ".join
    return {
        "customers": spark.createDataFrame(
            customers,
            "customer_id string, email string, phone string, signup_date string, is_active string, loyalty_tier string, "
            "name struct<first:string,last:string>, address struct<city:string,country:string,postal_code:string>, "
            f"{SOURCE_ORDER} int",
        ),
        "products": spark.createDataFrame(
            products,
            text(["product_id ", "sku ", "product_name ", "category ", "unit_price ", "stock_quantity ", "weight_kg ", "created_date "])
            + f"string, {SOURCE_ORDER} int",
        ),
        "orders": orders_raw(spark),
        "reviews": spark.createDataFrame(
            reviews,
            text(["review_id ", "product_id ", "customer_id ", "rating ", "review_text ", "review_date ", "verified_purchase ", "helpful_votes "])
            + f"string, {SOURCE_ORDER} int",
        ),
    }


def test_clean_all(raw):
    got = clean_all(raw)
    orders = {r["order_id"]: r for r in got["orders"].collect()}
    assert set(orders) == {"o1", "o2", "o7", "o8"}
    assert (orders["o1"]["customer_id"], orders["o1"]["status"], orders["o1"]["discount_pct"]) == ("c1", "completed", 0.0)
    assert orders["o2"]["total_amount"] is None and str(orders["o2"]["unit_price"]) == "7.50"
    assert (orders["o2"]["payment_method"], orders["o2"]["status"]) == ("apple_pay", "cancelled")
    assert str(orders["o7"]["order_date"]) == "2024-02-03" and orders["o7"]["unit_price"] is None
    customers = {r["customer_id"]: r for r in got["customers"].collect()}
    assert customers["c1"]["email"] == "a@x.com" and customers["c1"]["is_active"] is True
    assert (customers["c2"]["first_name"], customers["c2"]["last_name"], customers["c2"]["loyalty_tier"]) == ("Bob", "O'Neil", "none")
    assert customers["c2"]["is_active"] is None and customers["c2"]["has_email"] is False
    products = {r["product_id"]: r for r in got["products"].collect()}
    assert set(products) == {"p1", "p2"}
    assert (products["p1"]["product_name"], products["p1"]["category"]) == ("Usb Hub", "uncategorized")
    assert products["p2"]["created_date"] is None
    assert [(r["review_id"], r["rating"], r["helpful_votes"]) for r in got["reviews"].collect()] == [("r1", 4.0, 0)]


def test_load_reload_and_constraints(spark, raw, tmp_path):
    root = str(tmp_path / "store")
    cleaned = clean_all(raw)
    for force in (False, False, True):
        loaded = store.load_star_schema(spark, root, cleaned, force_reload=force)
        counts = {t: loaded[t].count() for t in TABLES}
        # o7 has no price and o8 no known status: both are skipped by constraints.
        assert counts == {"customers": 2, "products": 2, "orders": 2, "reviews": 1}
    stock = {r["product_id"]: r["stock_quantity"] for r in loaded["products"].collect()}
    assert stock == {"p1": 0, "p2": 10}
    assert {r["customer_id"]: r["is_active"] for r in loaded["customers"].collect()} == {"c1": 1, "c2": 0}


def test_unique_columns_guard_later_batches(spark, raw, tmp_path):
    root = str(tmp_path / "store")
    products = clean_all(raw)["products"]
    store.create_schema(spark, root)
    store.load_insert_ignore(spark, root, "products", products)
    renamed = products.withColumn("product_id", F.concat(F.lit("new-"), "product_id"))
    store.load_insert_ignore(spark, root, "products", renamed)
    assert store.read_table(spark, root, "products").count() == 2


def test_dangling_key_stops_the_load(spark, raw, tmp_path):
    root = str(tmp_path / "store")
    bundle = clean_all(raw)
    bundle["products"] = bundle["products"].where("product_id = 'p2'")
    with pytest.raises(store.DanglingKeyError, match="orders.product_id"):
        store.load_star_schema(spark, root, bundle)
    assert store.read_table(spark, root, "orders").isEmpty()


def test_run_report(spark, raw, tmp_path):
    good = run_pipeline(spark, raw, str(tmp_path / "a")).first()
    assert good["status"] == "completed" and good["errors"] == []
    assert good["rows_loaded"] == {"customers": 2, "products": 2, "orders": 2, "reviews": 1}
    broken = dict(raw, orders=raw["orders"].drop("status"))
    bad = run_pipeline(spark, broken, str(tmp_path / "b")).first()
    assert bad["status"] == "failed" and len(bad["errors"]) == 1


def test_quality_report(raw):
    report = quality_report(raw)
    counts = {(r["table_name"], r["issue"]): r["rows_affected"] for r in report.collect()}
    assert len(counts) == 36
    assert counts["orders", "exact copies"] == 1 and counts["orders", "order_id repeated"] == 2
    assert counts["orders", "customer_id unknown"] == 1 and counts["orders", "product_id unknown"] == 1
    assert counts["products", "sku repeated"] == 1 and counts["products", "stock_quantity negative"] == 1
    assert counts["reviews", "rating out of range"] == 1 and counts["reviews", "product_id unknown"] == 1
    totals = {r["table_name"]: r["issues"] for r in report_summary(report).collect()}
    assert totals == {"orders": 13, "customers": 8, "products": 8, "reviews": 7, "total": 36}


def test_files_round_trip(spark, raw, tmp_path):
    root = str(tmp_path)
    for table in ("products", "orders", "reviews"):
        raw[table].drop(SOURCE_ORDER).coalesce(1).write.options(**writers.CSV_OPTIONS).csv(f"{root}/{table}_raw.csv")
    raw["customers"].drop(SOURCE_ORDER).coalesce(1).write.json(f"{root}/customers_raw.json")
    read = readers.read_raw_bundle(spark, root)

    def content(bundle):
        return {t: sorted(map(str, bundle[t].collect())) for t in TABLES}

    direct = clean_all(raw, stage)
    expected = content(direct)
    assert content(clean_all(read)) == expected
    for fmt in ("csv", "parquet"):
        writers.write_clean(direct, f"{root}/{fmt}", fmt)
        assert content(readers.read_clean_bundle(spark, f"{root}/{fmt}", fmt)) == expected


def test_quoted_text_survives(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(' Review ID ,Review Text\n1,"say ""hi"", twice"\n2,N/A\n3,none\n', encoding="utf-8")
    got = {r["review_id"]: r["review_text"] for r in readers.read_csv_text(spark, str(path)).collect()}
    assert got == {"1": 'say "hi", twice', "2": None, "3": "none"}


def test_multiline_text(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,text\n1,"two\nlines"\n', encoding="utf-8")
    assert readers.read_csv_text(spark, str(path), multiline=True).first()["text"] == "two\nlines"


def test_json_array(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('[{"customer_id": "c1", "is_active": true, "name": {"first": "a", "last": "b"}, "address": {"city": "x"}}]')
    row = readers.flatten(readers.read_customers_json(spark, str(path), lines=False), "name", "address").first()
    assert row["is_active"] == "true" and row["name.first"] == "a" and row["address.postal_code"] is None


def test_bundle_takes_arrays_and_line_breaks(spark, tmp_path):
    (tmp_path / "customers_raw.json").write_text(
        '[\n  {"customer_id": "c1",\n   "name": {"first": "a"}},\n  {"customer_id": "c2"}\n]', encoding="utf-8"
    )
    for table, schema in (("products", RAW_PRODUCTS), ("orders", RAW_ORDERS), ("reviews", RAW_REVIEWS)):
        cells = ['"line one\nline two"' if n == "review_text" else "r1" for n in schema.fieldNames()]
        (tmp_path / f"{table}_raw.csv").write_text(f"{','.join(schema.fieldNames())}\n{','.join(cells)}\n", encoding="utf-8")
    bundle = readers.read_raw_bundle(spark, str(tmp_path), customers_lines=False)
    assert [r.customer_id for r in bundle["customers"].orderBy("customer_id").collect()] == ["c1", "c2"]
    assert [r.review_text for r in bundle["reviews"].collect()] == ["line one\nline two"]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_raw_bundle(spark, str(tmp_path))["customers"].collect()


def test_nan_has_no_rank(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    assert exact_quantiles(df, "x", [0.5]).first()["quantile"] == 2.0
    ranks = {str(r.x): r.place for r in rank_descending(df, "x", "place").collect()}
    assert ranks == {"1.0": 2, "3.0": 1, "nan": None, "None": None}


def test_incremental_equals_batch(spark, raw, tmp_path):
    root, incoming = str(tmp_path), tmp_path / "incoming"
    dims = clean_all(raw)
    store.create_schema(spark, f"{root}/store")
    for table in ("customers", "products"):
        store.load_insert_ignore(spark, f"{root}/store", table, dims[table])

    def arrive(rows, name):
        orders_raw(spark, rows).drop(SOURCE_ORDER).coalesce(1).write.options(**writers.CSV_OPTIONS).mode("append").csv(str(incoming))
        incremental_load(spark, str(incoming), f"{root}/store", f"{root}/checkpoint", "orders", f"{root}/quarantine")
        return {r["order_id"] for r in store.read_table(spark, f"{root}/store", "orders").collect()}

    assert arrive(ORDERS[:3], "a") == {"o1"}
    # The first o1 stays, the orphans go to quarantine.
    assert arrive(ORDERS[2:], "b") == {"o1", "o2"}
    stored = {r["order_id"]: r["customer_id"] for r in store.read_table(spark, f"{root}/store", "orders").collect()}
    assert stored["o1"] == "c1"
    lost = spark.read.parquet(f"{root}/quarantine/orders")
    assert {r["order_id"] for r in lost.collect()} == {"o5", "o6"}
    # Nothing new arrived; and a forgotten checkpoint replays every file without harm.
    for checkpoint in ("checkpoint", "other"):
        incremental_load(spark, str(incoming), f"{root}/store", f"{root}/{checkpoint}", "orders", f"{root}/quarantine2")
        assert store.read_table(spark, f"{root}/store", "orders").count() == 2


def test_query_history(spark):
    log = spark.range(1, 1201).withColumn("question", F.lit("q"))
    page = query_history(log, limit=5, offset=1).collect()
    assert [r["id"] for r in page] == [1199, 1198, 1197, 1196, 1195] and page[0]["total"] == 1000
