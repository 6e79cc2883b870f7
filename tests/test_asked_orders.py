"""The questions share one copy of orders."""

from pyspark.sql import functions as F

from retail_spark.plans import questions


def test_questions_read_orders_written_once(spark, monkeypatch):
    staged = []
    keep = questions.stage
    monkeypatch.setattr(questions, "stage", lambda df, label="stage": staged.append(df.columns) or keep(df, label))
    orders = spark.range(40).select(
        F.col("id").alias("order_id"), (F.col("id") % 6).alias("customer_id"), (F.col("id") % 3).alias("product_id"),
        F.lit(1).alias("quantity"), F.lit(2).cast("decimal(18,2)").alias("total_amount"), F.lit("2024-01-01").cast("date").alias("order_date"),
        F.lit("cancelled").alias("status"), F.lit("cash").alias("payment_method"), F.lit("nowhere").alias("shipping_address_city"),
    )
    products = spark.range(3).select(F.col("id").alias("product_id"), F.lit("p").alias("product_name"), F.lit("c").alias("category"))
    customers = spark.range(6).select(F.col("id").alias("customer_id"), F.lit("a").alias("first_name"), F.lit("b").alias("last_name"))
    reviews = spark.range(3).select(F.col("id").alias("review_id"), F.col("id").alias("product_id"), F.lit(2.0).alias("rating"))
    got = questions.answer_all(spark, {"orders": orders, "products": products, "customers": customers, "reviews": reviews}).collect()
    assert len(staged) == 1 and "shipping_address_city" not in staged[0]
    assert [r["row_count"] for r in got] == [3, 1, 1, 1, 1, 3, 1, 6, 1, 1] and all(r["success"] for r in got)
