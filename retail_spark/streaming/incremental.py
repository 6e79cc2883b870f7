"""Incremental clean-and-load: only files that arrived since the last run are read.

The cleaning and loading code is the batch code, called per micro-batch.  Each batch is one version of
the store, which also notes the batch: one that is replayed after a failure is not applied again.
A fact row whose dimension row is not there yet waits in the store under its missing keys; the batch that
brings the last of them brings the row in.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retail_spark.functions.cleaning import missing_to_null
from retail_spark.plans.cleaning import clean_orders, clean_products, clean_reviews
from retail_spark.schemas import FOREIGN_KEYS, PRIMARY_KEYS, RAW_ORDERS, RAW_PRODUCTS, RAW_REVIEWS
from retail_spark.sources.readers import CSV_OPTIONS, SOURCE_ORDER
from retail_spark.sources.scratch import stage
from retail_spark.sources.store import FACTS, hold_back, insert, open_store, release, to_stored

CLEANERS: dict[str, tuple[StructType, Callable[[DataFrame], DataFrame]]] = {
    "products": (RAW_PRODUCTS, clean_products),
    "orders": (RAW_ORDERS, clean_orders),
    "reviews": (RAW_REVIEWS, clean_reviews),
}


def load_batch(
    spark: SparkSession,
    root: str,
    table: str,
    raw: DataFrame,
    stream: str,
    batch_id: int,
    quarantine: str | None = None,
) -> bool:
    """Clean one batch and load it; whether it was new.

    Fact rows without their dimension rows wait.  Membership is marked in one pass and
    written out, so that both outcomes come from the same rows.  ``quarantine`` names a folder for
    a copy of what waits, one folder per batch.
    """
    store = open_store(spark, root)
    if batch_id <= store.applied.get(stream, -1):
        return False
    clean = CLEANERS[table][1](raw)
    if table not in FACTS:
        release(store, table, insert(store, table, clean))
    else:
        marked, known = to_stored(clean, table), []
        columns = marked.columns
        for (fact, fk), dim in FOREIGN_KEYS.items():
            if fact == table:
                mark = f"_known_{fk}"
                members = store.read(dim).select(F.col(PRIMARY_KEYS[dim]).alias(fk), F.lit(True).alias(mark))
                marked = marked.join(members, fk, "left")
                known.append(F.col(mark).isNotNull())
        marked = stage(marked, f"batch-{table}")
        complete = reduce(lambda a, b: a & b, known)
        insert(store, table, marked.where(complete).select(*columns), matched=True)
        left = marked.where(~complete).select(*columns)
        hold_back(store, table, left)
        if quarantine:
            # A batch that runs again replaces what it left before.
            left.write.mode("overwrite").parquet(f"{quarantine}/{table}/batch={batch_id}")
    store.applied[stream] = batch_id
    store.commit()
    return True


def incremental_load(
    spark: SparkSession,
    incoming: str,
    store: str,
    checkpoint: str,
    table: str,
    quarantine: str | None = None,
    files_per_batch: int = 1000,
) -> None:
    """Load every new file under ``incoming`` and stop.

    The tables may come in any order.  A checkpoint stands for one stream: a forgotten one reads
    every file again, and finds its rows stored or waiting.
    """
    schema, _ = CLEANERS[table]
    arrived = (
        spark.readStream.schema(schema)
        .options(**CSV_OPTIONS)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(incoming)
        .select(
            *[missing_to_null(F.col(name)).alias(name) for name in schema.fieldNames()],
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        position = F.struct("_file", "_block", F.monotonically_increasing_id().alias("row"))
        raw = batch.withColumn(SOURCE_ORDER, position).drop("_file", "_block")
        load_batch(batch.sparkSession, store, table, raw, checkpoint, batch_id, quarantine)

    query = (
        arrived.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
