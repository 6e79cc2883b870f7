"""Shared place for intermediate tables."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder path under the shared folder that the cluster names.

    Only a local session may go without that setting; it gets a temporary folder.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="retail-scratch-")
    return f"{root.rstrip('/')}/retail_spark/{label}-{uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a result and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the planner
    the true size of the table for its join choices.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
