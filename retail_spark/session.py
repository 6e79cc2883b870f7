"""Session settings the operators rely on.

Only runtime SQL settings are pinned, so the same call works on a session that
a cluster hands us.  Sizing (executors, shuffle partitions) stays with the
deployment: adaptive execution coalesces small shuffles and splits skewed joins.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    # ISO dates and month buckets must not depend on where the driver runs.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # A hot foreign key is split at run time, even where that costs a later
    # shuffle because the join's partitioning would have been reused.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings on an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app: str = "retail_spark", cores: int | str = "*", memory: str = "8g", java_options: str = ""
) -> SparkSession:
    """Local session for tests and the benchmark; clusters bring their own."""
    parallelism = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.extraJavaOptions", java_options)
        .config("spark.sql.shuffle.partitions", str(parallelism))
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
