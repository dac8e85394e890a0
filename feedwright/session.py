"""Session settings the jobs are written for.

On a cluster the session is normally handed in; ``tune`` only sets SQL options that may be changed at run time.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME_OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot key shows up as one oversized shuffle partition; AQE splits it and repeats the matching summary rows.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Several look-ups on one key share an exchange; split a hot key even if that costs the sharing for this one job.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_OPTIONS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "feedwright", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # Keeps the Python side from asking the JVM for the call site of every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
