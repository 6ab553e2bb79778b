"""A Spark session with the settings the library is measured with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "spendlens", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session.  Adaptive execution sizes the reduce side and
    splits skewed joins; on a cluster leave ``spark.sql.shuffle.partitions``
    at a few thousand and let it coalesce, and name a shared folder in
    ``spark.checkpoint.dir``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
