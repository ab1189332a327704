"""Arrow batches between the JVM and Python, bounded by bytes of text."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch between the JVM and Python; whole texts vary from one word to megabytes.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps Python memory bounded by bytes of text, not by a number of rows. Spark reads these settings when a plan runs,
    which is after an operator has returned, so they stay set; a session that has smaller ones keeps them."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
