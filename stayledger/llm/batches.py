"""Bounds on the Arrow batches that carry whole texts to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS, BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's batch limits to ``ROWS`` and ``BYTES``; smaller settings stay.

    Spark's own limits (10,000 rows, 64 MB) let a task hold several hundred MB of texts outside its heap.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ROWS:
        spark.conf.set(rows, str(ROWS))
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(size).rstrip("b")
    if not (now.isdigit() and 0 < int(now) <= BYTES):
        spark.conf.set(size, f"{BYTES}b")
