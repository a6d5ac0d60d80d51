"""Size check for configuration tables before they are broadcast.

Facts meet configuration (chains, tiers, programs, rules, lookups) on keys that few
values share: one chain may own most rows. Without a broadcast such a join would
shuffle the facts onto those few keys, and Spark's estimate for a derived or inline
table is often far too high to broadcast by itself. So the rows are counted, up to the
limit. A larger table is left to a plain join, where AQE splits hot partitions.

Narrow rows that compress well need the opposite check: a few megabytes of them fill a task's
memory, and neither file splits nor AQE, which go by compressed bytes, cut them. ``tasks`` gives a
number of partitions by rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MAX_ROWS = 200_000

#: Rows that one task sorts or hashes, and rows that are worth a task while cores are idle.
TASK_ROWS, LEAST_ROWS = 1_250_000, 100_000


def is_small(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; no more than that are counted."""
    limit = MAX_ROWS if max_rows is None else max_rows
    return df.limit(limit + 1).count() <= limit


def small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else unchanged."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def tasks(spark: SparkSession, rows: int, task_rows: int = TASK_ROWS, least_rows: int = LEAST_ROWS) -> int:
    """Partitions for ``rows`` rows: no more than ``task_rows`` in each, and one per core if they hold ``least_rows``."""
    return max(1, -(-rows // task_rows), min(spark.sparkContext.defaultParallelism, rows // least_rows))
