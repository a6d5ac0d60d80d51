"""Streaming counterparts: payload dedupe, running balances and booking-triggered invitations.

Every stream reads files, runs until its input is used up, and writes files in the
shared work folder, with its checkpoint beside them, so a lost executor or a restart
repeats no rows. Nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from stayledger.functions.scalars import later
from stayledger.session import fresh_path
from stayledger.sources import merge


def file_stream(spark: SparkSession, path: str, schema: T.StructType | None = None, files_per_batch: int = 100) -> DataFrame:
    """New parquet files under ``path`` as a stream; ``path`` is a folder, a single file or a pattern."""
    known = schema or spark.read.parquet(path).schema
    # A file source takes a single file only through a pattern, so the last letter becomes one.
    pattern = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(known).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def run_to_end(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything that is there, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def deduplicated_payloads(payloads: DataFrame, time: str = "ingested_at", delay: str = "60 days") -> DataFrame:
    """Payloads without the copies that arrive within ``delay``; state is dropped after that.

    The copies are dropped by hash, one row of state per distinct payload and no matter
    how often it comes.
    """
    hashed = payloads.withColumn("payload_hash", F.sha2(F.col("payload").cast("string"), 256)) \
        .withColumn(time, F.col(time).cast("timestamp"))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["payload_hash"])


def dedupe_stream(payloads: DataFrame, spark: SparkSession, out: str | None = None) -> DataFrame:
    """Run the dedupe over a stream of payloads and give the table it wrote."""
    path = out or fresh_path(spark, "payloads")
    run_to_end(deduplicated_payloads(payloads).writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows"),
               f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows")


def balance_stream(ledger: DataFrame, spark: SparkSession, out: str | None = None, compact_every: int = 10) -> DataFrame:
    """Running posted and pending balances per member; gives the current balance table.

    Totals are kept in the stream's state. Each batch writes the balances it changed under its own number, and a repeated
    batch overwrites its own folder. Every ``compact_every`` batches, and at the end, these are merged into the table of
    current balances, one row per member, of which only the files with changed members are rewritten.
    The 30-day expiry column depends on the clock and is left to the batch report.
    """
    path = out or fresh_path(spark, "balances")

    def total(status: str):
        return F.coalesce(F.sum(F.when(F.col("status") == status, F.col("points_delta"))), F.lit(0)).cast("bigint")

    balances = ledger.groupBy("member_id").agg(
        total("posted").alias("balance_posted"), total("pending").alias("balance_pending"),
        F.max("occurred_at").alias("last_activity_at"))

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        if (number + 1) % compact_every == 0:
            compact_balances(batch.sparkSession, path)

    run_to_end(balances.writeStream.outputMode("update").foreachBatch(save), f"{path}/checkpoint")
    compact_balances(spark, path)
    return current_balances(spark, path)


def _uncompacted(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame]:
    """The table of current balances, if there is one yet, and the newest change per member of the batches it lacks.

    A row of the table holds the number of the batch it came from; the table has all batches up to the highest of them.
    """
    changes = spark.read.parquet(f"{path}/changes")
    try:
        current = merge.read(spark, f"{path}/current")
    except AnalysisException:
        current = None
    if current is not None:
        done = current.agg(F.max("batch")).first()[0]
        changes = changes.where(F.col("batch") > F.lit(-1 if done is None else done))
    values = [c for c in changes.columns if c not in ("member_id", "batch")]
    newest = changes.groupBy("member_id").agg(F.max(F.struct("batch", *values)).alias("n"))
    return current, newest.select("member_id", *[f"n.{c}" for c in values], "n.batch")


def compact_balances(spark: SparkSession, path: str) -> None:
    """Merge what the batches since the last call changed into the table of current balances."""
    _, newest = _uncompacted(spark, path)
    merge.upsert(newest, f"{path}/current", ["member_id"])


def current_balances(spark: SparkSession, path: str) -> DataFrame:
    """The balance per member of a table written by ``balance_stream``: its current rows, but for members changed since the last merge."""
    current, newest = _uncompacted(spark, path)
    if current is None:
        return newest.drop("batch")
    if newest.isEmpty():
        return current.drop("batch")
    return current.join(newest, "member_id", "left_anti").unionByName(newest).drop("batch")


def invitation_stream(bookings: DataFrame, members: DataFrame, spark: SparkSession, delay_minutes: int = 5,
                      out: str | None = None) -> DataFrame:
    """Invitations for agency bookings as they arrive: a join of the stream with the member table."""
    path = out or fresh_path(spark, "invitations")
    people = members.where(F.col("phone_e164").isNotNull()).select(F.col("id").alias("member_id"), "phone_e164")
    queue = bookings.where((F.col("channel") == "ota") & F.col("member_id").isNotNull()) \
        .join(people, "member_id") \
        .select(F.col("id").alias("booking_id"), "member_id", F.col("phone_e164").alias("to_phone"),
                later(F.col("booked_at"), mins=delay_minutes).alias("queued_at"))
    run_to_end(queue.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows"), f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows")
