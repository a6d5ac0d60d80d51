"""Balances kept up from new ledger rows alone.

The ledger grows by loads, each in a folder of its own. A refresh reads the loads since the last one, adds their sums to the
stored balances of the members they touch, and writes only the files these lie in. ``expiring_30d`` also moves with the
date: posted rows that expire after the window wait in a queue, in folders by the month they expire in, and a refresh takes
those that came into the window from the few months it has passed.

A refresh becomes visible by its log entry, one file that is written last. What an interrupted one has written is written over by
the next: queue folders carry the refresh's number, and stored balances the load they were last changed for.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stayledger.functions.scalars import later, moment, month_of
from stayledger.sources import merge
from stayledger.sources.tables import materialize

VALUES = ("balance_posted", "balance_pending", "expiring_30d")


@dataclass(frozen=True)
class Refresh:
    """The last completed refresh: its number, its moment, and the last load it has read."""

    number: int
    as_of: datetime
    load: int


def append_load(rows: DataFrame, ledger: str, load: int) -> None:
    """Add ledger rows as the folder of a load; a load that is written again replaces itself."""
    rows.write.mode("overwrite").parquet(f"{ledger.rstrip('/')}/load={load}")


def last_refresh(spark: SparkSession, folder: str) -> Refresh | None:
    try:
        log = spark.read.parquet(f"{folder}/log")
    except AnalysisException:
        return None
    found = log.orderBy(F.desc("number")).select("number", "as_of", "load").first()
    return None if found is None else Refresh(found.number, found.as_of, found.load)


def refresh(spark: SparkSession, folder: str, ledger: str, as_of: date | datetime) -> Refresh:
    """Bring the balances in ``folder`` up to all loads of the ledger and to ``as_of``, which never goes back."""
    last = last_refresh(spark, folder)
    now = _at(as_of)
    if last is not None and now < last.as_of:
        raise ValueError(f"balances stand at {last.as_of}; a refresh cannot go back to {now}")
    number, before = (0, -1) if last is None else (last.number + 1, last.load)
    loads = spark.read.parquet(ledger).where(F.col("load") > before)
    newest = loads.agg(F.max("load")).first()[0]
    load = before if newest is None else newest
    end = later(moment(as_of), days=30)

    waiting = (F.col("status") == "posted") & (F.col("expires_at") > end)
    loads.where(waiting).select("member_id", F.col("points_delta").cast("bigint").alias("points_delta"), "expires_at", month_of("expires_at").alias("month")) \
        .write.mode("overwrite").partitionBy("month").parquet(f"{folder}/queue/refresh={number}")

    posted = F.col("status") == "posted"
    fresh = loads.groupBy("member_id").agg(
        _sum(F.when(posted, F.col("points_delta"))).alias("balance_posted"),
        _sum(F.when(F.col("status") == "pending", F.col("points_delta"))).alias("balance_pending"),
        _sum(F.when(posted & (F.col("expires_at") <= end), F.col("points_delta"))).alias("expiring_30d"),
        F.max("occurred_at").alias("last_activity_at"))
    changes = fresh if last is None else fresh.unionByName(_due(spark, folder, last, as_of))
    changes = changes.groupBy("member_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in VALUES], F.max("last_activity_at").alias("last_activity_at"))
    _apply(spark, f"{folder}/balances", changes, number)

    done = Refresh(number, now, load)
    entry = spark.range(0, 1, 1, 1).select(F.lit(number).cast("long").alias("number"), moment(as_of).alias("as_of"), F.lit(load).cast("long").alias("load"))
    entry.write.mode("errorifexists").parquet(f"{folder}/log/refresh={number}")
    return done


def _at(as_of: date | datetime) -> datetime:
    return as_of if isinstance(as_of, datetime) else datetime(as_of.year, as_of.month, as_of.day)


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def _due(spark: SparkSession, folder: str, last: Refresh, as_of: date | datetime) -> DataFrame:
    """What came into the window since the last refresh; only the months in between are read."""
    start, end = later(moment(last.as_of), days=30), later(moment(as_of), days=30)
    queue = spark.read.schema("member_id bigint, points_delta bigint, expires_at timestamp_ntz, refresh int, month date") \
        .parquet(f"{folder}/queue").where(F.col("refresh") <= last.number)
    months = (F.col("month") >= month_of(start)) & (F.col("month") <= month_of(end))
    passed = queue.where(months & (F.col("expires_at") > start) & (F.col("expires_at") <= end))
    zero = F.lit(0).cast("bigint")
    return passed.select("member_id", zero.alias("balance_posted"), zero.alias("balance_pending"), F.col("points_delta").alias("expiring_30d"),
                         F.lit(None).cast("timestamp_ntz").alias("last_activity_at"))


def _apply(spark: SparkSession, path: str, changes: DataFrame, number: int) -> None:
    """Add the changes to the stored balances. A row that an interrupted run of this refresh has changed already is left."""
    changes = materialize(changes, "balance-changes")
    if number == 0:
        merge.upsert(changes.withColumn("refresh", F.lit(number)), path, ["member_id"])
        return
    stored = merge.read(spark, path)
    old = stored.select("member_id", F.struct(*VALUES, "last_activity_at", "refresh").alias("old"))
    met = changes.join(old, "member_id", "left").where(F.col("old").isNull() | (F.col("old.refresh") < number))
    total = [(F.col(c) + F.coalesce(f"old.{c}", F.lit(0))).cast("bigint").alias(c) for c in VALUES]
    source = met.select("member_id", *total, F.greatest("last_activity_at", "old.last_activity_at").alias("last_activity_at"), F.lit(number).alias("refresh"))
    merge.merge(source, path, ["member_id"])


def refreshed_balances(members: DataFrame, folder: str) -> DataFrame:
    """The balances of the last refresh, one row per member, as ``ledger.points_balances`` gives them."""
    held = merge.read(members.sparkSession, f"{folder}/balances").drop("refresh")
    people = members.select(F.col("id").alias("member_id"), "chain_group_id", "program_id")
    return people.join(held, "member_id", "left").fillna({c: 0 for c in VALUES})
