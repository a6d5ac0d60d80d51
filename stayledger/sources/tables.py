"""Table reading and writing: scans, appends, full reloads, insert-ignore, updates and snapshots."""

from __future__ import annotations

import time
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from stayledger.functions.scalars import month_of
from stayledger.functions.sizing import is_small
from stayledger.session import fresh_path


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A columnar scan with an explicit schema, never inferred from values."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_since(spark: SparkSession, path: str, business_date: str, since: date,
               schema: T.StructType | None = None) -> DataFrame:
    """The rows from ``since`` on of a table kept in month folders; earlier folders are not read.

    For the reports that look back a year from a given day.
    """
    rows = read_table(spark, path, None if schema is None else T.StructType([*schema.fields, T.StructField("month", T.DateType())]))
    return rows.where((F.col("month") >= F.lit(since.replace(day=1))) & (F.col(business_date) >= F.lit(since))).drop("month")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small inline relation, e.g. a lookup table."""
    return spark.createDataFrame(rows, schema)


def _by_month(df: DataFrame, business_date: str | None) -> tuple[DataFrame, list[str]]:
    if business_date is None:
        return df.hint("rebalance"), []
    # Rebalancing cuts a large month into several files and merges small ones.
    return df.withColumn("month", month_of(business_date)).hint("rebalance", "month"), ["month"]


def append(df: DataFrame, path: str, business_date: str | None = None) -> None:
    """Add rows to a table, in month folders if it has a business date."""
    rows, folders = _by_month(df, business_date)
    rows.write.mode("append").partitionBy(*folders).parquet(path)


def reload(df: DataFrame, path: str, business_date: str | None = None) -> None:
    """Replace the whole content of a table."""
    rows, folders = _by_month(df, business_date)
    rows.write.mode("overwrite").partitionBy(*folders).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back.

    For a result that several steps read and that is costly to form, such as parsed
    feeds. The written table also ends the lineage: a lost executor repeats no parsing.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def insert_ignore(batch: DataFrame, target: DataFrame | None, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``batch`` to add to ``target`` when the first writer of a key wins.

    Within the batch the row first in ``order``, then in all other columns, is kept, so
    the choice does not depend on the partitioning. Copies are reduced before the
    shuffle. Rows with a NULL in the key never collide and are all kept.
    """
    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(k).isNotNull()
    rest = [c for c in batch.columns if c not in keys]
    ranked = [c for c in order if c in rest] + [c for c in rest if c not in order]
    if ranked:
        first = batch.where(has_key).groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_first"))
        kept = first.select(*keys, "_first.*").select(*batch.columns)
    else:
        kept = batch.where(has_key).distinct()
    if target is not None:
        kept = kept.join(target.select(*keys), keys, "left_anti")
    return kept.unionByName(batch.where(~has_key))


def update_from(df: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` replaced by the values of the matching ``source`` row, if there is one.

    Each row of ``df`` changes once: of several source rows with a key the one that sorts first by ``columns`` is taken.
    """
    one = source.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_new"))
    new = one.select(*keys, *[F.col("_new")[c].alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = df.join(new, keys, "left")
    set_to = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(set_to).select(*df.columns)


def hash_pick(df: DataFrame, choices: DataFrame, group: str, key: str = "id", out: str = "picked_id") -> DataFrame:
    """Give each row one choice of its group: the one with the lowest md5 of both keys.

    ``choices`` is a dimension. Its ids are met as one array per group and compared within the row,
    so no row per combination is formed. Up to the size limit the arrays are broadcast, beyond it they are joined by group.
    """
    lists = choices.groupBy(group).agg(F.sort_array(F.collect_list("id")).alias("_ids"))
    lists = F.broadcast(lists) if is_small(choices) else lists

    def scored(c: Column) -> Column:
        return F.struct(F.md5(F.concat(F.col(key).cast("string"), c.cast("string"))).alias("h"), c.alias("id"))

    lowest = F.array_min(F.transform("_ids", scored))
    return df.join(lists, group, "left").withColumn(out, lowest["id"]).drop("_ids")


def numbered(df: DataFrame, key: str, out: str = "position", pieces: int | None = None) -> DataFrame:
    """Add the 1-based position of each row in the order of the unique ``key`` of any sortable type.

    The rows are dealt out by ranges of the key, into as many pieces as the session has shuffle partitions or as
    asked for, and written; they are numbered within a piece and shifted by the sizes of the pieces before
    it, so no task sorts the whole table.
    """
    ranged = df.repartitionByRange(key) if pieces is None else df.repartitionByRange(pieces, key)
    rows = materialize(ranged.withColumn("_piece", F.spark_partition_id()), "numbered")
    sizes = rows.groupBy("_piece").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy("_piece").orderBy(key))
    return rows.withColumn("_rn", within).join(shifts, "_piece") \
        .withColumn(out, (F.col("_rn") + F.col("_shift")).cast("bigint")).drop("_piece", "_rn", "_shift")


def months_between(spark: SparkSession, first: date, last: date) -> DataFrame:
    """The first days of all months from ``first`` to ``last``."""
    span = F.sequence(F.lit(first), F.lit(last), F.make_ym_interval(F.lit(0), F.lit(1)))
    return spark.range(1).select(F.explode(span).alias("month"))


def save_snapshot(df: DataFrame, folder: str, as_of: date) -> str:
    """Write a dated snapshot, e.g. of the balances.

    Each refresh of a day gets a version of its own, which appears when it is complete, so
    readers keep the version they started with. Old versions are left to the caller.
    """
    path = f"{folder.rstrip('/')}/as_of={as_of.isoformat()}/version={time.time_ns()}"
    df.hint("rebalance").write.mode("errorifexists").parquet(path)
    return path


def load_snapshot(spark: SparkSession, folder: str, as_of: date) -> DataFrame:
    """The newest version of the snapshot of a day; only that version's files are read."""
    versions = spark.read.parquet(f"{folder.rstrip('/')}/as_of={as_of.isoformat()}")
    newest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == newest).drop("version")
