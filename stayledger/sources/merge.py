"""Stored tables that are changed by key: a merge rewrites only the files it touches.

A table is a folder of Parquet files and a manifest. The manifest names the files of one version with the range of keys
in each; it is written as a single file, last, and a reader takes the newest one. Files never change, so a reader
goes on with the version it began with, and a merge that fails leaves only files that no manifest names.

Rows are stored in ranges of the first key. A merge reads the manifest, finds the files whose range holds a key of the
source, joins those files with the source, and writes their rows anew; every other file is carried over by name. Merging a
day's changes of members thus costs in proportion to the files they lie in, not to the table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stayledger.functions.sizing import tasks
from stayledger.sources.tables import materialize

#: Aim for the rows of a file; a merge keeps about this size when it writes files anew.
FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class Merged:
    """What a merge did: the new version, and its files by what became of them."""

    version: int
    kept: int
    rewritten: int
    written: int


def _manifests(path: str) -> str:
    return f"{path.rstrip('/')}/manifest"


def _newest(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    every = spark.read.parquet(_manifests(path))
    version = every.agg(F.max("version")).first()[0]
    return version, every.where((F.col("version") == version) & F.col("file").isNotNull()).drop("version")


def _commit(files: DataFrame, path: str, version: int) -> None:
    """One manifest file, so that a version appears whole; a second writer of the same version fails.

    A row without a file marks the version, which may have none.
    """
    mark = files.sparkSession.range(0, 1, 1, 1).select(*[F.lit(None).cast(kind).alias(c) for c, kind in files.dtypes])
    files.unionByName(mark).coalesce(1).write.mode("errorifexists").parquet(f"{_manifests(path)}/version={version}")


def _write(rows: DataFrame, path: str, keys: list[str], file_rows: int) -> DataFrame:
    """Write ``rows`` as new files in ranges of the first key; gives their names, ranges and sizes."""
    spark, folder = rows.sparkSession, f"{path.rstrip('/')}/data/{uuid.uuid4().hex}"
    # Formed once: they are counted, sampled for the ranges and dealt out.
    rows = materialize(rows, "merge-rows")
    rows.repartitionByRange(tasks(spark, rows.count()), *keys).sortWithinPartitions(*keys) \
        .write.option("maxRecordsPerFile", file_rows).parquet(folder)
    return _described(spark.read.schema(rows.schema).parquet(folder), keys[0])


def _described(stored: DataFrame, key: str) -> DataFrame:
    """The files of ``stored``, each sorted by ``key``: file, low, high, rows.

    Nulls come first in a file, so its ends are the row after them and the last one. Only those are compared: the least and
    greatest of a text column over all rows would sort every row by its file.
    """
    file, at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("_at")
    sizes = stored.groupBy(file).agg(F.count("*").alias("rows"), F.count(key).alias("_filled"))
    ends = stored.select(file, at, F.col(key).alias("_key")).join(F.broadcast(sizes), "file") \
        .where((F.col("_at") == F.col("rows") - F.col("_filled")) | (F.col("_at") == F.col("rows") - 1))
    return ends.groupBy("file").agg(F.min("_key").alias("low"), F.max("_key").alias("high"), F.max("rows").alias("rows"))


def create(rows: DataFrame, path: str, keys: list[str], file_rows: int = FILE_ROWS) -> None:
    """Store ``rows``, whose ``keys`` are unique, as version 0 of a table."""
    _commit(_write(rows, path, keys, file_rows), path, 0)


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files of the newest version: file, low, high, rows."""
    return _newest(spark, path)[1]


def _scan(spark: SparkSession, names: list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def _schema(spark: SparkSession, path: str, manifest: DataFrame) -> T.StructType:
    """Of a file of the version; of any file ever written where it has none."""
    first = manifest.select("file").first()
    return spark.read.parquet(first[0] if first else f"{path.rstrip('/')}/data/*").schema


def read(spark: SparkSession, path: str) -> DataFrame:
    """The newest version."""
    manifest = files(spark, path)
    return _scan(spark, [r.file for r in manifest.select("file").collect()], _schema(spark, path, manifest))


def read_ranges(spark: SparkSession, path: str, key: str, ranges: list[tuple]) -> DataFrame:
    """The rows of the newest version whose first ``key`` lies in one of the ranges, ends included, from the files that meet them."""
    manifest = files(spark, path)
    meets = reduce(or_, [(F.col("high") >= F.lit(a)) & (F.col("low") <= F.lit(b)) for a, b in ranges])
    inside = reduce(or_, [F.col(key).between(a, b) for a, b in ranges])
    return _scan(spark, [r.file for r in manifest.where(meets).select("file").collect()], _schema(spark, path, manifest)).where(inside)


def _touched(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """The files whose range holds a key; ``keys`` (key, piece) is dealt out by ranges.

    The ranges of the pieces, as many as shuffle partitions, meet those of the files first; a key is then
    compared only with the files that meet its piece, where it is read.
    """
    spans = keys.groupBy(F.col("piece").alias("span")).agg(F.min("key").alias("from"), F.max("key").alias("to"))
    near = manifest.join(F.broadcast(spans), (F.col("low") <= F.col("to")) & (F.col("high") >= F.col("from"))).select("file", "low", "high", "span")
    holds = (F.col("span") == F.col("piece")) & (F.col("key") >= F.col("low")) & (F.col("key") <= F.col("high"))
    return keys.join(F.broadcast(near), holds).select("file").distinct()


def merge(source: DataFrame, path: str, keys: list[str], update: list[str] | None = None, insert: bool = True,
          delete: Column | None = None, file_rows: int = FILE_ROWS) -> Merged:
    """Bring the rows of ``source`` into the table as its next version.

    A stored row with the keys of a source row takes the source's values of the ``update`` columns (all that both have,
    if not given; none for an empty list), or goes where ``delete``, a condition on the source's columns, holds. Source rows without
    a partner are added if ``insert`` says so, unless ``delete`` holds. Of several source rows with equal keys the one that
    sorts first by its other columns counts. A null in a key has no partner: such rows are added as they are.
    Columns the source lacks are null in added rows.
    """
    spark = source.sparkSession
    version, manifest = _newest(spark, path)
    schema = _schema(spark, path, manifest)
    names = schema.fieldNames()
    shared = [c for c in names if c in source.columns and c not in keys]
    set_to = shared if update is None else update
    goes = F.lit(False) if delete is None else F.coalesce(delete, F.lit(False))

    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull()
    # Formed once: every step below reads it again.
    source = materialize(source.select(*keys, *shared, goes.alias("_goes")), "merge-source")
    keyed = source.where(full)

    stored = {r.file: r.rows for r in manifest.select("file", "rows").collect()}
    every = list(stored)
    # With a single file there is nothing to choose. A key that many rows have is looked for once.
    if len(every) < 2:
        hit = every
    else:
        first = keyed.select(F.col(keys[0]).alias("key")).distinct().repartitionByRange("key").withColumn("piece", F.spark_partition_id())
        hit = [r.file for r in _touched(manifest, materialize(first, "merge-keys")).collect()]
    # Both sides are dealt out alike, by their number of rows.
    n = tasks(spark, sum(stored[x] for x in hit) + source.count())
    values = F.struct(*shared, "_goes")
    one = keyed.repartition(n, *keys).groupBy(*keys).agg(F.min(values).alias("_new"))
    old = _scan(spark, hit, schema)
    old = old.select(*keys, F.struct(*names).alias("_old")).repartition(n, *keys)
    # With no rows to add, the source's strangers need not travel.
    both = old.join(one, keys, "full" if insert else "left")
    kept = both.where(F.coalesce(~F.col("_new._goes"), F.lit(True)))
    stays = F.col("_old").isNotNull()

    def column(f: T.StructField) -> Column:
        if f.name in keys:
            return F.col(f.name)
        added = F.col(f"_new.{f.name}").cast(f.dataType) if f.name in shared else F.lit(None).cast(f.dataType)
        changed = F.when(F.col("_new").isNotNull(), added).otherwise(F.col(f"_old.{f.name}")) if f.name in set_to else F.col(f"_old.{f.name}")
        return F.when(stays, changed).otherwise(added).alias(f.name)

    # Keys that are null in the stored row are null in the joined one as well.
    rows = kept.select(*[column(f) for f in schema])
    if insert:
        loose = source.where(~full & ~F.col("_goes"))
        rows = rows.unionByName(loose.select(*[F.col(c) if c in source.columns else F.lit(None).cast(schema[c].dataType).alias(c) for c in names]))
    untouched = manifest.join(F.broadcast(spark.createDataFrame([(x,) for x in hit], "file string")), "file", "left_anti") if hit else manifest
    _commit(untouched.select("file", "low", "high", "rows").unionByName(_write(rows, path, keys, file_rows)), path, version + 1)
    kept_files = len(every) - len(hit)
    return Merged(version + 1, kept_files, len(hit), files(spark, path).count() - kept_files)


def upsert(source: DataFrame, path: str, keys: list[str], **options) -> Merged:
    """``merge``, or ``create`` where the table does not exist yet."""
    try:
        source.sparkSession.read.parquet(_manifests(path))
    except AnalysisException:
        rest = [c for c in source.columns if c not in keys]
        one = source.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_new")).select(*keys, "_new.*") if rest else source.distinct()
        create(one.select(*source.columns), path, keys, options.get("file_rows", FILE_ROWS))
        return Merged(0, 0, 0, files(source.sparkSession, path).count())
    return merge(source, path, keys, **options)


def unreferenced(spark: SparkSession, path: str, keep_versions: int = 1) -> DataFrame:
    """Files that none of the newest ``keep_versions`` versions names and an older one does: what may be deleted."""
    every = spark.read.parquet(_manifests(path))
    newest = every.agg(F.max("version")).first()[0]
    live = every.where(F.col("version") > newest - keep_versions).select("file")
    return every.where("file IS NOT NULL").select("file").distinct().join(live, "file", "left_anti")
