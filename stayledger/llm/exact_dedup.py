"""Exact dedup by skew-safe combining.

Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]`` becomes one space (a null text is
empty). Copies are combined in three stages, each of which groups by the whole text besides its digest: within the
task that reads them, among the rows of a digest with one salt, and among the salts' winners. A text that a third
of all rows share thus reaches one task as at most ``SALTS`` rows per salted task. Each document then looks
its group up by digest; should two texts ever share a digest, by the text as well.

The smallest doc_id of a group stays; null ids come last, and a group without any id keeps null. Rows that repeat
an id with an equal text count for the group's size and share one verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stayledger.session import fresh_path

SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def copies(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("content")) \
        .withColumn("digest", digest(F.col("content")))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts))
    salted = rows.groupBy("digest", salt.alias("salt"), "content").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = salted.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    brief = groups.select("digest", "keep_id", "group_size")
    place = fresh_path(spark, "exact-groups")
    brief.write.parquet(place)
    found = spark.read.schema(brief.schema).parquet(place)
    if found.groupBy("digest").count().where("count > 1").isEmpty():
        joined = rows.select("doc_id", "digest").join(found, "digest")
    else:
        joined = rows.join(groups, ["digest", "content"])
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                         F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay."""
    kept = copies(docs).where("kept").select(F.col("doc_id").alias("_keep"), "text_sha256").distinct()
    digest = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"),
                       digest.alias("_digest"))
    same = F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_digest") == F.col("text_sha256"))
    return mine.join(kept, same, "left_semi").select("_row.*")
