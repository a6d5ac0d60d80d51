"""Change capture against stored state: the last image of every record, and a log of what each snapshot changed.

The state is a stored table (``sources.merge``) with a record's key, a hash of its content and its image. A snapshot is
compared by key and hash alone, which are narrow columns; images are read and written as JSON only for the records that
differ, and the state is merged, so files without a changed record stay as they are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stayledger.functions.sizing import small
from stayledger.operators.access import Principal
from stayledger.operators.audit import ALL_CHANGES, AUDITED_TABLES
from stayledger.session import fresh_path
from stayledger.sources import merge
from stayledger.sources.tables import materialize
from stayledger.streaming.streams import run_to_end


def content_hash(schema: T.StructType) -> Column:
    """128 bits of a row's values; a null differs from every value and keeps its place, within arrays and structs too."""
    def value(f: T.StructField) -> Column:
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        return F.to_json(F.struct(f.name), {"ignoreNullFields": "false"}) if nested else F.col(f.name)

    values = [x for f in sorted(schema, key=lambda f: f.name) for x in (F.col(f.name).isNull(), value(f))]
    return F.struct(F.xxhash64(F.lit(1), *values).alias("a"), F.xxhash64(F.lit(2), *values).alias("b"))


def _json(image: str) -> Column:
    return F.to_json(image, {"ignoreNullFields": "false"})


def _state(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return merge.read(spark, f"{path}/state")
    except AnalysisException:
        return None


def capture(snapshot: DataFrame, path: str, number: int, table: str, actor: Principal, key: str = "id",
            actions: tuple[str, ...] | None = None, log_first: bool = False) -> None:
    """Log what ``snapshot`` changed since the last one and bring the state up to it.

    The log has the columns of ``audit.audit_diff``. The first snapshot is the base and is logged only on
    request. A snapshot that is captured again after a failure writes its log over; if the state had been merged
    by then, its log is complete and is left as it is.
    """
    spark = snapshot.sparkSession
    names = snapshot.columns
    now = snapshot.select(F.col(key).alias("record_id"), content_hash(snapshot.schema).alias("hash"), F.struct(*sorted(names)).alias("image"))
    state = _state(spark, path)
    if state is None:
        if log_first:
            _write_log(_logged(now.select("record_id", F.lit("insert").alias("action")), None, now, table, actor, actions, names), path, number)
        merge.create(now.withColumn("snapshot", F.lit(number)), f"{path}/state", ["record_id"])
        return
    changed = _changed(state, now, number)
    if changed.isEmpty():
        return
    _write_log(_logged(changed, state, now, table, actor, actions, names), path, number)
    moved = now.join(changed.where("action <> 'delete'").select("record_id"), "record_id", "left_semi").withColumn("gone", F.lit(False))
    gone = changed.where("action = 'delete'").select("record_id", F.lit(None).cast(now.schema["hash"].dataType).alias("hash"),
                                                     F.lit(None).cast(now.schema["image"].dataType).alias("image"), F.lit(True).alias("gone"))
    merge.merge(moved.unionByName(gone).withColumn("snapshot", F.lit(number)), f"{path}/state", ["record_id"], delete=F.col("gone"))


def _changed(state: DataFrame, now: DataFrame, number: int) -> DataFrame:
    """Keys of records that came, went or differ, by key and hash."""
    old = state.select("record_id", F.col("hash").alias("old"))
    both = old.join(now.select("record_id", F.col("hash").alias("new")), "record_id", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    return materialize(both.select("record_id", action.alias("action")), f"changed-{number}")


def _logged(changed: DataFrame, state: DataFrame | None, now: DataFrame, table: str, actor: Principal,
            actions: tuple[str, ...] | None, names: list[str]) -> DataFrame:
    kept = AUDITED_TABLES.get(table, ALL_CHANGES) if actions is None else actions
    wanted = small(changed.where(F.col("action").isin(list(kept))))
    chain = "chain_group_id" if "chain_group_id" in names else None

    def side(images: DataFrame, value: str, of_chain: str) -> DataFrame:
        owner = F.col(f"image.{chain}") if chain else F.lit(None).cast("string")
        return images.join(wanted, "record_id").select("record_id", "action", _json("image").alias(value), owner.alias(of_chain))

    after = side(now, "after_value", "_new_chain")
    if state is None:
        rows = after.withColumns({"before_value": F.lit(None).cast("string"), "_old_chain": F.col("_new_chain")})
    else:
        rows = side(state, "before_value", "_old_chain").join(after, ["record_id", "action"], "full")
    return rows.select(F.lit(actor.sub).cast("string").alias("actor_user_id"), F.lit(actor.role).cast("string").alias("actor_role"), "action",
                       F.lit(table).alias("table_name"), "record_id", F.coalesce("_new_chain", "_old_chain").alias("chain_group_id"),
                       "before_value", "after_value")


def _write_log(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/log/snapshot={number}")


def change_log(spark: SparkSession, path: str) -> DataFrame:
    """All logged changes, with the ``snapshot`` that brought them."""
    return spark.read.parquet(f"{path}/log")


def audit_stream(notices: DataFrame, table: str, actor: Principal, out: str | None = None, **options) -> DataFrame:
    """Capture snapshots as they are announced; gives the log.

    ``notices`` is a stream with one row per complete snapshot: its ``number`` and the ``folder`` it lies in. A batch holds few
    of them, which are taken in order; the snapshots themselves never pass through the stream.
    """
    spark = notices.sparkSession
    path = out or fresh_path(spark, f"changes-{table}")

    def take(batch: DataFrame, _: int) -> None:
        for r in batch.select("number", "folder").orderBy("number").collect():
            capture(batch.sparkSession.read.parquet(r.folder), path, r.number, table, actor, **options)

    run_to_end(notices.writeStream.foreachBatch(take), f"{path}/checkpoint")
    return change_log(spark, path)
