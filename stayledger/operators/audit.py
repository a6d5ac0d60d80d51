"""Change capture between two snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stayledger.operators.access import Principal

# Audited tables with the changes that are logged for them.
ALL_CHANGES = ("insert", "update", "delete")
AUDITED_TABLES = {
    "members": ALL_CHANGES, "member_tier_history": ("insert",), "bookings": ALL_CHANGES, "tiers": ALL_CHANGES,
    "tier_thresholds": ALL_CHANGES, "tier_benefits": ALL_CHANGES, "points_rules": ALL_CHANGES,
    "admin_users": ALL_CHANGES, "admin_user_hotel_assignments": ALL_CHANGES,
}


def _json(column: str) -> Column:
    return F.to_json(column, {"ignoreNullFields": "false"})


def _changes(before: DataFrame, after: DataFrame, key: str, relevant: Column | None) -> DataFrame:
    """Pairs of old and new rows that differ, by one full join on the key.

    The full rows travel once as structs. ``relevant`` is tested on either side.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        test = F.lit(True) if relevant is None else F.coalesce(relevant, F.lit(False))
        return df.select(F.col(key).alias("record_id"), F.struct(*sorted(df.columns)).alias(name),
                         test.alias(f"_{name}_relevant"))

    both = side(before, "old").join(side(after, "new"), "record_id", "full_outer")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    same_shape = sorted(before.dtypes) == sorted(after.dtypes) and "map<" not in str(after.dtypes)
    same = F.col("old").eqNullSafe(F.col("new")) if same_shape else _json("old") == _json("new")
    differs = F.col("old").isNull() | F.col("new").isNull() | ~same
    touched = F.coalesce("_old_relevant", F.lit(False)) | F.coalesce("_new_relevant", F.lit(False))
    return both.where(touched & differs).withColumn("action", action)


def audit_diff(before: DataFrame, after: DataFrame, table: str, actor: Principal, key: str = "id",
               actions: tuple[str, ...] | None = None, relevant: Column | None = None) -> DataFrame:
    """One log row per inserted, changed or deleted record, with both states as JSON.

    ``actions`` defaults to those of the audited-tables list. The chain is that of the
    new state, of the old one for deletions, and NULL for tables without a chain.
    """
    kept = AUDITED_TABLES.get(table, ALL_CHANGES) if actions is None else actions
    rows = _changes(before, after, key, relevant).where(F.col("action").isin(list(kept)))
    chain = F.coalesce("new.chain_group_id", "old.chain_group_id") if "chain_group_id" in after.columns \
        else F.lit(None).cast("string")
    return rows.select(
        F.lit(actor.sub).cast("string").alias("actor_user_id"), F.lit(actor.role).cast("string").alias("actor_role"), "action",
        F.lit(table).alias("table_name"), "record_id", chain.alias("chain_group_id"),
        _json("old").alias("before_value"), _json("new").alias("after_value"))


def audit_manual_points(before: DataFrame, after: DataFrame, actor: Principal, key: str = "id") -> DataFrame:
    """Changes of manual point adjustments only; a new one is logged as ``manual_adjust``."""
    manual = F.col("type") == "manual_adjustment"
    rows = audit_diff(before, after, "point_transactions", actor, key, ALL_CHANGES, manual)
    return rows.withColumn("action", F.when(F.col("action") == "insert", "manual_adjust").otherwise(F.col("action")))


def audit_all(before: dict[str, DataFrame], after: dict[str, DataFrame], actor: Principal) -> dict[str, DataFrame]:
    """The audit rows of every audited table present in both snapshots, manual points included."""
    logs = {t: audit_diff(before[t], after[t], t, actor) for t in AUDITED_TABLES if t in before and t in after}
    if "point_transactions" in before and "point_transactions" in after:
        logs["point_transactions"] = audit_manual_points(before["point_transactions"],
                                                         after["point_transactions"], actor)
    return logs
