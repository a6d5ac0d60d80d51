"""Named queries on the tables with scopes of their own, and on the change log of all audited tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stayledger.operators import access, audit
from stayledger.operators.access import PLATFORM_ADMIN, Principal
from stayledger.plans.registry import query

# --- tables with scopes of their own ----------------------------------------------

#: Who looks, and which chain that lets them see ("all", a number, or none).
_CALLERS = {"platform": (Principal(PLATFORM_ADMIN), "all"), "chain admin": (Principal("chain_admin", 1, sub=140), 1),
            "chain without role": (Principal(None, 3), 3), "nobody": (Principal(), None)}
_TABLES = ("admin_users", "admin_user_hotel_assignments", "audit_log", "pms_imports", "pms_sync_errors")
_CHAIN_SQL = {
    "admin_users": "SELECT id, chain_group_id AS chain FROM {admin_users}",
    "admin_user_hotel_assignments": "SELECT a.id, u.chain_group_id AS chain FROM {admin_user_hotel_assignments} a JOIN {admin_users} u ON u.id = a.admin_user_id",
    "audit_log": "SELECT id, chain_group_id AS chain FROM {audit_log}", "pms_imports": "SELECT id, chain_group_id AS chain FROM {pms_imports}",
    "pms_sync_errors": "SELECT e.id, i.chain_group_id AS chain FROM {pms_sync_errors} e JOIN {pms_imports} i ON i.id = e.import_id",
}


def _scopes_sql() -> str:
    parts = []
    for table in _TABLES:
        for caller, (p, chain) in _CALLERS.items():
            seen = "true" if chain == "all" else "false" if chain is None else f"chain = {chain}"
            if table == "admin_users" and p.sub is not None:
                seen += f" OR id = {p.sub}"
            parts.append(f"SELECT '{table}' AS table_name, '{caller}' AS caller, count(*) AS visible, min(id) AS first_id, max(id) AS last_id "
                         f"FROM ({_CHAIN_SQL[table]}) t WHERE {seen}")
    return "\nUNION ALL ".join(parts)


@query("scope_special_tables", _scopes_sql())
def scope_special_tables(f):
    frames = {t: f.frame(t) for t in _TABLES}
    seen = [access.scope_table(t, frames, p).agg(F.count("*").alias("visible"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
            .select(F.lit(t).alias("table_name"), F.lit(caller).alias("caller"), "visible", "first_id", "last_id")
            for t in _TABLES for caller, (p, _) in _CALLERS.items()]
    return reduce(DataFrame.unionByName, seen)


@query("scope_editable_admin_users", """
SELECT 'platform' AS caller, id AS admin_user_id FROM {admin_users} UNION ALL SELECT 'chain admin', id FROM {admin_users} WHERE chain_group_id = 1""")
def scope_editable_admin_users(f):
    seen = [access.scope_editable_admin_users(f.admin_users, p).select(F.lit(caller).alias("caller"), F.col("id").alias("admin_user_id"))
            for caller, (p, _) in _CALLERS.items()]
    return reduce(DataFrame.unionByName, seen)


# --- the change log of all audited tables -----------------------------------------

@query("audit_tables", """
WITH log AS (
  SELECT 'members' AS table_name, id, chain_group_id, CASE WHEN id % 9 = 0 THEN 'insert' WHEN id % 10 = 0 THEN 'delete' ELSE 'update' END AS action FROM {members}
    WHERE (id % 9 = 0 AND id % 10 <> 0) OR (id % 9 <> 0 AND id % 10 = 0) OR (id % 9 <> 0 AND id % 10 <> 0 AND id % 6 = 0 AND city <> 'moved')
  UNION ALL SELECT 'tiers', id, chain_group_id, 'update' FROM {tiers} WHERE sort_order = 5
  UNION ALL SELECT 'points_rules', id, NULL, 'delete' FROM {points_rules} WHERE id % 1000 = 9
  UNION ALL SELECT 'member_tier_history', id, NULL, 'insert' FROM {members} WHERE id % 4 = 1
  UNION ALL SELECT 'point_transactions', id, chain_group_id, 'manual_adjust' FROM {event_ledger} WHERE type = 'manual_adjustment' AND points_delta >= 50)
SELECT table_name, action, chain_group_id, 'u1' AS actor_user_id, count(*) AS changes, min(id) AS first_id, max(id) AS last_id FROM log GROUP BY ALL""")
def audit_tables(f):
    """Two states of five audited tables; tier history is logged for additions alone, and points for manual ones."""
    rules = f.points_rules.drop("silver_multiplier")
    tiers = f.tiers.select("id", "chain_group_id", "program_id", "code", "sort_order", "multiplier_default")
    history = f.members.select("id", F.col("id").alias("member_id"), F.col("current_tier_id").alias("to_tier_id"))
    before = {"members": f.members.where("id % 9 <> 0"), "tiers": tiers, "points_rules": rules, "member_tier_history": history.where("id % 4 <> 1"),
              "point_transactions": f.event_ledger.where("points_delta < 50")}
    after = {"members": f.members.where("id % 10 <> 0").withColumn("city", F.when(F.col("id") % 6 == 0, "moved").otherwise(F.col("city"))),
             "tiers": tiers.withColumn("multiplier_default", F.when(F.col("sort_order") == 5, F.lit(9).cast("decimal(5,2)")).otherwise(F.col("multiplier_default"))),
             "points_rules": rules.where("id % 1000 <> 9"), "member_tier_history": history.where("id % 8 <> 2"), "point_transactions": f.event_ledger}
    logs = audit.audit_all(before, after, Principal("chain_admin", 1, sub="u1"))
    every = [log.select("table_name", "action", F.col("chain_group_id").cast("bigint").alias("chain_group_id"), "actor_user_id", "record_id") for log in logs.values()]
    return reduce(DataFrame.unionByName, every).groupBy("table_name", "action", "chain_group_id", "actor_user_id") \
        .agg(F.count("*").alias("changes"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"))
