"""Tenant scoping: row filters that a report's base tables pass through before aggregation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

PLATFORM_ADMIN = "platform_admin"
ROLES = (PLATFORM_ADMIN, "chain_admin", "hotel_staff", "analyst")


@dataclass(frozen=True)
class Principal:
    """The caller. Any field may be missing, as in an incomplete set of claims."""

    role: str | None = None
    chain_id: object = None
    hotel_ids: tuple = field(default_factory=tuple)
    sub: object = None

    @classmethod
    def from_claims(cls, claims: str | None, key=str) -> "Principal":
        """Read the caller from JSON claims; empty strings count as missing.

        ``key`` turns a claim into the type of the table keys (``int`` for numeric keys).
        """
        if not claims:
            return cls()
        found = json.loads(claims)

        def value(name):
            v = found.get(name)
            return None if v in (None, "") else v

        role, chain, sub = value("app_role"), value("chain_group_id"), value("sub")
        if role is not None and role not in ROLES:
            raise ValueError(f"unknown role {role!r}")
        return cls(role, None if chain is None else key(chain),
                   tuple(key(h) for h in found.get("hotel_ids") or ()), None if sub is None else key(sub))


def is_admin(p: Principal) -> Column:
    """True or false for a known role, unknown (NULL) without one."""
    return F.lit(None).cast("boolean") if p.role is None else F.lit(p.role == PLATFORM_ADMIN)


def can_access_chain(p: Principal, chain: Column) -> Column:
    """Administrators, or callers of that chain; a matching chain suffices even without a role."""
    own = F.lit(None).cast("boolean") if p.chain_id is None else chain == F.lit(p.chain_id)
    return is_admin(p) | own


def can_access_hotel(p: Principal, chain: Column, hotel: Column) -> Column:
    """As for the chain, but hotel staff see only the hotels assigned to them.

    Without a role the staff test is unknown, so only an assigned hotel gives access.
    """
    own = F.lit(None).cast("boolean") if p.chain_id is None else chain == F.lit(p.chain_id)
    not_staff = F.lit(None).cast("boolean") if p.role is None else F.lit(p.role != "hotel_staff")
    assigned = hotel.isin(list(p.hotel_ids)) if p.hotel_ids else F.lit(False)
    return is_admin(p) | (own & (not_staff | assigned))


def scope_by_chain(df: DataFrame, p: Principal, chain: str = "chain_group_id") -> DataFrame:
    return df.where(can_access_chain(p, F.col(chain)))


def scope_by_hotel(df: DataFrame, p: Principal, chain: str = "chain_group_id", hotel: str = "hotel_id") -> DataFrame:
    return df.where(can_access_hotel(p, F.col(chain), F.col(hotel)))


def scope_by_parent(child: DataFrame, visible_parent: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Child rows whose parent the caller can see; pass the parent already scoped."""
    return child.join(visible_parent.select(F.col(key).alias(column)), column, "left_semi")


def scope_admin_users(admin_users: DataFrame, p: Principal) -> DataFrame:
    """The caller's own row plus those of the chains the caller can access."""
    own = F.lit(None).cast("boolean") if p.sub is None else F.col("id") == F.lit(p.sub)
    return admin_users.where(own | is_admin(p) | can_access_chain(p, F.col("chain_group_id")))


def scope_editable_admin_users(admin_users: DataFrame, p: Principal) -> DataFrame:
    """Admin rows the caller may change: administrators all, chain admins those of their chain."""
    chain_admin = F.lit(None).cast("boolean") if p.role is None else F.lit(p.role == "chain_admin")
    return admin_users.where(is_admin(p) | (chain_admin & can_access_chain(p, F.col("chain_group_id"))))


def scope_audit_log(log: DataFrame, p: Principal) -> DataFrame:
    """System entries without a chain are for administrators only."""
    chain = F.col("chain_group_id")
    return log.where(is_admin(p) | (chain.isNotNull() & can_access_chain(p, chain)))


def scope_imports(imports: DataFrame, p: Principal) -> DataFrame:
    """Imports without a chain are for administrators only."""
    chain = F.col("chain_group_id")
    return imports.where((chain.isNull() & is_admin(p)) | can_access_chain(p, chain))


# How each table is scoped: by its own chain or hotel, through a parent, or openly.
CHAIN_SCOPED = ("loyalty_programs", "tiers", "points_rules", "rewards", "members", "point_transactions",
                "point_redemptions", "communication_templates", "communications", "segments", "campaigns",
                "automations")
HOTEL_SCOPED = ("bookings", "transactions")
PARENT_SCOPED = {
    "hotel_pms_connections": ("hotel_id", "hotels"), "room_stays": ("hotel_id", "hotels"),
    "booking_segments": ("booking_id", "bookings"), "booking_status_history": ("booking_id", "bookings"),
    "transaction_lines": ("transaction_id", "transactions"),
    "tier_thresholds": ("tier_id", "tiers"), "tier_benefits": ("tier_id", "tiers"),
    "member_external_ids": ("member_id", "members"), "member_consents": ("member_id", "members"),
    "member_tier_history": ("member_id", "members"), "member_attributes": ("member_id", "members"),
    "campaign_recipients": ("campaign_id", "campaigns"), "automation_steps": ("automation_id", "automations"),
    "automation_runs": ("automation_id", "automations"),
    "pms_raw_payloads": ("import_id", "pms_imports"), "pms_sync_errors": ("import_id", "pms_imports"),
}
OPEN_TABLES = ("currencies", "regions", "pms_systems", "currency_rates")


def scope_table(name: str, frames: dict[str, DataFrame], p: Principal) -> DataFrame:
    """The rows of one table that the caller can see; parents are scoped first."""
    df = frames[name]
    if name in OPEN_TABLES:
        return df
    if name == "chain_groups":
        return scope_by_chain(df, p, "id")
    if name == "hotels":
        return scope_by_hotel(df, p, "chain_group_id", "id")
    if name in CHAIN_SCOPED:
        return scope_by_chain(df, p)
    if name in HOTEL_SCOPED:
        return scope_by_hotel(df, p)
    if name in PARENT_SCOPED:
        column, parent = PARENT_SCOPED[name]
        return scope_by_parent(df, scope_table(parent, frames, p), column)
    if name == "admin_users":
        return scope_admin_users(df, p)
    if name == "admin_user_hotel_assignments":
        users = frames["admin_users"]
        if p.role == PLATFORM_ADMIN:
            return df
        return scope_by_parent(df, scope_by_chain(users, p), "admin_user_id")
    if name == "audit_log":
        return scope_audit_log(df, p)
    if name == "pms_imports":
        return scope_imports(df, p)
    raise KeyError(f"no access rule for table {name!r}")


def scope_tables(frames: dict[str, DataFrame], p: Principal) -> dict[str, DataFrame]:
    """Scope every table at once, to feed a report with what its caller may see."""
    return {name: scope_table(name, frames, p) for name in frames}
