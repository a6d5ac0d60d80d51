"""The loyalty data model: tables, column types, keys, references, allowed values and checks.

A table is one line of column names. Types follow from the naming rules below, or from
an explicit ``name:type``; a trailing ``?`` marks a nullable column. ``<thing>_id``
refers to the table of things, a ``code`` of a catalog to that catalog.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stayledger.functions.scalars import full_name, nights

MONEY, RATE, PERCENT = "decimal(14,2)", "decimal(14,6)", "decimal(5,2)"

# Naming rules, first match wins: (suffix or prefix test, type).
_RULES = [
    (lambda n: n.endswith("_at"), "timestamp_ntz"),
    (lambda n: n.endswith("_date") or n in ("valid_from", "valid_to"), "date"),
    (lambda n: n.startswith(("is_", "has_")), "boolean"),
    (lambda n: n.endswith(("_amount", "_revenue")) or n in ("min_value",), MONEY),
    (lambda n: n.endswith("_percent") or n.startswith("percent_"), PERCENT),
    (lambda n: n.endswith(("_count", "_order", "_index", "_months", "_points")) or n.startswith("num_")
        or n.startswith("rows_") or n in ("nights", "priority", "points_spent"), "int"),
    (lambda n: n == "points_delta", "bigint"),
]

# Tables with their columns.
TABLES: dict[str, str] = {
    "currencies": "code name symbol? decimals:int",
    "regions": "code name default_currency?",
    "pms_systems": "code display_name vendor_url?",
    "chain_groups": "id slug? name status default_currency reporting_currency default_locale? headquarters_country?",
    "hotels": "id chain_group_id slug? name brand_property_code? status city? country_code? timezone? "
              "latitude:decimal(9,6)? longitude:decimal(9,6)? room_count? opening_date? default_currency default_pms?",
    "hotel_pms_connections": "id? hotel_id pms_code external_property_id external_program_id? is_active",
    "currency_rates": "from_ccy to_ccy rate_date rate:decimal(14,6)",
    "loyalty_programs": "id chain_group_id slug? name? points_currency points_expiry_months? is_active?",
    "tiers": "id program_id chain_group_id code name sort_order multiplier_default:decimal(5,2) is_default_initial",
    "tier_thresholds": "id? tier_id metric min_value qualifying_period_months valid_from valid_to?",
    "tier_benefits": "id tier_id benefit_key label description? value? is_active sort_order",
    "points_rules": "id program_id chain_group_id? hotel_id? channel? market_segment_code? rate_group_code? "
                    "percent_of_payment tier_multiplier_override:map<string,decimal(8,4)>? priority valid_from valid_to? is_active",
    "rewards": "id program_id chain_group_id? code name reward_type? cost_points min_tier_id? hotel_id? "
               "inventory_remaining:int? valid_from? valid_to? is_active",
    "members": "id chain_group_id program_id member_number? first_name? last_name? full_name? email? phone_e164? "
               "birth_date? gender country_code? city? joined_at status current_tier_id? recruitment_source? "
               "recruitment_hotel_id? recruited_via_ota:boolean external_membership_raw?",
    "member_external_ids": "id? member_id id_type id_value is_valid valid_from:timestamp_ntz?",
    "member_consents": "id? member_id consent_type granted:boolean granted_at source?",
    "member_tier_history": "id? member_id from_tier_id? to_tier_id change_reason effective_at",
    "member_attributes": "id? member_id attr_key attr_value source? set_at",
    "bookings": "id chain_group_id hotel_id member_id? pms_code pms_reservation_no pms_confirmation_code? channel status "
                "arrival_date departure_date check_in_at? check_out_at? nights num_rooms? total_amount? currency? "
                "paid_amount? is_member_booking returning_member:boolean? cancelled_at? booked_at?",
    "room_stays": "id? booking_id hotel_id arrival_date departure_date rate_amount_per_night:decimal(14,2)? currency?",
    "booking_segments": "id? booking_id market_segment_code? market_segment_label? rate_group_code? rate_code? source_code? "
                        "business_segment? channel_manager? travel_agency? origin? service_name?",
    "booking_status_history": "id? booking_id from_status? to_status occurred_at?",
    "transactions": "id chain_group_id hotel_id booking_id? member_id? external_transaction_id? transaction_type status "
                    "posting_date posted_amount posted_currency original_amount? original_currency? fx_rate:decimal(14,6)? "
                    "paid_amount? bonus_percent_at_posting:decimal(5,2)? bonus_earned_amount? bonus_released_amount is_ota",
    "transaction_lines": "id? transaction_id product_type line_info? quantity:decimal(14,4) unit_amount:decimal(14,4)? "
                         "amount:decimal(14,2) currency bonus_factor:decimal(8,4)",
    "point_transactions": "id chain_group_id program_id member_id type status points_delta source_transaction_id? "
                          "source_booking_id? reward_redemption_id? applied_percent? applied_multiplier:decimal(5,2)? "
                          "applied_tier_id? occurred_at effective_at? expires_at? reason? rule_id?",
    "point_redemptions": "id chain_group_id member_id reward_id points_spent redemption_date:timestamp_ntz status",
    "communication_templates": "id chain_group_id code name channel category subject_template? body_template language",
    "communications": "id chain_group_id hotel_id? member_id? channel direction category status to_email? to_phone? "
                      "queued_at? sent_at? delivered_at? sms_logical_count? sms_real_count? cost_amount:decimal(14,4)?",
    "segments": "id chain_group_id code name definition is_dynamic description? estimated_size:int? last_computed_at? is_active",
    "campaigns": "id chain_group_id code? name channel status start_date? end_date? recipient_count segment_id? template_id? "
                 "scheduled_send_at? delivered_count opened_count clicked_count bounced_count attributed_bookings:int "
                 "attributed_revenue attributed_revenue_ccy?",
    "campaign_recipients": "id? campaign_id member_id status sent_at? delivered_at? opened_at? clicked_at? bounced_at? "
                           "attributed_booking_id? attributed_revenue? attributed_currency?",
    "automations": "id chain_group_id code name trigger_type trigger_config? status segment_id?",
    "automation_steps": "id automation_id step_index action_type params?",
    "automation_runs": "id automation_id member_id? status started_at finished_at?",
    "admin_users": "id display_name? email? app_role chain_group_id? is_active",
    "admin_user_hotel_assignments": "id? admin_user_id hotel_id",
    "audit_log": "id? occurred_at actor_user_id? actor_role? action table_name record_id? chain_group_id? "
                 "before_value? after_value?",
    "pms_imports": "id chain_group_id? hotel_id? pms_code source_kind? status rows_total? rows_succeeded rows_failed",
    "pms_raw_payloads": "id import_id pms_code source_id? payload payload_hash? ingested_at",
    "pms_sync_errors": "id import_id row_index? error_code? error_message",
}

DESCRIPTIONS = {
    "chain_groups": "Hotel chains, the tenants.", "hotels": "Hotels of a chain.",
    "currency_rates": "Conversion rates by day; a rate holds until the next one of its pair.",
    "loyalty_programs": "The loyalty program of a chain.", "tiers": "Membership levels of a program, lowest first.",
    "tier_thresholds": "What a member has to reach for a tier, over a rolling period.",
    "points_rules": "Earning rules; the most specific match applies.", "rewards": "What points can be spent on.",
    "members": "Members of a chain; one person may belong to several chains.",
    "member_consents": "Consents as given over time; the newest per type holds.",
    "bookings": "Reservations of all property systems in one shape.",
    "transactions": "Payments, refunds and adjustments of bookings.",
    "point_transactions": "The points ledger: credits are positive, debits negative.",
    "point_redemptions": "Rewards that were redeemed.", "campaign_recipients": "Delivery and response per member.",
    "pms_raw_payloads": "Feed rows as received, kept for another parse.",
    "audit_log": "Changes of audited tables with both states.",
}
COLUMN_DESCRIPTIONS = {
    ("chain_groups", "reporting_currency"): "Currency of the reports of the chain.",
    ("loyalty_programs", "points_currency"): "One point is one unit of this currency.",
    ("loyalty_programs", "points_expiry_months"): "Months until earned points lapse; empty for never.",
    ("tiers", "sort_order"): "1 is the lowest level.",
    ("bookings", "nights"): "Departure minus arrival, zero for day use.",
    ("bookings", "member_id"): "Empty for guests without membership.",
    ("transactions", "posted_amount"): "Amount in the posted currency; refunds are negative.",
    ("point_transactions", "expires_at"): "When a credit lapses; empty for never.",
}

# Keys other than ``id``, and keys that must be unique besides the primary one.
PRIMARY_KEYS = {"currencies": ["code"], "regions": ["code"], "pms_systems": ["code"],
                "currency_rates": ["from_ccy", "to_ccy", "rate_date"]}
UNIQUE_KEYS = [
    ("chain_groups", ["slug"], None), ("hotels", ["chain_group_id", "slug"], None),
    ("hotel_pms_connections", ["pms_code", "external_property_id"], None),
    ("hotel_pms_connections", ["hotel_id"], "is_active"),
    ("loyalty_programs", ["chain_group_id", "slug"], None),
    ("tiers", ["program_id", "code"], None), ("tiers", ["program_id", "sort_order"], None),
    ("tiers", ["program_id"], "is_default_initial"),
    ("tier_thresholds", ["tier_id", "metric", "valid_from"], None), ("tier_benefits", ["tier_id", "benefit_key"], None),
    ("rewards", ["program_id", "code"], None),
    ("members", ["chain_group_id", "member_number"], None), ("members", ["chain_group_id", "lower(email)"], None),
    ("members", ["chain_group_id", "phone_e164"], None), ("member_external_ids", ["id_type", "id_value"], None),
    ("member_attributes", ["member_id", "attr_key"], None), ("bookings", ["pms_code", "pms_reservation_no"], None),
    ("booking_segments", ["booking_id"], None), ("transactions", ["chain_group_id", "external_transaction_id"], None),
    ("communication_templates", ["chain_group_id", "channel", "code", "language"], None),
    ("segments", ["chain_group_id", "code"], None), ("campaigns", ["chain_group_id", "code"], None),
    ("campaign_recipients", ["campaign_id", "member_id"], None), ("automations", ["chain_group_id", "code"], None),
    ("automation_steps", ["automation_id", "step_index"], None),
    ("admin_user_hotel_assignments", ["admin_user_id", "hotel_id"], None),
]

# Allowed values by table and column.
ENUMS: dict[tuple[str, str], list[str]] = {
    ("chain_groups", "status"): ["active", "paused", "archived"],
    ("hotels", "status"): ["active", "opening", "closed", "archived"],
    ("members", "status"): ["active", "inactive", "suspended", "merged", "archived"],
    ("members", "gender"): ["male", "female", "other", "unknown"],
    ("member_consents", "consent_type"): ["email", "sms", "offer", "user_agreement"],
    ("member_external_ids", "id_type"): ["fm_old_id", "sj_prio_id", "guest_connect_id", "pms_guest_id", "legacy_other"],
    ("member_tier_history", "change_reason"): ["qualified_by_points", "qualified_by_nights", "qualified_by_revenue",
                                               "manual_override", "demoted_lapsed", "initial_assignment"],
    ("tier_thresholds", "metric"): ["points", "nights", "revenue"],
    ("bookings", "pms_code"): ["stayntouch", "mews", "protel_air", "visbook", "other"],
    ("bookings", "channel"): ["direct", "ota", "corporate", "group", "walk_in", "travel_agency", "other"],
    ("bookings", "status"): ["upcoming", "in_house", "checked_out", "cancelled", "no_show"],
    ("transactions", "transaction_type"): ["charge", "refund", "adjustment", "gift_card"],
    ("transactions", "status"): ["pending", "posted", "reversed", "failed"],
    ("point_transactions", "type"): ["earn_pending", "earn_release", "redeem", "manual_adjustment", "expire", "reverse"],
    ("point_transactions", "status"): ["pending", "posted", "reversed", "expired"],
    ("communications", "channel"): ["sms", "email", "push"],
    ("communications", "direction"): ["outbound", "inbound"],
    ("communications", "status"): ["queued", "sent", "delivered", "failed", "bounced", "opened", "clicked"],
    ("communications", "category"): ["personal_invitation", "transactional", "marketing_campaign", "automation", "service"],
    ("campaigns", "status"): ["draft", "scheduled", "sending", "completed", "cancelled", "paused"],
    ("automations", "trigger_type"): ["ota_booking_received", "direct_booking_received", "booking_cancelled", "check_in",
                                      "check_out", "tier_upgrade", "tier_downgrade", "birthday", "anniversary",
                                      "points_expiring", "inactive_member"],
    ("automations", "status"): ["draft", "active", "paused", "archived"],
    ("automation_runs", "status"): ["queued", "running", "completed", "failed", "skipped"],
    ("automation_steps", "action_type"): ["send_sms", "send_email", "send_push", "wait", "add_tag", "remove_tag",
                                          "adjust_points", "webhook"],
    ("admin_users", "app_role"): ["platform_admin", "chain_admin", "hotel_staff", "analyst"],
    ("audit_log", "action"): ["insert", "update", "delete", "login", "logout", "role_change", "manual_adjust"],
    ("pms_imports", "status"): ["queued", "running", "completed", "failed", "partial"],
    ("rewards", "reward_type"): ["free_night", "discount_percent", "discount_amount", "late_checkout", "room_upgrade",
                                 "amenity", "gift_card", "experience"],
}

# What a column holds when a row is added without it.
DEFAULTS: dict[tuple[str, str], str] = {
    ("currencies", "decimals"): "2", ("chain_groups", "default_locale"): "nb-NO", ("chain_groups", "status"): "active",
    ("hotels", "status"): "active", ("hotels", "timezone"): "Europe/Oslo", ("hotel_pms_connections", "is_active"): "true",
    ("loyalty_programs", "is_active"): "true",
    ("tiers", "multiplier_default"): "1.00", ("tiers", "is_default_initial"): "false",
    ("tier_thresholds", "qualifying_period_months"): "12", ("tier_thresholds", "valid_from"): "1970-01-01",
    ("tier_benefits", "is_active"): "true", ("tier_benefits", "sort_order"): "0",
    ("points_rules", "priority"): "0", ("points_rules", "valid_from"): "1970-01-01", ("points_rules", "is_active"): "true",
    ("rewards", "is_active"): "true",
    ("members", "gender"): "unknown", ("members", "status"): "active", ("members", "recruited_via_ota"): "false",
    ("member_external_ids", "is_valid"): "true",
    ("bookings", "channel"): "other", ("bookings", "status"): "upcoming", ("bookings", "is_member_booking"): "false",
    ("transactions", "transaction_type"): "charge", ("transactions", "status"): "posted",
    ("transactions", "bonus_released_amount"): "0", ("transactions", "is_ota"): "false",
    ("transaction_lines", "quantity"): "1", ("transaction_lines", "bonus_factor"): "1",
    ("point_transactions", "status"): "posted", ("point_redemptions", "status"): "fulfilled",
    ("communication_templates", "language"): "nb", ("communications", "direction"): "outbound",
    ("communications", "status"): "queued", ("segments", "definition"): '{"type":"all"}', ("segments", "is_dynamic"): "true",
    ("segments", "is_active"): "true",
    **{("campaigns", c): "0" for c in ("delivered_count", "opened_count", "clicked_count", "bounced_count", "attributed_bookings", "attributed_revenue")},
    ("campaigns", "status"): "draft", ("campaigns", "recipient_count"): "0", ("campaign_recipients", "status"): "queued",
    ("automations", "status"): "draft", ("automation_runs", "status"): "queued", ("admin_users", "is_active"): "true",
    ("pms_imports", "status"): "queued", ("pms_imports", "rows_succeeded"): "0", ("pms_imports", "rows_failed"): "0",
}

# Row conditions as Spark SQL; an unknown result passes.
CHECKS: dict[str, list[str]] = {
    "hotels": ["room_count >= 0"], "currency_rates": ["rate > 0"],
    "loyalty_programs": ["points_expiry_months > 0"], "tiers": ["multiplier_default >= 0"],
    "tier_thresholds": ["min_value >= 0", "qualifying_period_months > 0", "valid_to >= valid_from"],
    "points_rules": ["percent_of_payment BETWEEN 0 AND 100", "valid_to >= valid_from"],
    "rewards": ["cost_points > 0", "valid_to >= valid_from"],
    "members": ["email = lower(email)"],
    "bookings": ["departure_date >= arrival_date", "num_rooms > 0"],
    "room_stays": ["departure_date >= arrival_date"],
    "point_redemptions": ["points_spent > 0"],
    "communications": ["channel <> 'email' OR to_email IS NOT NULL OR direction = 'inbound'",
                       "channel <> 'sms' OR to_phone IS NOT NULL OR direction = 'inbound'"],
    "campaigns": ["end_date >= start_date"],
    "admin_users": ["app_role = 'platform_admin' OR chain_group_id IS NOT NULL"],
}

# References that the naming rule does not find.
_REFERENCES = {
    "program_id": ("loyalty_programs", "id"), "current_tier_id": ("tiers", "id"), "from_tier_id": ("tiers", "id"),
    "to_tier_id": ("tiers", "id"), "min_tier_id": ("tiers", "id"), "applied_tier_id": ("tiers", "id"),
    "recruitment_hotel_id": ("hotels", "id"), "reward_redemption_id": ("point_redemptions", "id"),
    "template_id": ("communication_templates", "id"), "rule_id": ("points_rules", "id"), "source_transaction_id": ("transactions", "id"), "source_booking_id": ("bookings", "id"),
    "attributed_booking_id": ("bookings", "id"), "import_id": ("pms_imports", "id"),
    "pms_code": ("pms_systems", "code"), "default_pms": ("pms_systems", "code"),
    "country_code": ("regions", "code"), "headquarters_country": ("regions", "code"),
}
_NO_REFERENCE = {"external_property_id", "external_program_id", "external_transaction_id", "record_id", "source_id",
                 "actor_user_id"}


@dataclass(frozen=True)
class ColumnInfo:
    table: str
    position: int
    name: str
    type: str
    nullable: bool
    description: str | None
    is_primary_key: bool
    foreign_table: str | None
    foreign_column: str | None


def _reference(table: str, name: str) -> tuple[str | None, str | None]:
    if name in _REFERENCES:
        return _REFERENCES[name]
    if name.endswith(("_ccy", "currency")) and table != "currencies":
        return "currencies", "code"
    if name.endswith("_id") and name not in _NO_REFERENCE:
        plural = name[:-3] + "s"
        return (plural, "id") if plural in TABLES else (None, None)
    return None, None


def columns_of(table: str, key_type: str = "string") -> list[ColumnInfo]:
    """The columns of a table; ``key_type`` is the type of ids and of references to them."""
    out = []
    for i, spec in enumerate(TABLES[table].split(), 1):
        nullable = spec.endswith("?")
        name, _, explicit = spec.rstrip("?").partition(":")
        target, target_column = _reference(table, name)
        if explicit:
            kind = explicit
        elif name == "id" or target_column == "id" or name in ("record_id", "actor_user_id"):
            kind = key_type
        else:
            kind = next((t for test, t in _RULES if test(name)), "string")
        out.append(ColumnInfo(table, i, name, kind, nullable, COLUMN_DESCRIPTIONS.get((table, name)),
                              name in PRIMARY_KEYS.get(table, ["id"]), target, target_column))
    return out


def schema_of(table: str, key_type: str = "string") -> T.StructType:
    """The explicit schema to read a table with; descriptions travel as column comments."""
    fields = []
    for c in columns_of(table, key_type):
        note = {"comment": c.description} if c.description else {}
        fields.append(T.StructField(c.name, T.DataType.fromDDL(c.type), c.nullable, note))
    return T.StructType(fields)


def conform(df: DataFrame, table: str, key_type: str = "string") -> DataFrame:
    """Rows in the shape of a table: its columns in order, cast, with defaults for absent columns.

    A value that cannot be cast becomes NULL and is found by ``check_model``. Full names
    and nights are formed here, as the table forms them.
    """
    present, out = set(df.columns), []
    for c in columns_of(table, key_type):
        if c.name in present:
            value = F.col(c.name).try_cast(c.type)
        elif (table, c.name) == ("members", "full_name") and {"first_name", "last_name"} <= present:
            value = full_name("first_name", "last_name")
        elif (table, c.name) == ("bookings", "nights") and {"arrival_date", "departure_date"} <= present:
            value = nights(F.col("arrival_date").try_cast("date"), F.col("departure_date").try_cast("date"))
        else:
            value = F.lit(DEFAULTS.get((table, c.name))).cast(c.type)
        out.append(value.alias(c.name))
    return df.select(*out)


def references_of(table: str) -> list[tuple[str, str, str]]:
    """(column, parent table, parent key) of every reference of a table."""
    return [(c.name, c.foreign_table, c.foreign_column) for c in columns_of(table) if c.foreign_table]


def data_dictionary(spark: SparkSession, tables: list[str] | None = None, key_type: str = "string") -> DataFrame:
    """One row per column of the model: type, nullability, description, key and reference."""
    rows = [(c.table, DESCRIPTIONS.get(c.table), c.position, c.name, c.type, c.nullable,
             DEFAULTS.get((c.table, c.name)), c.description, c.is_primary_key, c.foreign_table, c.foreign_column)
            for t in (tables or sorted(TABLES)) for c in columns_of(t, key_type)]
    return spark.createDataFrame(rows, """table_name string, table_description string, ordinal_position int,
        column_name string, data_type string, is_nullable boolean, column_default string, column_description string,
        is_primary_key boolean, foreign_table string, foreign_column string""") \
        .orderBy("table_name", "ordinal_position")
