"""Named queries on data quality, tenant scoping, change capture, table writing and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayledger import schemas
from stayledger.functions.scalars import hash_number, hash_share, plain_ascii, weighted_pick
from stayledger.operators import access, audit, pms, quality, reports
from stayledger.operators.access import PLATFORM_ADMIN, Principal
from stayledger.plans.binding import EVENT_START, Frames
from stayledger.plans import reports as report_queries
from stayledger.plans.registry import ORACLES, pct_sql, query
from stayledger.session import fresh_path
from stayledger.sources import feeds, tables
from stayledger.streaming import streams

# --- data quality -----------------------------------------------------------------


@query("check_unique", """
SELECT chain_group_id, phone_e164, count(*) AS copies FROM {members} WHERE phone_e164 IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def check_unique(f):
    return quality.check_unique(f.members, ["chain_group_id", "phone_e164"])


@query("check_unique_payload", """
SELECT sha256(payload) AS payload_hash, count(*) AS copies FROM {event_payloads} GROUP BY 1 HAVING count(*) > 1""")
def check_unique_payload(f):
    return quality.check_unique(f.event_payloads.withColumn("payload_hash", F.sha2("payload", 256)), ["payload_hash"])


@query("check_predicate", "SELECT id AS member_id, email FROM {members} WHERE email <> lower(email)")
def check_predicate(f):
    return quality.check_predicate(f.members, F.col("email") == F.lower("email")).select(F.col("id").alias("member_id"), "email")


@query("check_enum", """
SELECT 'event_type' AS column_name, event_type AS value, count(*) AS occurrences FROM {events}
WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY 2""")
def check_enum(f):
    return quality.check_enum(f.events, "event_type", ["view", "click", "purchase"])


@query("check_fk", """
SELECT 'member_id' AS column_name, b.member_id AS missing_key, count(*) AS references FROM {bookings} b
LEFT JOIN (SELECT DISTINCT user_id FROM {events}) e ON e.user_id = b.member_id WHERE e.user_id IS NULL AND b.member_id IS NOT NULL GROUP BY 2""")
def check_fk(f):
    return quality.check_fk(f.bookings, "member_id", f.events, "user_id")


@query("check_not_null", """
SELECT * FROM (SELECT 'email' AS column_name, count(*) - count(email) AS nulls FROM {members}
UNION ALL SELECT 'phone_e164', count(*) - count(phone_e164) FROM {members}
UNION ALL SELECT 'current_tier_id', count(*) - count(current_tier_id) FROM {members}
UNION ALL SELECT 'status', count(*) - count(status) FROM {members}) WHERE nulls > 0""")
def check_not_null(f):
    return quality.check_not_null(f.members, ["email", "phone_e164", "current_tier_id", "status"])


@query("check_same_tenant", """
SELECT r.chain_group_id, m.chain_group_id AS parent_chain_id, count(*) AS occurrences FROM {campaigns} c JOIN {campaign_recipients} x ON x.campaign_id = c.id
JOIN {members} m ON m.id = x.member_id, LATERAL (SELECT CAST(c.chain_group_id AS BIGINT) AS chain_group_id) r
WHERE r.chain_group_id <> m.chain_group_id GROUP BY 1, 2""")
def check_same_tenant(f):
    owners = f.campaigns.select(F.col("id").alias("campaign_id"), "chain_group_id")
    return quality.check_same_tenant(f.campaign_recipients.join(owners, "campaign_id"), "member_id", f.members)


@query("check_model_members", """
SELECT 'members' AS table_name, rule, n AS offending_rows FROM (
  SELECT 'check: email = lower(email)' AS rule, count(*) AS n FROM {members} WHERE email <> lower(email)
  UNION ALL SELECT 'unique: chain_group_id, phone_e164', CAST(coalesce(sum(c), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM {members}
    WHERE phone_e164 IS NOT NULL GROUP BY chain_group_id, phone_e164) WHERE c > 1) WHERE n > 0
UNION ALL SELECT 'members', 'not checked: reference: ' || c, NULL FROM (VALUES ('country_code'), ('recruitment_hotel_id')) AS t(c)""")
def check_model_members(f):
    return quality.check_model("members", {"members": f.members, "tiers": f.tiers, "chain_groups": f.chain_groups,
                                           "loyalty_programs": f.loyalty_programs})


@query("table_report", """
SELECT 'bookings' AS table_name, count(*) AS row_count FROM {bookings} UNION ALL SELECT 'members', count(*) FROM {members}
UNION ALL SELECT 'transactions', count(*) FROM {transactions} UNION ALL SELECT 'point_transactions', count(*) FROM {event_ledger}""")
def table_report(f):
    return quality.table_report({"bookings": f.bookings, "members": f.members, "transactions": f.transactions,
                                 "point_transactions": f.event_ledger})


@query("transaction_summary", """
SELECT count(*) AS transactions, count(member_id) AS member_transactions, count(*) - count(member_id) AS guest_transactions,
  CAST(round(avg(posted_amount) FILTER (member_id IS NOT NULL AND status = 'posted' AND transaction_type = 'charge')) AS BIGINT) AS avg_member_charge,
  CAST(round(avg(posted_amount) FILTER (member_id IS NULL AND status = 'posted' AND transaction_type = 'charge')) AS BIGINT) AS avg_guest_charge
FROM {transactions}""")
def transaction_summary(f):
    return quality.transaction_summary(f.transactions)


@query("valid_transitions", """
SELECT 'upcoming' AS from_status, 'checked_out' AS to_status, count(*) AS occurrences FROM {bookings} WHERE status = 'checked_out'""")
def valid_transitions(f):
    allowed = [(None, "upcoming"), ("upcoming", "in_house"), ("upcoming", "cancelled"), ("upcoming", "no_show"),
               ("in_house", "checked_out")]
    return quality.valid_transitions(pms.status_history_from_bookings(f.bookings), allowed)


# --- tenant scoping ---------------------------------------------------------------

CHAIN_ADMIN = Principal("chain_admin", 1)
STAFF = Principal("hotel_staff", 2, (7, 12, 3))
NO_ROLE = Principal(None, 3, (8,))
ADMIN = Principal(PLATFORM_ADMIN)


def _scoped(name: str, table: str, who: Principal, condition: str):
    def build(f: Frames):
        return access.scope_table(table, {t: f.frame(t) for t in ("bookings", "members", "transactions")}, who) \
            .groupBy("chain_group_id").agg(F.count("*").alias("visible"), F.min("id").alias("first_id"),
                                           F.max("id").alias("last_id"))

    query(name, f"""SELECT chain_group_id, count(*) AS visible, min(id) AS first_id, max(id) AS last_id FROM {{{table}}}
WHERE {condition} GROUP BY 1""")(build)


_scoped("scope_platform_admin", "bookings", ADMIN, "true")
_scoped("scope_chain_admin", "members", CHAIN_ADMIN, "chain_group_id = 1")
_scoped("scope_hotel_staff", "bookings", STAFF, "chain_group_id = 2 AND hotel_id IN (7, 12)")
_scoped("scope_no_role_chain", "members", NO_ROLE, "chain_group_id = 3")
_scoped("scope_no_role_hotel", "bookings", NO_ROLE, "chain_group_id = 3 AND hotel_id = 8")
_scoped("scope_staff_without_hotels", "transactions", Principal("hotel_staff", 2), "false")


@query("scope_by_parent", """
SELECT r.campaign_id, count(*) AS visible FROM {campaign_recipients} r JOIN {campaigns} c ON c.id = r.campaign_id
WHERE c.chain_group_id = 1 GROUP BY 1""")
def scope_by_parent(f):
    frames = {"campaigns": f.campaigns, "campaign_recipients": f.campaign_recipients}
    return access.scope_table("campaign_recipients", frames, CHAIN_ADMIN).groupBy("campaign_id") \
        .agg(F.count("*").alias("visible"))


@query("scope_imports", """
SELECT r.import_id, count(*) AS visible FROM {pms_raw_payloads} r JOIN {pms_imports} i ON i.id = r.import_id
WHERE i.chain_group_id = 1 GROUP BY 1""")
def scope_imports(f):
    frames = {"pms_imports": f.pms_imports, "pms_raw_payloads": f.pms_raw_payloads}
    return access.scope_table("pms_raw_payloads", frames, CHAIN_ADMIN).groupBy("import_id") \
        .agg(F.count("*").alias("visible"))


@query("scoped_report", f"""
WITH b AS (SELECT chain_group_id, CAST(date_trunc('month', arrival_date) AS DATE) AS month, count(*) AS n,
    count(*) FILTER (channel = 'direct') AS d, count(*) FILTER (channel = 'ota') AS o, count(*) FILTER (channel = 'corporate') AS c
  FROM {{bookings}} WHERE hotel_id IN (7, 12) AND status <> 'cancelled' GROUP BY 1, 2)
SELECT chain_group_id, g.name AS chain_name, month, d AS direct_count, o AS ota_count, c AS corporate_count, n AS total_bookings,
  {pct_sql('d', 'n')} AS direct_share_pct, {pct_sql('o', 'n')} AS ota_share_pct FROM b JOIN {{chain_groups}} g ON g.id = b.chain_group_id""")
def scoped_report(f):
    seen = access.scope_tables({"bookings": f.bookings, "chain_groups": f.chain_groups}, STAFF)
    return reports.direct_booking_share(seen["bookings"], seen["chain_groups"])


# --- change capture ---------------------------------------------------------------

def _snapshots(f):
    """Two states of the bookings: walk-ins are new, no-shows removed, in-house stays completed."""
    columns = ["id", "chain_group_id", "hotel_id", "member_id", "status", "channel", "total_amount"]
    before = f.bookings.select(*columns).where(F.col("channel") != "walk_in")
    done = F.when(F.col("status") == "in_house", "checked_out").otherwise(F.col("status"))
    after = f.bookings.select(*columns).where(F.col("status") != "no_show").withColumn("status", done)
    return before, after


@query("audit_diff", """
SELECT * FROM (SELECT CASE WHEN channel = 'walk_in' AND status <> 'no_show' THEN 'insert' WHEN channel <> 'walk_in' AND status = 'no_show' THEN 'delete'
    WHEN channel <> 'walk_in' AND status = 'in_house' THEN 'update' END AS action, 'bookings' AS table_name, id AS record_id, chain_group_id,
  'u1' AS actor_user_id, 'chain_admin' AS actor_role, CASE WHEN channel <> 'walk_in' THEN status END AS old_status,
  CASE status WHEN 'no_show' THEN NULL WHEN 'in_house' THEN 'checked_out' ELSE status END AS new_status FROM {bookings}) WHERE action IS NOT NULL""")
def audit_diff(f):
    before, after = _snapshots(f)
    rows = audit.audit_diff(before, after, "bookings", Principal("chain_admin", 1, sub="u1"))
    return rows.select("action", "table_name", "record_id", "chain_group_id", "actor_user_id", "actor_role",
                       F.get_json_object("before_value", "$.status").alias("old_status"),
                       F.get_json_object("after_value", "$.status").alias("new_status"))


@query("audit_manual_points", """
SELECT id AS record_id, 'manual_adjust' AS action, chain_group_id, CAST(points_delta AS VARCHAR) AS points FROM {event_ledger}
WHERE type = 'manual_adjustment' AND points_delta >= 50
UNION ALL SELECT id, 'update', chain_group_id, CAST(points_delta + 1 AS VARCHAR) FROM {event_ledger} WHERE type = 'manual_adjustment' AND points_delta < 50""")
def audit_manual_points(f):
    columns = ["id", "chain_group_id", "member_id", "type", "points_delta"]
    before = f.event_ledger.select(*columns).where(F.col("points_delta") < 50)
    after = f.event_ledger.select(*columns).withColumn(
        "points_delta", F.when(F.col("points_delta") < 50, F.col("points_delta") + 1).otherwise(F.col("points_delta")))
    rows = audit.audit_manual_points(before, after, Principal("chain_admin", 1))
    return rows.select("record_id", "action", "chain_group_id",
                       F.get_json_object("after_value", "$.points_delta").alias("points"))


# --- table writing ----------------------------------------------------------------

@query("insert_ignore", """
SELECT campaign_id, member_id, sent_at FROM (SELECT campaign_id, member_id, sent_at, row_number() OVER (PARTITION BY campaign_id, member_id
  ORDER BY sent_at) AS n FROM {stay_touches}) WHERE n = 1 AND (campaign_id, member_id) NOT IN (SELECT (campaign_id, member_id) FROM {campaign_recipients})""")
def insert_ignore(f):
    return tables.insert_ignore(f.stay_touches, f.campaign_recipients, ["campaign_id", "member_id"], ["sent_at"])


@query("recruitment_hotel", """
SELECT m.id AS member_id, m.chain_group_id, arg_min(h.id, md5(CAST(m.id AS VARCHAR) || CAST(h.id AS VARCHAR))) AS recruitment_hotel_id
FROM {members} m JOIN {hotels} h ON h.chain_group_id = m.chain_group_id GROUP BY 1, 2""")
def recruitment_hotel(f):
    picked = tables.hash_pick(f.members, f.hotels, "chain_group_id", out="recruitment_hotel_id")
    return picked.select(F.col("id").alias("member_id"), "chain_group_id", "recruitment_hotel_id")


@query("update_from", """
SELECT m.id AS member_id, coalesce(h.default_currency, m.country_code) AS country_code, m.city FROM {members} m
LEFT JOIN {hotels} h ON h.name = m.city AND h.status = 'closed'""")
def update_from(f):
    closed = f.hotels.where(F.col("status") == "closed") \
        .select(F.col("name").alias("city"), F.col("default_currency").alias("country_code"))
    return tables.update_from(f.members, closed, ["city"], ["country_code"]) \
        .select(F.col("id").alias("member_id"), "country_code", "city")


@query("numbered_members", """
SELECT b.id AS booking_id, n.member_id FROM {bookings} b JOIN (SELECT id AS member_id, row_number() OVER (ORDER BY id) AS position,
  count(*) OVER () AS n FROM {members}) n ON n.position = (b.id * 13 + 17) % n.n + 1""")
def numbered_members(f):
    people = tables.numbered(f.members.select("id"), "id")
    rows = f.bookings.select(F.col("id").alias("booking_id"))
    spot = (F.col("booking_id") * 13 + 17) % F.lit(f.members.count()) + 1
    return rows.withColumn("position", spot).join(people.withColumnRenamed("id", "member_id"), "position") \
        .select("booking_id", "member_id")


@query("balance_snapshot", ORACLES["points_balances"])
def balance_snapshot(f):
    folder = fresh_path(f.spark, "snapshots")
    tables.save_snapshot(report_queries.points_balances(f), folder, EVENT_START)
    return tables.load_snapshot(f.spark, folder, EVENT_START)


@query("append_by_month", """
SELECT CAST(date_trunc('month', arrival_date) AS DATE) AS month, count(*) AS row_count, CAST(sum(total_amount) AS DOUBLE) AS amount
FROM {bookings} GROUP BY 1""")
def append_by_month(f):
    path = fresh_path(f.spark, "bookings")
    tables.reload(f.bookings.where(F.col("member_id").isNotNull()), path, "arrival_date")
    tables.append(f.bookings.where(F.col("member_id").isNull()), path, "arrival_date")
    return tables.read_table(f.spark, path).groupBy("month").agg(
        F.count("*").alias("row_count"), F.sum("total_amount").alias("amount"))


@query("csv_feed", """
SELECT hotel_id, count(*) AS reservations, CAST(sum(total_amount) AS DOUBLE) AS amount, min(pms_reservation_no) AS first_no,
  sum((member_id IS NULL)::INT)::BIGINT AS guests FROM {bookings} GROUP BY 1""")
def csv_feed(f):
    path = fresh_path(f.spark, "csv-feed")
    f.bookings.select("pms_reservation_no", "hotel_id", "member_id", "total_amount") \
        .write.options(sep=";", header=True).csv(path)
    rows = feeds.read_csv_feed(f.spark, path, "pms_reservation_no string, hotel_id int, member_id bigint, total_amount decimal(14,2)",
                               "import-1", "other", "pms_reservation_no")
    return _by_hotel(rows)


@query("json_feed", ORACLES["csv_feed"])
def json_feed(f):
    path = fresh_path(f.spark, "json-feed")
    f.bookings.select("pms_reservation_no", "hotel_id", "member_id", "total_amount").write.json(path)
    rows = feeds.read_json_feed(f.spark, path, "pms_reservation_no string, hotel_id int, member_id bigint, total_amount decimal(14,2)",
                                "import-2", "other", "pms_reservation_no")
    return _by_hotel(rows)


@query("json_array_feed", """
SELECT hotel_id, count(*) AS reservations, CAST(sum(total_amount) AS DOUBLE) AS amount, min(pms_reservation_no) AS first_no,
  sum((member_id IS NULL)::INT)::BIGINT AS guests FROM {bookings} WHERE id % 50 <> 3 GROUP BY 1
UNION ALL SELECT NULL, count(*), NULL, NULL, NULL FROM {bookings} WHERE id % 50 = 3""")
def json_array_feed(f):
    """All bookings as array files, each written by one task and read in blocks; every fiftieth object is broken and counts as a bad row."""
    path = fresh_path(f.spark, "json-array")
    object_ = F.to_json(F.struct("pms_reservation_no", "hotel_id", "member_id", "total_amount", F.struct(F.lit("{[\"}").alias("note"), F.lit(1).alias("n")).alias("extra")))
    text = F.when(F.col("id") % 50 == 3, F.concat(F.lit('{"hotel_id": , "extra": '), object_, F.lit("}"))).otherwise(object_)
    rows = f.bookings.select(F.concat(F.lit(", "), text).alias("value"))
    rows.write.text(path)
    landed = feeds.read_json_array(f.spark, path, "pms_reservation_no string, hotel_id int, member_id bigint, total_amount decimal(14,2)",
                                   "import-3", "other", "pms_reservation_no")
    bad = feeds.feed_errors(landed).agg(F.count("*").alias("reservations"))
    good = _by_hotel(landed.where("raw_row IS NULL"))
    return good.unionByName(bad, allowMissingColumns=True)


def _by_hotel(landed):
    """What the landed payloads of a feed add up to, read back from their JSON."""
    p = landed.select("source_id", F.from_json("payload", "hotel_id int, member_id bigint, total_amount decimal(14,2)").alias("p"))
    return p.groupBy("p.hotel_id").agg(F.count("*").alias("reservations"), F.sum("p.total_amount").alias("amount"),
                                       F.min("source_id").alias("first_no"), F.count_if(F.col("p.member_id").isNull()).alias("guests"))


@query("data_dictionary", """
WITH d(position, column_name, data_type, is_nullable, foreign_table) AS (VALUES (1, 'id', 'bigint', false, NULL),
  (2, 'chain_group_id', 'bigint', false, 'chain_groups'), (3, 'program_id', 'bigint', false, 'loyalty_programs'),
  (4, 'member_id', 'bigint', false, 'members'), (5, 'type', 'string', false, NULL), (6, 'status', 'string', false, NULL),
  (7, 'points_delta', 'bigint', false, NULL), (14, 'occurred_at', 'timestamp_ntz', false, NULL), (16, 'expires_at', 'timestamp_ntz', true, NULL)),
n AS (SELECT count(*) AS every, count(expires_at) AS expiring FROM {event_ledger})
SELECT CAST(position AS BIGINT) AS ordinal_position, column_name, data_type, is_nullable, column_name = 'id' AS is_primary_key, foreign_table,
  CASE column_name WHEN 'expires_at' THEN every - expiring ELSE 0 END AS nulls FROM d, n""")
def data_dictionary(f):
    words = schemas.data_dictionary(f.spark, ["point_transactions"], "bigint")
    present = [c for c in f.event_ledger.columns if c in {w.name for w in schemas.columns_of("point_transactions")}]
    nulls = quality.check_not_null(f.event_ledger, present)
    return words.where(F.col("column_name").isin(present)).join(nulls, "column_name", "left").fillna(0, ["nulls"]) \
        .select("ordinal_position", "column_name", "data_type", "is_nullable", "is_primary_key", "foreign_table", "nulls")


@query("hash_sample", """
SELECT id AS booking_id FROM {bookings} WHERE CAST('0x' || left(md5(CAST(id AS VARCHAR) || 'segment'), 8) AS BIGINT) < 3221225472""")
def hash_sample(f):
    return f.bookings.where(hash_share(F.col("id"), 0.75, "segment")).select(F.col("id").alias("booking_id"))


@query("weighted_pick", """
WITH h AS (SELECT id, CAST('0x' || left(md5(CAST(id AS VARCHAR) || 'tier'), 8) AS BIGINT) * 100 AS r FROM {members})
SELECT id AS member_id, CASE WHEN r <= 55 * 4294967296 THEN 'bronze' WHEN r <= 80 * 4294967296 THEN 'silver' WHEN r <= 92 * 4294967296 THEN 'gold'
  WHEN r <= 97 * 4294967296 THEN 'platinum' ELSE 'black' END AS picked FROM h""")
def weighted(f):
    weights = {"bronze": 55, "silver": 25, "gold": 12, "platinum": 5, "black": 3}
    unit = hash_number(F.col("id"), "tier") / float(2 ** 32)
    return f.members.select(F.col("id").alias("member_id"), weighted_pick(unit, weights).alias("picked"))


@query("mail_name", """
SELECT id AS member_id, replace(replace(lower(last_name), 'ø', 'o'), ' ', '-') AS mail_name FROM {members}""")
def mail_name(f):
    return f.members.select(F.col("id").alias("member_id"),
                            F.regexp_replace(F.lower(plain_ascii("last_name")), " ", "-").alias("mail_name"))


# --- streams ----------------------------------------------------------------------

def _event_stream(f):
    return streams.file_stream(f.spark, f"{f.folder}/events.parquet")


@query("stream_dedupe_payloads", """
SELECT DISTINCT props AS payload, sha256(props) AS payload_hash FROM {events}""")
def stream_dedupe_payloads(f):
    raw = _event_stream(f).select(F.col("event_id").alias("id"), F.col("props").alias("payload"), F.col("ts").alias("ingested_at"))
    return streams.dedupe_stream(raw, f.spark).select("payload", "payload_hash")


@query("stream_running_balance", """
SELECT user_id AS member_id, CAST(sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN -1 ELSE 0 END * round(CAST(value AS DECIMAL(14,2)), 0)) AS BIGINT)
  AS balance_posted, CAST(sum(CASE WHEN event_type = 'view' THEN round(CAST(value AS DECIMAL(14,2)), 0) ELSE 0 END) AS BIGINT) AS balance_pending,
  max(ts) AS last_activity_at FROM {events} GROUP BY 1""")
def stream_running_balance(f):
    kind = F.col("event_type")
    points = F.round(F.col("value").cast("decimal(14,2)"), 0).cast("bigint")
    rows = _event_stream(f).select(
        F.col("user_id").alias("member_id"), F.col("ts").alias("occurred_at"),
        F.when(kind == "view", "pending").when(kind.isin("purchase", "click"), "posted").otherwise("reversed").alias("status"),
        F.when(kind == "click", -points).otherwise(points).alias("points_delta"))
    return streams.balance_stream(rows, f.spark)


@query("stream_invitations", """
SELECT o_orderkey AS booking_id, o_custkey AS member_id, m.phone_e164 AS to_phone, o_orderdate + INTERVAL 5 MINUTE AS queued_at
FROM {orders} JOIN {members} m ON m.id = o_custkey WHERE o_orderpriority = '2-HIGH' AND m.phone_e164 IS NOT NULL""")
def stream_invitations(f):
    orders = streams.file_stream(f.spark, f"{f.folder}/orders.parquet")
    rows = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("member_id"),
                         F.col("o_orderdate").alias("booked_at"),
                         F.when(F.col("o_orderpriority") == "2-HIGH", "ota").otherwise("direct").alias("channel"))
    return streams.invitation_stream(rows, f.members, f.spark)
