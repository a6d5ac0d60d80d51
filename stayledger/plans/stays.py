"""Named queries on property-system feeds and on rows derived from bookings."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayledger.operators import payloads, pms
from stayledger.plans.registry import query
from stayledger.session import fresh_path
from stayledger.functions.scalars import excel_serial
from stayledger.sources.tables import materialize


@query("explode_external_ids", """
WITH e AS (SELECT id, unnest(from_json(external_membership_raw, '[{"Type":"VARCHAR","Value":"VARCHAR","ValidFromUtc":"VARCHAR","IsValid":"INTEGER"}]')) AS x
  FROM {members} WHERE external_membership_raw IS NOT NULL),
n AS (SELECT id AS member_id, CASE x.Type WHEN 'FMOldId' THEN 'fm_old_id' WHEN 'SJprioId' THEN 'sj_prio_id'
    WHEN 'GuestConnectId' THEN 'guest_connect_id' WHEN 'PMSGuestId' THEN 'pms_guest_id' ELSE 'legacy_other' END AS id_type,
  x.Value AS id_value, x.IsValid = 1 AS is_valid, CAST(x.ValidFromUtc AS TIMESTAMP) AS valid_from FROM e)
SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id_type, id_value ORDER BY member_id, valid_from) = 1""")
def explode_external_ids(f):
    return pms.explode_external_ids(f.members)


_NORMAL = """
WITH p AS (SELECT id, import_id, pms_code, CAST(payload AS JSON) AS j FROM {pms_raw_payloads}),
n AS (SELECT id, import_id, pms_code,
  CASE pms_code WHEN 'stayntouch' THEN j->>'$.reservation_number' WHEN 'mews' THEN j->>'$.reservation_nr'
    WHEN 'protel_air' THEN j->>'$.reservation_id' ELSE j->>'$.booking_id' END AS pms_reservation_no,
  j->>'$.department_id' AS external_property_id,
  CASE pms_code WHEN 'stayntouch' THEN CAST(left(j->>'$.arrival_time', 10) AS DATE)
    WHEN 'mews' THEN DATE '1899-12-30' + CAST(floor(CAST(j->>'$.booking_start' AS DOUBLE)) AS INTEGER) END AS arrival_date,
  CASE pms_code WHEN 'stayntouch' THEN CAST(left(j->>'$.departure_time', 10) AS DATE)
    WHEN 'mews' THEN DATE '1899-12-30' + CAST(floor(CAST(j->>'$.booking_end' AS DOUBLE)) AS INTEGER) END AS departure_date,
  CAST(coalesce(j->>'$.transaction_sum', j->>'$.bill_amount', j->>'$.amount') AS DOUBLE) AS total_amount,
  coalesce(j->>'$.bill_currency', j->>'$.currency') AS currency,
  CASE WHEN j->>'$.channel_manager' IN ('Booking.com', 'Expedia', 'Hotels.com', 'Agoda', 'Trip.com') THEN 'ota'
    WHEN j->>'$.source_code' = 'Company direct' THEN 'corporate' WHEN j->>'$.rate_group' LIKE 'GROUP%' THEN 'group'
    WHEN j->>'$.origin' = 'Direct' OR j->>'$.source_code' = 'Brand.com' THEN 'direct' ELSE 'other' END AS channel,
  coalesce(j->>'$.reservation_source', j->>'$.origin') AS reservation_source_label, j->>'$.channel_manager' AS channel_manager,
  j->>'$.business_segment' AS business_segment, j->>'$.rate_group' AS rate_group_code, lower(j->>'$.guest_email') AS guest_email FROM p),
c AS (SELECT n.*, k.hotel_id, list_filter([
    CASE WHEN k.hotel_id IS NULL OR n.pms_reservation_no IS NULL THEN 'MAP_MISSING' END,
    CASE WHEN h.default_currency <> coalesce(n.currency, '') THEN 'CCY_MISMATCH' END,
    CASE WHEN n.id > min(n.id) OVER (PARTITION BY n.pms_code, n.pms_reservation_no) THEN 'DUP_RESV' END,
    CASE WHEN n.guest_email IS NULL THEN 'MISSING_EMAIL' END], lambda x: x IS NOT NULL) AS codes
  FROM n LEFT JOIN {hotel_pms_connections} k ON k.is_active AND k.pms_code = n.pms_code AND k.external_property_id = n.external_property_id
  LEFT JOIN {hotels} h ON h.id = k.hotel_id)"""


@query("normalize_payloads", _NORMAL + " SELECT * FROM n")
def normalize_payloads(f):
    return pms.normalize_payloads(f.pms_raw_payloads)


@query("classify_channel", _NORMAL + " SELECT pms_code, channel, count(*) AS reservations FROM n GROUP BY 1, 2")
def classify_channel(f):
    return pms.normalize_payloads(f.pms_raw_payloads).groupBy("pms_code", "channel") \
        .agg(F.count("*").alias("reservations"))


@query("pms_property_lookup", _NORMAL + " SELECT id, pms_code, external_property_id, hotel_id FROM c")
def pms_property_lookup(f):
    rows = pms.pms_property_lookup(pms.normalize_payloads(f.pms_raw_payloads), f.hotel_pms_connections)
    return rows.select("id", "pms_code", "external_property_id", "hotel_id")


def checked(f):
    parsed = materialize(pms.normalize_payloads(f.pms_raw_payloads), "reservations")
    return pms.sync_errors(pms.pms_property_lookup(parsed, f.hotel_pms_connections), f.hotels)


@query("valid_reservations", _NORMAL + """ SELECT id, import_id, pms_code, pms_reservation_no, hotel_id, arrival_date, departure_date,
  total_amount, currency, channel, guest_email FROM c WHERE len(codes) = 0""")
def valid_reservations(f):
    valid, _ = pms.route_sync_errors(checked(f))
    return valid.select("id", "import_id", "pms_code", "pms_reservation_no", "hotel_id", "arrival_date",
                        "departure_date", "total_amount", "currency", "channel", "guest_email")


@query("sync_errors", _NORMAL + " SELECT import_id, id, pms_code, pms_reservation_no, unnest(codes) AS error_code FROM c")
def sync_errors(f):
    _, errors = pms.route_sync_errors(checked(f))
    return errors


@query("import_summary", _NORMAL + """, s AS (SELECT import_id, count(*) AS n, sum((len(codes) = 0)::INT) AS ok FROM c GROUP BY 1)
SELECT i.id AS import_id, coalesce(n, 0) AS rows_total, CAST(coalesce(ok, 0) AS BIGINT) AS rows_succeeded,
  CAST(coalesce(n - ok, 0) AS BIGINT) AS rows_failed,
  CASE WHEN n IS NULL OR ok = n THEN 'completed' WHEN ok = 0 THEN 'failed' ELSE 'partial' END AS status
FROM {pms_imports} i LEFT JOIN s ON s.import_id = i.id""")
def import_summary(f):
    return pms.import_summary(checked(f), f.pms_imports)


@query("dedupe_payloads", """
SELECT arg_min(id, ingested_at) AS id, arg_min(import_id, ingested_at) AS import_id, payload, min(ingested_at) AS ingested_at,
  sha256(payload) AS payload_hash, count(*) AS copies FROM {event_payloads} GROUP BY payload""")
def dedupe_payloads(f):
    return pms.dedupe_payloads(f.event_payloads).drop("pms_code")


@query("excel_serial_to_ts", """
SELECT id, CAST(DATE '1899-12-30' + (36000 + CAST(id % 900 AS INTEGER)) AS TIMESTAMP) + INTERVAL 15 HOUR AS starts_at
FROM {pms_raw_payloads} WHERE pms_code = 'mews'""")
def excel_serial_to_ts(f):
    rows = f.pms_raw_payloads.where(F.col("pms_code") == "mews")
    return rows.select("id", excel_serial(F.get_json_object("payload", "$.booking_start")).alias("starts_at"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in rows)


@query("segment_from_channel", f"""
SELECT id AS booking_id, channel, code AS market_segment_code, label AS market_segment_label, source AS source_code, business AS business_segment, origin,
  'Accommodation' AS service_name
FROM {{bookings}} JOIN (VALUES {_values(pms.CHANNEL_SEGMENTS)}) s(channel, code, label, source, business, origin) USING (channel)""")
def segment_from_channel(f):
    return pms.segment_from_channel(f.bookings, pms.channel_segments(f.spark))


@query("room_stays", """
WITH r AS (SELECT *, CASE WHEN nights > 0 THEN nights END AS n, CAST(total_amount * 100 AS BIGINT) AS cents FROM {bookings})
SELECT id AS booking_id, hotel_id, arrival_date, departure_date, currency, CAST(1 AS BIGINT) AS room_index,
  ((2 * cents + n) // (2 * n)) / 100.0 AS rate_amount_per_night FROM r
UNION ALL SELECT id, hotel_id, arrival_date, departure_date, currency, 2, ((170 * cents + 100 * n) // (200 * n)) / 100.0 FROM r WHERE num_rooms > 1""")
def room_stays(f):
    return pms.room_stays_from_bookings(f.bookings)


@query("order_lines", """
WITH e AS (SELECT transaction_id, currency, unnest(CAST(order_lines AS JSON[])) AS l FROM {order_payloads}),
v AS (SELECT transaction_id, currency, l->>'$.ProductType' AS product_type, l->>'$.LineInfo' AS line_info,
    CAST(l->>'$.Quantity' AS DOUBLE) AS quantity, CAST(l->>'$.Sum' AS DECIMAL(14,2)) AS amount, CAST(l->>'$.BonusFactor' AS DOUBLE) AS bonus_factor FROM e)
SELECT transaction_id, product_type, line_info, quantity, CAST((2 * CAST(amount * 10000 AS BIGINT) + CAST(quantity AS BIGINT))
    // (2 * CAST(quantity AS BIGINT)) AS DOUBLE) / 10000 AS unit_amount, CAST(amount AS DOUBLE) AS amount, currency, bonus_factor FROM v""")
def order_lines(f):
    return pms.explode_order_lines(f.order_payloads)


@query("status_history", """
SELECT id AS booking_id, CASE step WHEN 1 THEN 'upcoming' WHEN 2 THEN 'in_house' END AS from_status,
  CASE step WHEN 0 THEN 'upcoming' ELSE status END AS to_status,
  CASE WHEN step = 0 THEN booked_at WHEN step = 2 THEN check_out_at WHEN status = 'cancelled' THEN cancelled_at
    WHEN status = 'no_show' THEN CAST(arrival_date AS TIMESTAMP) + INTERVAL 23 HOUR ELSE check_in_at END AS occurred_at
FROM {bookings}, (VALUES (0), (1), (2)) AS s(step)
WHERE CASE step WHEN 0 THEN booked_at IS NOT NULL WHEN 1 THEN status <> 'upcoming' ELSE status = 'checked_out' END""")
def status_history(f):
    return pms.status_history_from_bookings(f.bookings)


# --- whole payloads ---------------------------------------------------------------

_LANDED = """landed AS (SELECT id, pms_code, payload FROM {pms_raw_payloads} UNION ALL SELECT 0 - id, pms_code, payload FROM {event_payloads}
  UNION ALL SELECT id + 1000000000, 'broken', CASE id % 4 WHEN 0 THEN '[1,2]' WHEN 1 THEN '{"a":' WHEN 2 THEN '{"a":null,"b":{"c":[true]}}' ELSE '"text"' END
    FROM {event_payloads} WHERE id < 40)"""


def _landed(f):
    broken = F.when(F.col("id") % 4 == 0, "[1,2]").when(F.col("id") % 4 == 1, '{"a":').when(F.col("id") % 4 == 2, '{"a":null,"b":{"c":[true]}}').otherwise('"text"')
    rows = f.pms_raw_payloads.select("id", "pms_code", "payload") \
        .unionByName(f.event_payloads.select((-F.col("id")).alias("id"), "pms_code", "payload")) \
        .unionByName(f.event_payloads.where("id < 40").select((F.col("id") + 1000000000).alias("id"), F.lit("broken").alias("pms_code"), broken.alias("payload")))
    path = fresh_path(f.spark, "landed-payloads")
    payloads.landed(rows).drop("payload").write.parquet(path)
    return f.spark.read.parquet(path)


@query("payload_fields", f"""WITH {_LANDED},
docs AS (SELECT id, pms_code, payload, json_valid(payload) AS ok FROM landed),
typed AS (SELECT id, pms_code, payload, ok, CASE WHEN ok THEN json_type(payload) END AS shape FROM docs),
fields AS (SELECT id, pms_code, unnest(json_keys(payload)) AS field, payload FROM typed WHERE shape = 'OBJECT'),
kinds AS (SELECT id, pms_code, field, json_type(payload, '$."' || field || '"') AS t FROM fields
  UNION ALL SELECT id, pms_code, NULL, coalesce(shape, 'invalid') FROM typed WHERE shape IS DISTINCT FROM 'OBJECT'),
named AS (SELECT id, pms_code, field, CASE t WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
  WHEN 'NULL' THEN 'null' WHEN 'invalid' THEN 'invalid' ELSE 'number' END AS kind FROM kinds)
SELECT pms_code, field, kind, coalesce(field IN ({', '.join(repr(x) for x in payloads.KNOWN_FIELDS)}), false) AS known, count(DISTINCT id) AS payloads, min(id) AS first_id
FROM named GROUP BY ALL""")
def payload_fields(f):
    return payloads.payload_fields(_landed(f))


@query("shredded_payloads", """
SELECT id, pms_code, CAST(payload->>'$.transaction_sum' AS DOUBLE) AS transaction_sum, payload->>'$.department_id' AS department_id,
  payload->>'$.guest_email' AS guest_email FROM {pms_raw_payloads}""")
def shredded_payloads(f):
    rows = payloads.shredded(_landed(f).where("pms_code NOT IN ('broken', 'other')"), {
        "transaction_sum": ("$.transaction_sum", "double"), "department_id": ("$.department_id", "string"), "guest_email": ("$.guest_email", "string")})
    return rows.drop("document")
