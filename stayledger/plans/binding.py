"""Loyalty frames derived from the star-schema tables of the test data.

Every frame is one SQL text that Spark and DuckDB both run, so an operator and its
check start from the same rows. ``{name}`` refers to a raw table or to another frame,
``{ts}`` is the zone-free timestamp type.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession

# The raw tables with their columns, given so that no footer has to be read first.
RAW_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# The days the time-dependent queries are run for.
STAY_DAY = date(1998, 6, 1)
LAST_STAY_DAY = date(2001, 8, 1)
EVENT_DAY = date(2024, 1, 20)
EVENT_START = date(2024, 1, 2)

_CURRENCY = """CASE {k} WHEN 0 THEN 'NOK' WHEN 1 THEN 'SEK' WHEN 2 THEN 'DKK' WHEN 3 THEN 'EUR' ELSE 'ISK' END"""
_HOTEL_INDEX = "(n_nationkey + CAST(FLOOR(n_nationkey / 5) AS INT)) % 5"

FRAMES: dict[str, str] = {}

FRAMES["chain_groups"] = """
SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, CASE WHEN r_regionkey = 4 THEN 'paused' ELSE 'active' END AS status,
  """ + _CURRENCY.replace("{k}", "r_regionkey") + """ AS default_currency,
  CASE r_regionkey WHEN 2 THEN 'EUR' WHEN 3 THEN 'SEK' WHEN 4 THEN 'DKK' ELSE 'NOK' END AS reporting_currency
FROM {region}"""

FRAMES["loyalty_programs"] = """
SELECT CAST(100 + r_regionkey AS BIGINT) AS id, CAST(r_regionkey AS BIGINT) AS chain_group_id,
  CASE WHEN r_regionkey = 1 THEN 'SEK' ELSE 'NOK' END AS points_currency,
  CASE WHEN r_regionkey <> 4 THEN 24 END AS points_expiry_months
FROM {region}"""

FRAMES["tiers"] = """
SELECT CAST((100 + r_regionkey) * 10 + t.sort_order AS BIGINT) AS id, CAST(100 + r_regionkey AS BIGINT) AS program_id,
  CAST(r_regionkey AS BIGINT) AS chain_group_id,
  t.code, upper(t.code) AS name, t.sort_order, CAST(t.mult AS DECIMAL(5,2)) AS multiplier_default,
  t.sort_order = 1 AS is_default_initial
FROM {region} JOIN (VALUES ('bronze', 1, '1.0'), ('silver', 2, '1.2'), ('gold', 3, '1.5'), ('platinum', 4, '1.8'),
  ('black', 5, '2.2')) AS t(code, sort_order, mult) ON r_regionkey >= 0"""

FRAMES["tier_thresholds"] = """
SELECT id AS tier_id, t.metric, CAST(t.min_value AS DECIMAL(14,2)) AS min_value, t.months AS qualifying_period_months,
  CAST('1970-01-01' AS DATE) AS valid_from, CAST(t.valid_to AS DATE) AS valid_to
FROM {tiers} JOIN (VALUES (2, 'points', 5000, 12, NULL), (3, 'points', 15000, 12, NULL), (4, 'points', 40000, 12, NULL),
  (5, 'points', 100000, 24, NULL), (3, 'nights', 6, 12, NULL), (4, 'nights', 12, 12, NULL), (2, 'nights', 1, 12, '1996-01-01'),
  (5, 'revenue', 900000, 12, NULL)) AS t(step, metric, min_value, months, valid_to) ON sort_order = t.step"""

FRAMES["hotels"] = """
SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS chain_group_id, n_name AS name,
  CASE WHEN n_nationkey % 8 = 7 THEN 'closed' ELSE 'active' END AS status,
  CASE n_nationkey % 5 WHEN 0 THEN 'NO' WHEN 1 THEN 'SE' WHEN 2 THEN 'DK' WHEN 3 THEN 'FI' ELSE 'IS' END AS country_code,
  50 + 3 * n_nationkey AS room_count,
  """ + _CURRENCY.replace("{k}", _HOTEL_INDEX) + """ AS default_currency,
  CASE n_nationkey % 4 WHEN 0 THEN 'stayntouch' WHEN 1 THEN 'mews' WHEN 2 THEN 'protel_air' ELSE 'visbook' END AS default_pms
FROM {nation}"""

FRAMES["hotel_pms_connections"] = """
SELECT id AS hotel_id, default_pms AS pms_code, CAST(2400 + id AS STRING) AS external_property_id,
  id % 9 <> 8 AS is_active
FROM {hotels}"""

# ISK has rates to NOK only in one direction, SEK only from SEK, and none to DKK;
# EUR to DKK starts two years after its opposite.
FRAMES["currency_rates"] = """
SELECT p.from_ccy, p.to_ccy, CAST(y.y || '-' || q.q || '-01' AS DATE) AS rate_date,
  CAST(CAST(p.base AS DECIMAL(14,6)) * CAST(q.w AS DECIMAL(4,3)) * CAST(y.w AS DECIMAL(4,3)) AS DECIMAL(14,6)) AS rate
FROM (VALUES ('SEK', 'NOK', '1.04', 1996), ('NOK', 'SEK', '0.97', 1996), ('DKK', 'NOK', '1.54', 1996),
    ('EUR', 'NOK', '11.5', 1997), ('NOK', 'EUR', '0.087', 1996), ('ISK', 'NOK', '0.079', 1996),
    ('EUR', 'SEK', '11.5', 1996), ('DKK', 'EUR', '0.134', 1996), ('EUR', 'DKK', '7.46', 1998),
    ('DKK', 'SEK', '1.51', 1997), ('SEK', 'ISK', '13.1', 1996)) AS p(from_ccy, to_ccy, base, since)
JOIN (VALUES (1996, '1.000'), (1997, '1.013'), (1998, '0.991'), (1999, '1.024'), (2000, '1.007'), (2001, '0.985')) AS y(y, w)
  ON y.y >= p.since
JOIN (VALUES ('01', '1.000'), ('04', '1.011'), ('07', '0.993'), ('10', '1.003')) AS q(q, w) ON length(q.q) = 2"""

FRAMES["members"] = """
SELECT c_custkey AS id, CAST(n_regionkey AS BIGINT) AS chain_group_id, CAST(100 + n_regionkey AS BIGINT) AS program_id,
  CASE WHEN c_custkey % 17 <> 0 THEN 'M-' || CAST(c_custkey AS STRING) END AS member_number,
  CASE c_custkey % 7 WHEN 0 THEN 'Anna' WHEN 1 THEN 'Bjørn' WHEN 2 THEN 'Carl Erik' WHEN 3 THEN 'Dagny' WHEN 4 THEN 'Eva'
    WHEN 5 THEN 'Finn' END AS first_name,
  CASE c_custkey % 11 WHEN 0 THEN 'Hansen' WHEN 1 THEN 'Olsen' WHEN 2 THEN 'Sørensen' WHEN 3 THEN 'Lund' WHEN 4 THEN 'Berg'
    WHEN 5 THEN 'Strand' WHEN 6 THEN 'Nielsen' WHEN 7 THEN 'Virtanen' WHEN 8 THEN 'Jonsson' WHEN 9 THEN 'Moen' END AS last_name,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 97 = 5 THEN 'Guest' || CAST(c_custkey AS STRING) || '@example.com'
    ELSE 'guest' || CAST(c_custkey AS STRING) || '@example.com' END AS email,
  CASE WHEN c_custkey % 9 <> 0 THEN '+47' || CAST(40000000 + c_custkey - CASE WHEN c_custkey % 211 = 1 THEN 25 ELSE 0 END
    AS STRING) END AS phone_e164,
  CASE n_nationkey % 5 WHEN 0 THEN 'NO' WHEN 1 THEN 'SE' WHEN 2 THEN 'DK' WHEN 3 THEN 'FI' ELSE 'IS' END AS country_code,
  n_name AS city,
  CASE WHEN c_custkey % 20 = 3 THEN CAST('1800-01-01' AS DATE)
    ELSE CAST('1955-01-01' AS DATE) + CAST(c_custkey * 37 % 18250 AS INT) END AS birth_date,
  CASE c_custkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' ELSE 'unknown' END AS gender,
  CASE WHEN c_custkey % 20 < 17 THEN 'active' WHEN c_custkey % 20 = 17 THEN 'inactive' WHEN c_custkey % 20 = 18
    THEN 'suspended' ELSE 'archived' END AS status,
  CAST(CAST('1994-01-01' AS DATE) + CAST(c_custkey % 850 AS INT) AS {ts}) + INTERVAL '10' HOUR AS joined_at,
  CASE WHEN c_custkey % 40 <> 0 THEN CAST((100 + n_regionkey) * 10 + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1
    WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END AS BIGINT) END AS current_tier_id,
  CASE c_custkey % 4 WHEN 0 THEN 'widget_signup' WHEN 1 THEN 'referral' WHEN 2 THEN 'admin_manual' ELSE 'AuthOtp' END
    AS recruitment_source,
  c_custkey % 10 < 3 AS recruited_via_ota,
  CASE WHEN c_custkey % 3 = 0 THEN '[{"Type":"' || CASE c_custkey % 5 WHEN 0 THEN 'FMOldId' WHEN 1 THEN 'SJprioId'
      WHEN 2 THEN 'GuestConnectId' WHEN 3 THEN 'PMSGuestId' ELSE 'Other' END || '","Value":"LEG'
    || CAST(c_custkey - c_custkey % 30 AS STRING) || '","ValidFromUtc":"2018-03-0' || CAST(1 + c_custkey % 9 AS STRING)
    || ' 00:00:00","IsValid":' || CAST(c_custkey % 2 AS STRING) || '},{"Type":"PMSGuestId","Value":"P'
    || CAST(c_custkey AS STRING) || '","ValidFromUtc":"2019-01-01 00:00:00","IsValid":1}]' END AS external_membership_raw
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""

FRAMES["named_members"] = """
SELECT *, nullif(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')), '') AS full_name FROM {members}"""

FRAMES["bookings"] = """
SELECT o.id, CAST(n_regionkey AS BIGINT) AS chain_group_id, CAST(n_nationkey AS BIGINT) AS hotel_id,
  CASE WHEN o.id % 20 < 13 THEN c_custkey END AS member_id, CAST(100 + n_regionkey AS BIGINT) AS program_id,
  CASE n_nationkey % 4 WHEN 0 THEN 'stayntouch' WHEN 1 THEN 'mews' WHEN 2 THEN 'protel_air' ELSE 'visbook' END AS pms_code,
  CAST(1000000 + o.id AS STRING) AS pms_reservation_no, upper(substring(md5(CAST(1000000 + o.id AS STRING)), 1, 8))
    AS pms_confirmation_code,
  o.channel, o.status, o.arrival_date, o.arrival_date + o.nights AS departure_date,
  CASE WHEN o.status IN ('in_house', 'checked_out') THEN CAST(o.arrival_date AS {ts}) + INTERVAL '15' HOUR END AS check_in_at,
  CASE WHEN o.status = 'checked_out' THEN CAST(o.arrival_date + o.nights AS {ts}) + INTERVAL '11' HOUR END AS check_out_at,
  CASE WHEN o.status = 'cancelled' THEN CAST(o.arrival_date - CAST(1 + o.id % 30 AS INT) AS {ts}) END AS cancelled_at,
  CASE WHEN o.id % 50 <> 9 THEN CAST(o.arrival_date - CAST(32 + o.id % 60 AS INT) AS {ts}) END AS booked_at,
  o.nights, CASE WHEN o.id % 20 = 4 THEN 2 ELSE 1 END AS num_rooms, o.amount AS total_amount,
  CASE WHEN o.status IN ('checked_out', 'in_house', 'cancelled') THEN o.amount ELSE CAST(0 AS DECIMAL(14,2)) END AS paid_amount,
  """ + _CURRENCY.replace("{k}", _HOTEL_INDEX) + """ AS currency,
  o.id % 20 < 13 AS is_member_booking, CASE WHEN o.id % 20 < 13 THEN o.id % 5 < 2 END AS returning_member,
  CASE o.id % 3 WHEN 0 THEN 'CGN' WHEN 1 THEN 'WEB' END AS market_segment_code,
  CASE o.id % 4 WHEN 0 THEN 'BAR' WHEN 1 THEN 'MEMBER' WHEN 2 THEN 'GROUP-NEGO' END AS rate_group_code
FROM (SELECT o_orderkey AS id, o_custkey, CAST(o_orderdate AS DATE) AS arrival_date, CAST(o_totalprice AS DECIMAL(14,2)) AS amount,
    CAST(CASE WHEN o_orderkey % 41 = 7 THEN 0 ELSE 1 + o_orderkey % 7 END AS INT) AS nights,
    CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'direct' WHEN '2' THEN 'ota' WHEN '3' THEN 'corporate' WHEN '4' THEN 'group'
      ELSE 'walk_in' END AS channel,
    CASE o_orderstatus WHEN 'F' THEN 'checked_out' WHEN 'O' THEN 'upcoming' ELSE
      CASE o_orderkey % 4 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'no_show' WHEN 2 THEN 'in_house' ELSE 'checked_out' END END AS status
  FROM {orders}) o
JOIN {customer} ON o.o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""

FRAMES["transactions"] = """
SELECT b.id, b.chain_group_id, b.hotel_id, b.id AS booking_id, b.member_id, '4' || substring(md5(CAST(b.id AS STRING)), 1, 12)
    AS external_transaction_id,
  CASE WHEN b.status = 'cancelled' THEN 'refund' WHEN b.id % 17 = 3 THEN 'adjustment' WHEN b.id % 19 = 5 THEN 'gift_card'
    ELSE 'charge' END AS transaction_type,
  CASE WHEN b.id % 50 = 0 THEN 'pending' ELSE 'posted' END AS status,
  CASE WHEN b.status = 'cancelled' THEN b.arrival_date ELSE b.departure_date END AS posting_date,
  CAST(CASE WHEN b.status = 'cancelled' THEN round(b.paid_amount * CAST('-0.5' AS DECIMAL(3,1)), 2) ELSE b.paid_amount END
    AS DECIMAL(14,2)) AS posted_amount,
  b.currency AS posted_currency, b.paid_amount,
  CAST(CASE WHEN b.member_id IS NULL OR b.channel = 'ota' THEN 0 ELSE b.id % 4 * 3 END AS DECIMAL(5,2)) AS bonus_percent_at_posting,
  CAST(CASE WHEN b.member_id IS NULL OR b.channel = 'ota' OR b.status = 'cancelled' THEN 0
    ELSE round(b.paid_amount * CAST(b.id % 4 * 3 AS DECIMAL(5,2)) * CAST('0.01' AS DECIMAL(3,2)), 2) END AS DECIMAL(14,2))
    AS bonus_earned_amount,
  b.channel = 'ota' AS is_ota
FROM {bookings} b WHERE b.status IN ('checked_out', 'in_house', 'cancelled')"""

# Credits from stays, debits from redemptions: dates in the range of the bookings.
FRAMES["stay_ledger"] = """
SELECT t.id, t.chain_group_id, 100 + t.chain_group_id AS program_id, t.member_id, 'earn_release' AS type, 'posted' AS status,
  CAST(round(t.bonus_earned_amount, 0) AS BIGINT) + CASE WHEN t.id % 71 = 2 THEN 10 ELSE 0 END AS points_delta,
  t.id AS source_transaction_id,
  CAST(t.posting_date AS {ts}) + INTERVAL '23' HOUR AS occurred_at,
  CAST(t.posting_date + 730 AS {ts}) AS expires_at
FROM {transactions} t
WHERE t.bonus_earned_amount > 0 AND t.status = 'posted' AND t.transaction_type = 'charge'"""

FRAMES["event_ledger"] = """
SELECT event_id AS id, CAST(n_regionkey AS BIGINT) AS chain_group_id, CAST(100 + n_regionkey AS BIGINT) AS program_id, user_id AS member_id,
  CASE event_type WHEN 'purchase' THEN 'earn_release' WHEN 'view' THEN 'earn_pending' WHEN 'click' THEN 'redeem'
    WHEN 'signup' THEN 'manual_adjustment' ELSE 'reverse' END AS type,
  CASE event_type WHEN 'view' THEN 'pending' WHEN 'error' THEN 'reversed' ELSE 'posted' END AS status,
  CAST(round(CAST(value AS DECIMAL(14,2)), 0) AS BIGINT) * CASE WHEN event_type IN ('click', 'error') THEN -1 ELSE 1 END
    AS points_delta,
  ts AS occurred_at, CASE WHEN event_type = 'purchase' THEN ts + INTERVAL '8' DAY END AS expires_at
FROM {events} JOIN {customer} ON user_id = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""

FRAMES["rewards"] = """
SELECT CAST(r_regionkey * 100 + t.no AS BIGINT) AS id, CAST(100 + r_regionkey AS BIGINT) AS program_id, t.code, t.code AS name, t.cost AS cost_points,
  CASE WHEN t.step IS NOT NULL THEN CAST((100 + r_regionkey) * 10 + t.step AS BIGINT) END AS min_tier_id,
  CASE WHEN t.no = 6 THEN CAST(r_regionkey AS BIGINT) END AS hotel_id, t.stock AS inventory_remaining,
  CAST(t.valid_from AS DATE) AS valid_from, CAST(t.valid_to AS DATE) AS valid_to, t.no <> 7 AS is_active
FROM {region} JOIN (VALUES (0, 'free-night', 1200, NULL, NULL, '1997-01-01', '2000-12-31'), (1, 'late-checkout', 80, 2, NULL, NULL, NULL),
  (2, 'room-upgrade', 350, 3, NULL, NULL, NULL), (3, 'restaurant', 500, NULL, 0, NULL, NULL), (4, 'spa', 900, 3, 5, NULL, NULL),
  (5, 'suite', 1500, 4, NULL, NULL, '1997-12-31'), (6, 'lounge', 250, NULL, NULL, NULL, NULL),
  (7, 'retired', 10, NULL, NULL, NULL, NULL)) AS t(no, code, cost, step, stock, valid_from, valid_to) ON r_regionkey >= 0"""

FRAMES["point_redemptions"] = """
SELECT event_id AS id, CAST(n_regionkey AS BIGINT) AS chain_group_id, user_id AS member_id, n_regionkey * 100 + event_id % 8 AS reward_id,
  CAST(1 + floor(value) AS BIGINT) AS points_spent, ts AS redemption_date,
  CASE WHEN event_id % 10 < 7 THEN 'fulfilled' WHEN event_id % 10 = 7 THEN 'pending' ELSE 'cancelled' END AS status
FROM {events} JOIN {customer} ON user_id = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
WHERE event_type = 'click'"""

FRAMES["campaigns"] = """
SELECT t.id, t.chain_group_id, t.name, 'email' AS channel, t.status, CAST(t.start_date AS DATE) AS start_date,
  CAST(t.end_date AS DATE) AS end_date, t.recipient_count
FROM (VALUES (0, 0, 'newsletter', 'completed', '1998-01-05', '1998-01-05', 150), (1, 1, 'winback', 'completed', '1999-02-15', '1999-03-15', 80),
  (2, 2, 'summer', 'completed', '2000-06-01', NULL, 500), (3, 3, 'spa week', 'scheduled', NULL, NULL, 20),
  (4, 4, 'nordic', 'completed', '1999-03-01', '1999-03-09', 60), (5, 0, 'early bird', 'completed', '1995-05-01', '1995-05-09', 3),
  (6, 1, 'club', 'sending', '2001-01-01', NULL, 1000), (7, 2, 'tier up', 'completed', '1997-11-01', NULL, 200),
  (8, 3, 'empty', 'draft', '1999-01-01', NULL, 0)) AS t(id, chain_group_id, name, status, start_date, end_date, recipient_count)"""

FRAMES["campaign_recipients"] = """
SELECT event_id % 8 AS campaign_id, user_id AS member_id,
  CASE event_type WHEN 'click' THEN 'clicked' WHEN 'view' THEN 'opened' WHEN 'error' THEN 'bounced' WHEN 'purchase' THEN 'delivered'
    ELSE 'sent' END AS status,
  ts AS sent_at, CASE WHEN event_type IN ('view', 'click') THEN ts + INTERVAL '2' HOUR END AS opened_at,
  CASE WHEN event_type = 'click' THEN ts + INTERVAL '3' HOUR END AS clicked_at,
  CASE WHEN event_type = 'error' THEN ts END AS bounced_at,
  CASE WHEN event_type = 'purchase' THEN event_id END AS attributed_booking_id,
  CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(14,2)) END AS attributed_revenue,
  CASE WHEN event_type = 'purchase' THEN """ + _CURRENCY.replace("{k}", "event_id % 5") + """ END AS attributed_currency
FROM (SELECT *, row_number() OVER (PARTITION BY event_id % 8, user_id ORDER BY event_id) AS rn FROM {events}) e WHERE rn = 1"""

# Campaign messages on the days around the bookings, for attribution.
FRAMES["stay_touches"] = """
SELECT l_orderkey % 8 AS campaign_id, o_custkey AS member_id,
  CAST(CAST(o_orderdate AS DATE) - CAST(30 + l_linenumber * 13 AS INT) AS {ts}) AS sent_at
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""

FRAMES["points_rules"] = """
SELECT CAST(r_regionkey * 1000 + t.no AS BIGINT) AS id, CAST(100 + r_regionkey AS BIGINT) AS program_id,
  CASE WHEN t.at_hotel THEN CAST(r_regionkey + 5 * (t.no % 5) AS BIGINT) END AS hotel_id, t.channel, t.segment AS market_segment_code,
  t.rate_group AS rate_group_code, CAST(t.pct AS DECIMAL(5,2)) AS percent_of_payment, t.priority,
  CAST(t.valid_from AS DATE) AS valid_from, CAST(t.valid_to AS DATE) AS valid_to, t.no <> 9 AS is_active,
  t.silver AS silver_multiplier
FROM {region} JOIN (VALUES (0, FALSE, 'direct', NULL, NULL, '5.0', 100, '1970-01-01', NULL, '1.0'),
  (1, FALSE, 'corporate', NULL, NULL, '3.0', 100, '1970-01-01', NULL, '1.2'), (2, FALSE, 'group', NULL, NULL, '1.0', 100, '1970-01-01', NULL, NULL),
  (3, FALSE, 'ota', NULL, NULL, '0.0', 200, '1970-01-01', NULL, NULL), (4, TRUE, NULL, NULL, NULL, '7.0', 10, '1997-01-01', '1999-12-31', NULL),
  (5, TRUE, NULL, 'CGN', NULL, '9.0', 10, '1970-01-01', NULL, '2.5'), (6, FALSE, NULL, 'WEB', NULL, '4.0', 5, '1996-01-01', NULL, NULL),
  (7, FALSE, NULL, NULL, 'MEMBER', '6.0', 50, '1970-01-01', '1998-06-30', NULL), (8, FALSE, 'direct', NULL, NULL, '8.0', 100, '1999-01-01', NULL, NULL),
  (9, TRUE, 'direct', 'WEB', 'BAR', '50.0', 999, '1970-01-01', NULL, NULL), (10, TRUE, 'direct', NULL, NULL, '11.0', 1, '1970-01-01', NULL, NULL)
  ) AS t(no, at_hotel, channel, segment, rate_group, pct, priority, valid_from, valid_to, silver) ON r_regionkey >= 0"""

FRAMES["pms_imports"] = """
SELECT id AS id, CASE WHEN id % 6 <> 5 THEN chain_group_id END AS chain_group_id, id AS hotel_id, default_pms AS pms_code FROM {hotels}"""

FRAMES["pms_raw_payloads"] = """
SELECT b.id, b.hotel_id AS import_id, b.pms_code, CAST(b.arrival_date AS {ts}) AS ingested_at,
  CASE b.pms_code
    WHEN 'stayntouch' THEN '{"reservation_number":' || b.no || ',"department_id":"' || CAST(2400 + b.hotel_id AS STRING)
      || '","arrival_time":"' || CAST(b.arrival_date AS STRING) || ' 15:00:00","departure_time":"' || CAST(b.departure_date AS STRING)
      || ' 11:00:00","reservation_source":"StayNTouchIntegration","source_code":"' || CASE b.channel WHEN 'corporate' THEN 'Company direct'
      WHEN 'direct' THEN 'Brand.com' ELSE 'none' END || '","transaction_sum":' || CAST(b.total_amount AS STRING) || ',"currency":"' || b.currency
      || '"' || CASE WHEN b.id % 6 = 0 THEN '' ELSE ',"guest_email":"Guest' || CAST(b.id % 1000 AS STRING) || '@example.com"' END || '}'
    WHEN 'mews' THEN '{"enterprise":"House ' || CAST(b.hotel_id AS STRING) || '","department_id":"' || CAST(2400 + b.hotel_id AS STRING)
      || '","reservation_nr":"' || b.no || '","origin":"' || CASE WHEN b.channel = 'ota' THEN 'ChannelManager' ELSE 'Direct' END
      || '","channel_manager":"' || CASE WHEN b.channel = 'ota' THEN 'Booking.com' ELSE '' END || '","rate_group":"'
      || coalesce(b.rate_group_code, 'Flex') || '","business_segment":"Rack rate","bill_amount":' || CAST(b.total_amount AS STRING)
      || ',"bill_currency":"' || CASE WHEN b.id % 10 = 2 THEN 'USD' ELSE b.currency END || '","booking_start":' || CAST(36000 + b.id % 900 AS STRING)
      || '.625,"booking_end":' || CAST(36000 + b.id % 900 + b.nights AS STRING) || '.4375,"guest_email":"m' || CAST(b.id % 1000 AS STRING)
      || '@example.com"}'
    WHEN 'protel_air' THEN '{"reservation_id":"PR-' || b.no || '","department_id":"' || CAST(2400 + b.hotel_id AS STRING) || '","amount":'
      || CAST(b.total_amount AS STRING) || ',"currency":"' || b.currency || '"}'
    ELSE '{"booking_id":"VB-' || b.no || '","department_id":"' || CASE WHEN b.id % 7 = 1 THEN '1' ELSE CAST(2400 + b.hotel_id AS STRING) END
      || '","amount":' || CAST(b.total_amount AS STRING) || ',"currency":"' || b.currency || '","guest_email":"v@example.com"}' END AS payload,
  b.no AS reservation_no
FROM (SELECT *, CAST(id - CASE WHEN id % 16 = 5 THEN 1 ELSE 0 END AS STRING) AS no FROM {bookings}) b"""

# Users of the back office, the hotels they look after, log entries (some without a chain) and rejected feed rows.
FRAMES["admin_users"] = """
SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'platform_admin' WHEN 1 THEN 'chain_admin' ELSE 'hotel_staff' END AS app_role,
  CASE WHEN c_custkey % 3 <> 0 THEN CAST(n_regionkey AS BIGINT) END AS chain_group_id, c_custkey % 8 <> 7 AS is_active
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 10 = 0"""

FRAMES["admin_user_hotel_assignments"] = """
SELECT u.id * 100 + h.id AS id, u.id AS admin_user_id, h.id AS hotel_id FROM {admin_users} u JOIN {hotels} h ON h.chain_group_id = u.chain_group_id
WHERE u.app_role = 'hotel_staff'"""

FRAMES["audit_log"] = """
SELECT event_id AS id, ts AS occurred_at, 'update' AS action, 'bookings' AS table_name, CASE WHEN event_id % 7 <> 0 THEN CAST(n_regionkey AS BIGINT) END AS chain_group_id
FROM {events} JOIN {customer} ON user_id = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""

FRAMES["pms_sync_errors"] = """
SELECT id, import_id, 'DUP_RESV' AS error_code FROM {pms_raw_payloads} WHERE id % 16 = 5"""

FRAMES["event_payloads"] = """
SELECT event_id AS id, user_id % 25 AS import_id, 'other' AS pms_code, ts AS ingested_at, props AS payload FROM {events}"""

FRAMES["order_payloads"] = """
SELECT l_orderkey * 8 + l_linenumber AS transaction_id, 'NOK' AS currency,
  '[{"ProductType":"Accommodation","Quantity":' || CAST(CAST(l_quantity AS INT) AS STRING) || ',"Sum":' || CAST(CAST(l_extendedprice
  AS DECIMAL(14,2)) AS STRING) || ',"LineInfo":"RoomType:' || CAST(l_partkey AS STRING) || '","BonusFactor":1.0},{"ProductType":"'
  || CASE l_returnflag WHEN 'A' THEN 'Food' WHEN 'N' THEN 'Beverage' ELSE 'Spa' END || '","Quantity":1,"Sum":'
  || CAST(CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(14,2)) AS STRING) || ',"BonusFactor":0.5}]' AS order_lines
FROM {lineitem}"""

FRAMES["member_consents"] = """
SELECT user_id AS member_id, CASE event_id % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'sms' WHEN 2 THEN 'offer' ELSE 'user_agreement' END
    AS consent_type,
  event_type <> 'error' AS granted, CAST(CAST(ts AS DATE) AS {ts}) AS granted_at FROM {events}"""

FRAMES["communications"] = """
SELECT event_id AS id, CAST(n_regionkey AS BIGINT) AS chain_group_id, CAST(n_nationkey AS BIGINT) AS hotel_id, user_id AS member_id,
  CASE WHEN event_type IN ('view', 'click') THEN 'email' ELSE 'sms' END AS channel,
  CASE WHEN event_type <> 'error' THEN ts END AS sent_at, 1 AS sms_logical_count,
  CAST(1 + event_id % 3 AS INT) AS sms_real_count
FROM {events} JOIN {customer} ON user_id = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""

FRAMES["automations"] = """
SELECT t.id, t.chain_group_id, t.code, t.trigger_type FROM (VALUES (0, 0, 'post-ota-invitation', 'ota_booking_received'),
  (1, 1, 'birthday-greeting', 'birthday'), (2, 2, 'inactive-winback', 'inactive_member'), (3, 3, 'unused', 'anniversary'))
  AS t(id, chain_group_id, code, trigger_type)"""

# Segments and flows as stored rows; a flow may be limited to a segment.
FRAMES["segments"] = """
SELECT CAST(t.id AS BIGINT) AS id, CAST(t.chain_group_id AS BIGINT) AS chain_group_id, t.code, t.definition, t.code <> 'retired' AS is_active
FROM (VALUES (1, 0, 'gold-up', '{"type":"and","children":[{"type":"member.tier_sort_order","op":">=","value":3},{"type":"member.status","value":"active"}]}'),
  (2, 1, 'lost', '{"type":"member_attr","key":"is_churned","op":"=","value":true}'),
  (3, 2, 'found-by-agency', '{"type":"or","children":[{"type":"member.recruited_via_ota","value":true},{"type":"member.bookings_total","op":">","value":14}]}'),
  (4, 3, 'birthday', '{"type":"member.birthday_month","value":"current"}'), (5, 4, 'everyone', '{"type":"all"}'),
  (6, 0, 'nobody', '{"type":"and","children":[{"type":"member.status","value":"active"},{"type":"member.status","value":"archived"}]}'),
  (7, 1, 'not-active', '{"type":"not","children":[{"type":"member.status","op":"=","value":"active"}]}'),
  (8, 2, 'near-upgrade', '{"type":"member_attr","key":"tier_progress_pct","op":">=","value":40}'),
  (9, 3, 'retired', '{"type":"all"}')) AS t(id, chain_group_id, code, definition)"""

FRAMES["flows"] = """
SELECT t.id, CAST(t.chain_group_id AS BIGINT) AS chain_group_id, t.trigger_type, t.status, t.trigger_config, CAST(t.segment_id AS BIGINT) AS segment_id
FROM (VALUES (0, 0, 'ota_booking_received', 'active', '{"delay_minutes":7,"filters":{"channel":"ota"}}', 1),
  (1, 1, 'ota_booking_received', 'active', '{"delay_minutes":7}', NULL), (2, 1, 'inactive_member', 'active', '{"days_inactive":400}', 2),
  (3, 3, 'birthday', 'active', '{"send_at_local":"09:00"}', 4), (4, 4, 'birthday', 'active', NULL, 5), (5, 2, 'check_out', 'active', '{}', 3),
  (6, 0, 'birthday', 'paused', NULL, NULL)) AS t(id, chain_group_id, trigger_type, status, trigger_config, segment_id)"""

FRAMES["automation_runs"] = """
SELECT event_id % 3 AS automation_id, user_id AS member_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running'
  WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'completed' END AS status FROM {events}"""

FRAMES["communication_templates"] = """
SELECT DISTINCT event_type AS code, 'email' AS channel, 'Hello ' || event_type AS body_template FROM {events}"""

_REF = re.compile(r"\{([a-z_]+)\}")


def duckdb_sql(query: str) -> str:
    """``query`` with the frames it names as common table expressions, for DuckDB."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _REF.findall(text):
            if name in FRAMES and name not in needed:
                visit(FRAMES[name])
                needed.append(name)

    visit(query)

    def plain(text: str) -> str:
        return _REF.sub(lambda m: "TIMESTAMP" if m[1] == "ts" else m[1], text)

    body = plain(query).strip()
    if not needed:
        return body
    heads = ",\n".join(f"{n} AS ({plain(FRAMES[n]).strip()})" for n in needed)
    return f"WITH {heads}" + (",\n" + body[4:].lstrip() if body[:5].upper() == "WITH " else "\n" + body)


class Frames:
    """The frames over one data folder as DataFrames, each built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._built: dict[str, DataFrame] = {}
        self._rates = None

    _open: dict[tuple[int, str], "Frames"] = {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> "Frames":
        """The frames over a folder, shared by the queries of a session (plans only, no data)."""
        known = cls._open.get((id(spark), folder))
        if known is None or known.spark is not spark:
            known = cls._open[(id(spark), folder)] = cls(spark, folder)
        return known

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in FRAMES and name not in RAW_TABLES):
            raise AttributeError(name)
        return self.frame(name)

    def frame(self, name: str) -> DataFrame:
        if name not in self._built:
            if name in RAW_TABLES:
                self._built[name] = self.spark.read.schema(RAW_TABLES[name]).parquet(f"{self.folder}/{name}.parquet")
            else:
                self._built[name] = self.sql(FRAMES[name])
        return self._built[name]

    def sql(self, text: str) -> DataFrame:
        """Run a text with frame references; each referenced frame becomes a session view of its own name."""
        def view(m: re.Match) -> str:
            if m[1] == "ts":
                return "TIMESTAMP_NTZ"
            self.frame(m[1]).createOrReplaceTempView(f"stayledger_{m[1]}")
            return f"stayledger_{m[1]}"

        return self.spark.sql(_REF.sub(view, text))

    @property
    def rates(self):
        """The conversion book of the frame's currency rates, built once."""
        if self._rates is None:
            from stayledger.functions.fx import RateBook
            self._rates = RateBook.of(self.frame("currency_rates")).persisted()
        return self._rates
