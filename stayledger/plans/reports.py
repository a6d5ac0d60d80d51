"""Named report queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayledger.operators import ledger, reports
from stayledger.plans.binding import EVENT_START, STAY_DAY
from stayledger.plans.registry import fx_sql, pct_sql, query

_TX_IN_REPORTING = fx_sql("SELECT t.*, c.reporting_currency, c.name AS chain_name FROM {transactions} t "
                          "JOIN {chain_groups} c ON c.id = t.chain_group_id",
                          "posted_amount", "posted_currency", "reporting_currency", "posting_date", "reporting")


@query("direct_booking_share", f"""
WITH m AS (SELECT chain_group_id, CAST(date_trunc('month', arrival_date) AS DATE) AS month,
    sum(CASE channel WHEN 'direct' THEN 1 ELSE 0 END) AS d, sum(CASE channel WHEN 'ota' THEN 1 ELSE 0 END) AS o,
    sum(CASE channel WHEN 'corporate' THEN 1 ELSE 0 END) AS c, CAST(count(*) AS BIGINT) AS n
  FROM {{bookings}} WHERE status IN ('upcoming', 'in_house', 'checked_out', 'no_show') GROUP BY ALL)
SELECT chain_group_id, g.name AS chain_name, month, CAST(d AS BIGINT) AS direct_count, CAST(o AS BIGINT) AS ota_count,
  CAST(c AS BIGINT) AS corporate_count, n AS total_bookings, {pct_sql('d', 'n')} AS direct_share_pct,
  {pct_sql('o', 'n')} AS ota_share_pct
FROM m JOIN {{chain_groups}} g ON g.id = m.chain_group_id""")
def direct_booking_share(f):
    return reports.direct_booking_share(f.bookings, f.chain_groups)


@query("points_balances", """
WITH rows_ AS (SELECT member_id, status, points_delta, occurred_at,
    expires_at <= TIMESTAMP '2024-02-01 00:00:00' AS soon FROM {event_ledger}),
b AS (SELECT member_id, sum(points_delta * (status = 'posted')::INT) AS p, sum(points_delta * (status = 'pending')::INT) AS q,
    sum(points_delta * (status = 'posted' AND coalesce(soon, false))::INT) AS x, max(occurred_at) AS l FROM rows_ GROUP BY 1)
SELECT m.id AS member_id, m.chain_group_id, CAST(m.program_id AS BIGINT) AS program_id, CAST(coalesce(p, 0) AS BIGINT) AS balance_posted,
  CAST(coalesce(q, 0) AS BIGINT) AS balance_pending, CAST(coalesce(x, 0) AS BIGINT) AS expiring_30d, l AS last_activity_at
FROM {members} m LEFT JOIN b ON b.member_id = m.id""")
def points_balances(f):
    return ledger.points_balances(f.members, f.event_ledger, EVENT_START)


_STAYS = """SELECT member_id, count(*) AS total, sum((status = 'checked_out')::INT) AS done,
    sum((status = 'cancelled')::INT) AS off, sum((status = 'upcoming' OR status = 'in_house')::INT) AS ahead,
    min(arrival_date) AS first_day, max(arrival_date) AS last_day,
    max(CASE WHEN status <> 'upcoming' THEN arrival_date END) AS last_past,
    min(CASE WHEN status = 'upcoming' AND arrival_date >= DATE '1998-06-01' THEN arrival_date END) AS next_day,
    sum(CASE WHEN status = 'checked_out' THEN departure_date - arrival_date END) AS nights
  FROM {bookings} GROUP BY member_id"""


@query("member_360", f"""
WITH pts AS (SELECT member_id, sum(points_delta) AS p, sum(CASE WHEN expires_at <= TIMESTAMP '1998-07-01' THEN points_delta END) AS x,
    max(occurred_at) AS l FROM {{stay_ledger}} GROUP BY 1),
stays AS ({_STAYS}),
rev AS (SELECT member_id, sum(reporting) AS r FROM ({_TX_IN_REPORTING}) z
  WHERE z.status = 'posted' AND z.transaction_type NOT IN ('refund', 'gift_card') GROUP BY 1)
SELECT m.id AS member_id, m.chain_group_id, g.name AS chain_name, CAST(m.program_id AS BIGINT) AS program_id, member_number, full_name,
  email, phone_e164, country_code, m.status, gender, birth_date, joined_at, recruitment_source, recruited_via_ota,
  CAST(current_tier_id AS BIGINT) AS current_tier_id, t.code AS tier_code, t.name AS tier_name, CAST(t.sort_order AS BIGINT) AS tier_sort_order,
  CAST(coalesce(p, 0) AS BIGINT) AS points_balance, CAST(0 AS BIGINT) AS points_pending, CAST(coalesce(x, 0) AS BIGINT) AS points_expiring_30d,
  l AS points_last_activity_at, CAST(coalesce(total, 0) AS BIGINT) AS bookings_total, CAST(coalesce(done, 0) AS BIGINT) AS bookings_completed,
  CAST(coalesce(off, 0) AS BIGINT) AS bookings_cancelled, CAST(coalesce(ahead, 0) AS BIGINT) AS bookings_upcoming,
  first_day AS first_booking_at, last_past AS last_booking_at, next_day AS next_booking_at, CAST(coalesce(nights, 0) AS BIGINT) AS nights_total,
  CAST(coalesce(r, 0) AS DOUBLE) AS revenue_lifetime_reporting, reporting_currency,
  last_past IS NULL OR (last_past < DATE '1997-06-01' AND coalesce(l, TIMESTAMP '1970-01-01') < TIMESTAMP '1997-06-01') AS is_churned
FROM {{named_members}} m LEFT JOIN {{chain_groups}} g ON g.id = m.chain_group_id LEFT JOIN {{tiers}} t ON t.id = m.current_tier_id
LEFT JOIN pts ON pts.member_id = m.id LEFT JOIN stays ON stays.member_id = m.id LEFT JOIN rev ON rev.member_id = m.id""")
def member_360(f):
    return reports.member_360(f.named_members, f.chain_groups, f.tiers, f.stay_ledger, f.bookings, f.transactions,
                              f.rates, STAY_DAY)


@query("tier_distribution", f"""
WITH c AS (SELECT chain_group_id, current_tier_id, count(*) AS n, sum((status = 'active')::INT) AS a FROM {{members}} GROUP BY 1, 2),
s AS (SELECT chain_group_id, sum(a) AS whole FROM c GROUP BY 1)
SELECT c.chain_group_id, g.name AS chain_name, CAST(t.id AS BIGINT) AS tier_id, t.code AS tier_code, t.name AS tier_name,
  CAST(t.sort_order AS BIGINT) AS sort_order, CAST(n AS BIGINT) AS member_count, CAST(a AS BIGINT) AS active_member_count,
  {pct_sql('a', 'whole')} AS active_pct
FROM c JOIN s USING (chain_group_id) JOIN {{chain_groups}} g ON g.id = c.chain_group_id LEFT JOIN {{tiers}} t ON t.id = c.current_tier_id""")
def tier_distribution(f):
    return reports.tier_distribution(f.members, f.chain_groups, f.tiers)


@query("revenue_per_member", f"""
WITH z AS ({_TX_IN_REPORTING}),
p AS (SELECT chain_group_id, chain_name, CAST(date_trunc('month', posting_date) AS DATE) AS month, reporting_currency,
    sum(reporting) AS total, count(DISTINCT member_id) AS heads, sum((reporting IS NULL)::INT) AS unknown
  FROM z WHERE status = 'posted' GROUP BY ALL)
SELECT chain_group_id, chain_name, month, reporting_currency, CAST(total AS DOUBLE) AS revenue_total_reporting,
  heads AS active_member_count, CAST(unknown AS BIGINT) AS fx_missing,
  CASE WHEN heads > 0 THEN CASE WHEN total < 0 THEN -1 ELSE 1 END * CAST((2 * CAST(abs(total) * 100 AS BIGINT) + heads) // (2 * heads) AS DOUBLE)
    / 100 END AS revenue_per_active_member FROM p""")
def revenue_per_member(f):
    return reports.revenue_per_member(f.transactions, f.chain_groups, f.rates)


@query("member_growth", """
WITH m AS (SELECT chain_group_id, make_date(year(joined_at), month(joined_at), 1) AS month, count(*) AS n FROM {members} GROUP BY 1, 2)
SELECT a.chain_group_id, g.name AS chain_name, a.month, CAST(a.n AS BIGINT) AS new_members, CAST(sum(b.n) AS BIGINT) AS cumulative_members
FROM m a JOIN m b ON a.chain_group_id = b.chain_group_id AND b.month <= a.month JOIN {chain_groups} g ON g.id = a.chain_group_id
GROUP BY 1, 2, 3, 4""")
def member_growth(f):
    return reports.member_growth(f.members, f.chain_groups)


@query("churn", f"""
WITH stay AS (SELECT member_id, max(arrival_date) AS d FROM {{bookings}} WHERE status IN ('checked_out', 'in_house') GROUP BY 1),
pts AS (SELECT member_id, max(occurred_at) AS d FROM {{stay_ledger}} GROUP BY 1),
w AS (SELECT m.chain_group_id, coalesce(stay.d < DATE '1997-06-01', true) AND coalesce(pts.d < TIMESTAMP '1997-06-01', true) AS gone
  FROM {{members}} m LEFT JOIN stay ON stay.member_id = m.id LEFT JOIN pts ON pts.member_id = m.id),
c AS (SELECT chain_group_id, count(*) AS n, sum(gone::INT) AS k FROM w GROUP BY 1)
SELECT chain_group_id, g.name AS chain_name, CAST(n AS BIGINT) AS members_total, CAST(k AS BIGINT) AS members_churned,
  {pct_sql('k', 'n')} AS churn_pct FROM c JOIN {{chain_groups}} g ON g.id = chain_group_id""")
def churn(f):
    return reports.churn(f.members, f.chain_groups, f.stay_ledger, f.bookings, STAY_DAY)


_CLV = f"""WITH stays AS ({_STAYS}),
rev AS (SELECT member_id, sum(reporting) AS r FROM ({_TX_IN_REPORTING}) z WHERE z.status = 'posted' AND transaction_type = 'charge' GROUP BY 1),
red AS (SELECT member_id, sum(points_spent) AS s FROM {{point_redemptions}} WHERE status = 'fulfilled' GROUP BY 1),
v AS (SELECT m.id AS member_id, m.chain_group_id, g.name AS chain_name, full_name, reporting_currency, CAST(coalesce(r, 0) AS DOUBLE) AS gross_revenue,
  CAST(coalesce(s, 0) AS BIGINT) AS redemption_value, CAST(coalesce(r, 0) - coalesce(s, 0) AS DOUBLE) AS net_value,
  CAST(coalesce(done, 0) AS BIGINT) AS bookings_completed, CAST(coalesce(nights, 0) AS BIGINT) AS nights_total,
  first_day AS first_booking_at, last_day AS last_booking_at
FROM {{named_members}} m JOIN {{chain_groups}} g ON g.id = m.chain_group_id LEFT JOIN stays ON stays.member_id = m.id
LEFT JOIN rev ON rev.member_id = m.id LEFT JOIN red ON red.member_id = m.id)"""


@query("clv", _CLV + " SELECT * FROM v")
def clv(f):
    return reports.clv(f.named_members, f.chain_groups, f.transactions, f.point_redemptions, f.bookings, f.rates)


@query("top_ltv", _CLV + " SELECT * FROM v ORDER BY net_value DESC, member_id LIMIT 10")
def top_ltv(f):
    return reports.top_ltv(clv(f), 10)


@query("campaign_performance", f"""
WITH r AS ({fx_sql('''SELECT x.*, c.start_date, g.reporting_currency FROM {campaign_recipients} x JOIN {campaigns} c ON c.id = x.campaign_id
    JOIN {chain_groups} g ON g.id = c.chain_group_id''', 'attributed_revenue', 'attributed_currency', 'reporting_currency', 'start_date', 'v')}),
a AS (SELECT campaign_id, count(*) AS n, sum((status IN ('delivered', 'opened', 'clicked'))::INT) AS dl, count(opened_at) AS op,
    count(clicked_at) AS cl, count(bounced_at) AS bo, count(attributed_booking_id) AS ab, sum(v) AS rv FROM r GROUP BY 1)
SELECT CAST(c.id AS BIGINT) AS campaign_id, CAST(c.chain_group_id AS BIGINT) AS chain_group_id, g.name AS chain_name, c.name AS campaign_name,
  c.channel, c.status, c.start_date, c.end_date, CAST(c.recipient_count AS BIGINT) AS recipient_count,
  coalesce(n, 0) AS recipients_actual, CAST(coalesce(dl, 0) AS BIGINT) AS delivered, coalesce(op, 0) AS opened, coalesce(cl, 0) AS clicked,
  coalesce(bo, 0) AS bounced, coalesce(ab, 0) AS attributed_bookings, CAST(coalesce(rv, 0) AS DOUBLE) AS attributed_revenue_reporting,
  g.reporting_currency FROM {{campaigns}} c JOIN {{chain_groups}} g ON g.id = c.chain_group_id LEFT JOIN a ON a.campaign_id = c.id""")
def campaign_performance(f):
    return reports.campaign_performance(f.campaigns, f.campaign_recipients, f.chain_groups, f.rates)


def _overview_sql(upper: str) -> str:
    return f"""
WITH h AS (SELECT chain_group_id, count(*) AS n FROM {{hotels}} WHERE status = 'active' GROUP BY 1),
m AS (SELECT chain_group_id, count(*) AS n FROM {{members}} WHERE status = 'active' GROUP BY 1),
b AS (SELECT chain_group_id, sum(w::INT) AS n, sum((w AND channel = 'direct')::INT) AS d, sum(u::INT) AS up FROM (
  SELECT *, arrival_date >= DATE '1997-06-01' {upper.replace('#', 'arrival_date')} AND status <> 'cancelled' AS w,
    arrival_date >= DATE '1998-06-01' AND status IN ('upcoming', 'in_house') AS u FROM {{bookings}}) GROUP BY 1),
r AS (SELECT chain_group_id, sum(reporting) AS v FROM ({_TX_IN_REPORTING}) z
  WHERE status = 'posted' AND posting_date >= DATE '1997-06-01' {upper.replace('#', 'posting_date')} GROUP BY 1)
SELECT g.id AS chain_group_id, g.name AS chain_name, g.status, g.reporting_currency, coalesce(h.n, 0) AS active_hotels,
  coalesce(m.n, 0) AS active_members, CAST(coalesce(b.n, 0) AS BIGINT) AS bookings_last_365d, CAST(coalesce(up, 0) AS BIGINT) AS bookings_upcoming,
  CAST(coalesce(v, 0) AS DOUBLE) AS revenue_last_365d_reporting, {pct_sql('d', 'b.n')} AS direct_share_pct_last_365d
FROM {{chain_groups}} g LEFT JOIN h ON h.chain_group_id = g.id LEFT JOIN m ON m.chain_group_id = g.id
LEFT JOIN b ON b.chain_group_id = g.id LEFT JOIN r ON r.chain_group_id = g.id"""


@query("chain_overview", _overview_sql(""))
def chain_overview(f):
    return reports.chain_overview(f.chain_groups, f.hotels, f.members, f.bookings, f.transactions, f.rates, STAY_DAY)


@query("chain_overview_bounded", _overview_sql("AND # <= DATE '1998-06-01'"))
def chain_overview_bounded(f):
    return reports.chain_overview(f.chain_groups, f.hotels, f.members, f.bookings, f.transactions, f.rates, STAY_DAY,
                                  bounded=True)


_HOTEL_FACTS = f"""
WITH b AS (SELECT hotel_id, count(*) AS every, sum((recent AND status = 'checked_out')::INT) AS done,
    sum(CASE WHEN recent AND status = 'checked_out' THEN departure_date - arrival_date END) AS nights,
    sum((recent AND status <> 'cancelled')::INT) AS kept, sum((recent AND status <> 'cancelled' AND channel = 'direct')::INT) AS direct,
    sum((recent AND status <> 'cancelled' AND is_member_booking)::INT) AS own
  FROM (SELECT *, arrival_date >= DATE '1997-06-01' AS recent FROM {{bookings}}) GROUP BY 1),
r AS (SELECT hotel_id, count(*) AS every, sum(CASE WHEN status = 'posted' AND posting_date >= DATE '1997-06-01' THEN reporting END) AS v
  FROM ({_TX_IN_REPORTING}) z GROUP BY 1)"""


def _hotel_sql(times_tx: str, times_bookings: str) -> str:
    return _HOTEL_FACTS + f"""
SELECT h.id AS hotel_id, h.chain_group_id, g.name AS chain_name, h.name AS hotel_name, h.country_code, CAST(h.room_count AS BIGINT) AS room_count,
  g.reporting_currency, CAST(coalesce(done, 0) * {times_tx} AS BIGINT) AS bookings_completed_365d,
  CAST(coalesce(nights, 0) * {times_tx} AS BIGINT) AS nights_365d, CAST(coalesce(v, 0) * {times_bookings} AS DOUBLE) AS revenue_365d_reporting,
  {pct_sql('direct', 'kept')} AS direct_share_pct_365d, CAST(coalesce(own, 0) * {times_tx} AS BIGINT) AS member_bookings_365d
FROM {{hotels}} h JOIN {{chain_groups}} g ON g.id = h.chain_group_id LEFT JOIN b ON b.hotel_id = h.id LEFT JOIN r ON r.hotel_id = h.id"""


def _hotels(f, **options):
    return reports.hotel_comparison(f.hotels, f.chain_groups, f.bookings, f.transactions, f.rates, STAY_DAY, **options)


@query("hotel_comparison", _hotel_sql("1", "1"))
def hotel_comparison(f):
    return _hotels(f)


@query("hotel_comparison_literal", _hotel_sql("greatest(coalesce(r.every, 0), 1)", "greatest(coalesce(b.every, 0), 1)"))
def hotel_comparison_literal(f):
    return _hotels(f, literal_fanout=True)


@query("fx_convert", fx_sql("SELECT id AS booking_id, total_amount, currency, arrival_date, reporting_currency FROM {bookings} b "
                            "JOIN (SELECT id AS chain, reporting_currency FROM {chain_groups}) ON chain = b.chain_group_id",
                            "total_amount", "currency", "reporting_currency", "arrival_date", "converted_")
       .replace("SELECT s.*,", "SELECT s.booking_id, s.currency, s.reporting_currency, s.arrival_date, "
                "CAST(s.total_amount AS DOUBLE) AS total_amount, CAST(", 1).replace("END AS converted_", "END AS DOUBLE) AS converted", 1))
def fx_convert(f):
    rows = f.bookings.join(f.chain_groups.select(F.col("id").alias("chain_group_id"), "reporting_currency"), "chain_group_id")
    return f.rates.convert(rows.select(F.col("id").alias("booking_id"), "total_amount", "currency", "arrival_date",
                                       "reporting_currency"),
                           "total_amount", "currency", "reporting_currency", "arrival_date", "converted")
