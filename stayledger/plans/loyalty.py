"""Named queries on the points ledger, earning rules and tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayledger.operators import ledger, rules, tiers
from stayledger.plans.binding import EVENT_DAY, EVENT_START, STAY_DAY
from stayledger.plans.registry import fx_sql, query


def _rules(f):
    """The rules frame with its override column as a map from tier code to multiplier."""
    override = F.when(F.col("silver_multiplier").isNotNull(),
                      F.create_map(F.lit("silver"), F.col("silver_multiplier").cast("decimal(8,4)")))
    return f.points_rules.withColumn("tier_multiplier_override", override)


def _ratio_cents(amount: str, n: str) -> str:
    """DuckDB: amount / n rounded to cents in whole-number arithmetic."""
    cents = f"CAST({amount} * 100 AS BIGINT)"
    return f"sign({cents}) * ((2 * abs({cents}) + {n}) // (2 * {n})) / 100.0"


_BEST_RULE = """SELECT b.id AS booking_id, r.id AS rule_id, r.percent_of_payment, r.silver_multiplier,
    row_number() OVER (PARTITION BY b.id ORDER BY CASE WHEN r.hotel_id IS NOT NULL AND r.market_segment_code IS NOT NULL THEN 1
      WHEN r.hotel_id IS NOT NULL THEN 2 WHEN r.market_segment_code IS NOT NULL THEN 3 ELSE 4 END, r.priority DESC, r.id) AS place
  FROM {bookings} b JOIN {points_rules} r ON r.program_id = b.program_id AND r.is_active
    AND b.arrival_date >= r.valid_from AND b.arrival_date <= coalesce(r.valid_to, b.arrival_date)
    AND coalesce(r.hotel_id = b.hotel_id, r.hotel_id IS NULL) AND coalesce(r.channel = b.channel, r.channel IS NULL)
    AND (r.market_segment_code IS NULL OR r.market_segment_code IS NOT DISTINCT FROM b.market_segment_code)
    AND (r.rate_group_code IS NULL OR r.rate_group_code IS NOT DISTINCT FROM b.rate_group_code)"""


@query("resolve_points_rule", f"""
WITH ranked AS ({_BEST_RULE})
SELECT b.id AS booking_id, b.hotel_id, b.channel, CAST(rule_id AS BIGINT) AS rule_id, CAST(percent_of_payment AS DOUBLE) AS percent_of_payment
FROM {{bookings}} b LEFT JOIN ranked ON booking_id = b.id AND place = 1""")
def resolve_points_rule(f):
    return rules.resolve_points_rule(f.bookings, _rules(f)) \
        .select(F.col("id").alias("booking_id"), "hotel_id", "channel", "rule_id", "percent_of_payment")


@query("earn_points", f"""
WITH ranked AS ({_BEST_RULE}),
paid AS ({fx_sql('''SELECT t.id AS transaction_id, t.booking_id, t.member_id, t.posted_amount, t.posted_currency, t.posting_date,
    p.points_currency, v.code AS tier_code, v.multiplier_default
  FROM {transactions} t JOIN {members} m ON m.id = t.member_id JOIN {loyalty_programs} p ON p.id = m.program_id
  LEFT JOIN {tiers} v ON v.id = m.current_tier_id WHERE t.status = 'posted' AND t.transaction_type = 'charge' ''',
  'posted_amount', 'posted_currency', 'points_currency', 'posting_date', 'payment')}),
x AS (SELECT paid.*, rule_id, percent_of_payment AS pct, CAST(CASE WHEN tier_code = 'silver' AND silver_multiplier IS NOT NULL
    THEN CAST(silver_multiplier AS DECIMAL(8,4)) ELSE coalesce(multiplier_default, 1) END AS DECIMAL(8,4)) AS mult
  FROM paid LEFT JOIN ranked ON ranked.booking_id = paid.booking_id AND place = 1)
SELECT transaction_id, booking_id, member_id, CAST(rule_id AS BIGINT) AS rule_id, tier_code, CAST(pct AS DOUBLE) AS applied_percent,
  CAST(mult AS DOUBLE) AS applied_multiplier, CAST(payment AS DOUBLE) AS payment,
  CAST(coalesce(floor(CAST(payment AS DECIMAL(16,2)) * pct * mult * CAST(0.01 AS DECIMAL(3,2))), 0) AS BIGINT) AS points_earned FROM x""")
def earn_points(f):
    return rules.earn_points(f.transactions, f.bookings, f.members, f.tiers, f.loyalty_programs, _rules(f), f.rates)


@query("rule_in_force", """
SELECT b.id AS booking_id, b.channel, r.id AS rule_id FROM {bookings} b LEFT JOIN {points_rules} r
  ON r.program_id = b.program_id AND r.channel = b.channel AND b.arrival_date BETWEEN r.valid_from AND coalesce(r.valid_to, DATE '9999-01-01')""")
def rule_in_force(f):
    channel_rules = f.points_rules.select("program_id", "channel", F.col("id").alias("rule_id"), "valid_from", "valid_to")
    rows = rules.valid_range_join(f.bookings, channel_rules, ["program_id", "channel"], "arrival_date")
    return rows.select(F.col("id").alias("booking_id"), "channel", "rule_id")


@query("open_hotel_rules", """
SELECT id AS rule_id, hotel_id, CAST(percent_of_payment AS DOUBLE) AS percent_of_payment, bookings FROM {points_rules}
JOIN (SELECT hotel_id, count(*) AS bookings FROM {bookings} WHERE channel = 'ota' GROUP BY 1) USING (hotel_id)
WHERE is_active AND channel IS NULL AND percent_of_payment > 0""")
def open_hotel_rules(f):
    exposed = f.bookings.where(F.col("channel") == "ota").groupBy("hotel_id").agg(F.count("*").alias("bookings"))
    return rules.wildcard_hotel_rules(f.points_rules).join(exposed, "hotel_id") \
        .select(F.col("id").alias("rule_id"), "hotel_id", "percent_of_payment", "bookings")


_BONUS = f"""
WITH rate(tier_code, channel, pct) AS (VALUES {", ".join(f"('{t}', '{c}', {p})" for t, c, p in rules.BONUS_PERCENT)}),""" + """
bonus AS (SELECT b.*, coalesce(CAST(r.pct AS DECIMAL(5,2)), 0) AS pct,
    round(b.paid_amount * coalesce(CAST(r.pct AS DECIMAL(5,2)), 0) * CAST(0.01 AS DECIMAL(3,2)), 2) AS amount
  FROM {bookings} b LEFT JOIN {members} m ON m.id = b.member_id LEFT JOIN {tiers} t ON t.id = m.current_tier_id
  LEFT JOIN rate r ON r.tier_code = t.code AND r.channel = b.channel AND b.member_id IS NOT NULL)"""


@query("bonus_from_lookup", _BONUS + """
SELECT id AS booking_id, CAST(pct AS DOUBLE) AS bonus_percent_at_posting,
  CAST(CASE WHEN status = 'cancelled' THEN 0 ELSE amount END AS DOUBLE) AS bonus_earned_amount,
  CAST(CASE WHEN status = 'checked_out' THEN amount ELSE 0 END AS DOUBLE) AS bonus_released_amount FROM bonus""")
def bonus_from_lookup(f):
    return rules.bonus_from_lookup(f.bookings, f.members, f.tiers, rules.bonus_table(f.spark)) \
        .select(F.col("id").alias("booking_id"), "bonus_percent_at_posting", "bonus_earned_amount", "bonus_released_amount")


@query("build_transactions", _BONUS + """
SELECT chain_group_id, hotel_id, id AS booking_id, member_id, '4' || left(md5(CAST(id AS VARCHAR)), 12) AS external_transaction_id,
  CASE status WHEN 'cancelled' THEN 'refund' ELSE 'charge' END AS transaction_type, 'posted' AS status,
  CASE status WHEN 'checked_out' THEN departure_date WHEN 'cancelled' THEN CAST(cancelled_at AS DATE) ELSE arrival_date END AS posting_date,
  arrival_date AS transaction_date,
  CAST(CASE WHEN status = 'cancelled' THEN round(paid_amount * CAST(-0.5 AS DECIMAL(2,1)), 2) ELSE paid_amount END AS DOUBLE) AS posted_amount,
  currency AS posted_currency, CAST(paid_amount AS DOUBLE) AS paid_amount, CAST(pct AS DOUBLE) AS bonus_percent_at_posting,
  CAST(CASE WHEN status = 'cancelled' THEN 0 ELSE amount END AS DOUBLE) AS bonus_earned_amount,
  CAST(CASE WHEN status = 'checked_out' THEN amount ELSE 0 END AS DOUBLE) AS bonus_released_amount,
  CAST(0 AS DOUBLE) AS giftcard_applied_amount, channel = 'ota' AS is_ota,
  CASE channel WHEN 'ota' THEN 'OTA' WHEN 'direct' THEN 'Direct' WHEN 'corporate' THEN 'Corporate' ELSE 'Other' END AS segment_label
FROM bonus WHERE status <> 'upcoming' AND paid_amount > 0""")
def build_transactions(f):
    return rules.build_transactions(f.bookings, f.members, f.tiers, rules.bonus_table(f.spark))


@query("split_transaction_lines", f"""
WITH s AS (SELECT t.*, b.nights, b.status AS stay, CAST('0x' || left(md5(CAST(t.id AS VARCHAR) || 'extras'), 8) AS BIGINT) AS h,
    CAST('0x' || left(md5(CAST(t.id AS VARCHAR) || 'kind'), 8) AS BIGINT) % 3 AS k
  FROM {{transactions}} t JOIN {{bookings}} b ON b.id = t.booking_id)
SELECT id AS transaction_id, posted_currency AS currency, 'Accommodation' AS product_type, CAST(greatest(nights, 1) AS DOUBLE) AS quantity,
  CASE WHEN nights > 0 THEN {_ratio_cents('posted_amount', 'nights')} ELSE CAST(posted_amount AS DOUBLE) END AS unit_amount,
  CAST(round(posted_amount * CAST(0.92 AS DECIMAL(3,2)), 2) AS DOUBLE) AS amount, CAST(1 AS DOUBLE) AS bonus_factor FROM s
UNION ALL
SELECT id, posted_currency, CASE k WHEN 0 THEN 'Food' WHEN 1 THEN 'Beverage' ELSE 'Spa' END, CAST(1 AS DOUBLE),
  CAST(round(posted_amount * CAST(0.08 AS DECIMAL(3,2)), 2) AS DOUBLE), CAST(round(posted_amount * CAST(0.08 AS DECIMAL(3,2)), 2) AS DOUBLE),
  CAST(0.5 AS DOUBLE) FROM s WHERE stay = 'checked_out' AND h < CASE WHEN member_id IS NULL THEN 644245094 ELSE 1288490188 END""")
def split_transaction_lines(f):
    return rules.split_transaction_lines(f.transactions, f.bookings)


_EARNING_COLUMNS = """t.chain_group_id, CAST(m.program_id AS BIGINT) AS program_id, t.member_id,
  CAST(round(t.bonus_earned_amount, 0) AS BIGINT) AS points_delta, t.id AS source_transaction_id, t.booking_id AS source_booking_id,
  CAST(t.bonus_percent_at_posting AS DOUBLE) AS applied_percent, CAST(coalesce(v.multiplier_default, 1) AS DOUBLE) AS applied_multiplier,
  CAST(m.current_tier_id AS BIGINT) AS applied_tier_id, CAST(t.posting_date AS TIMESTAMP) + INTERVAL 23 HOUR AS occurred_at"""
_EARNING = ["chain_group_id", "program_id", "member_id", "points_delta", "source_transaction_id", "source_booking_id",
            "applied_percent", "applied_multiplier", "applied_tier_id", "occurred_at"]


def _post_sql(extra: str) -> str:
    return f"""SELECT {_EARNING_COLUMNS}, 'earn_release' AS type, 'posted' AS status,
  CAST(t.posting_date AS TIMESTAMP) + to_months(CAST(p.points_expiry_months AS INTEGER)) AS expires_at,
  t.external_transaction_id AS reference
FROM {{transactions}} t JOIN {{members}} m ON m.id = t.member_id JOIN {{loyalty_programs}} p ON p.id = m.program_id
LEFT JOIN {{tiers}} v ON v.id = m.current_tier_id
WHERE t.bonus_earned_amount > 0 AND t.status = 'posted' AND t.transaction_type = 'charge' {extra}"""


def _posted(rows):
    return rows.select(*_EARNING, "type", "status", "expires_at",
                       F.get_json_object("metadata", "$.transaction_external_id").alias("reference"))


@query("post_earnings", _post_sql(""))
def post_earnings(f):
    return _posted(ledger.post_earnings(f.transactions, f.members, f.loyalty_programs, f.tiers))


@query("post_earnings_settled", _post_sql("AND t.booking_id NOT IN (SELECT id FROM {bookings} WHERE status = 'in_house')"))
def post_earnings_settled(f):
    return _posted(ledger.post_earnings(f.transactions, f.members, f.loyalty_programs, f.tiers, f.bookings))


@query("post_pending", f"""SELECT {_EARNING_COLUMNS}, 'earn_pending' AS type, 'pending' AS status
FROM {{transactions}} t JOIN {{bookings}} b ON b.id = t.booking_id JOIN {{members}} m ON m.id = t.member_id
LEFT JOIN {{tiers}} v ON v.id = m.current_tier_id WHERE t.bonus_earned_amount > 0 AND b.status = 'in_house'""")
def post_pending(f):
    return ledger.post_pending(f.transactions, f.bookings, f.members, f.tiers).select(*_EARNING, "type", "status")


@query("post_redemptions", """
SELECT r.chain_group_id, CAST(m.program_id AS BIGINT) AS program_id, r.member_id, 'redeem' AS type, 'posted' AS status,
  0 - r.points_spent AS points_delta, r.id AS reward_redemption_id, CAST(m.current_tier_id AS BIGINT) AS applied_tier_id,
  r.redemption_date AS occurred_at, 'Reward redemption: ' || w.name AS reason
FROM {point_redemptions} r JOIN {members} m ON m.id = r.member_id JOIN {rewards} w ON w.id = r.reward_id""")
def post_redemptions(f):
    return ledger.post_redemptions(f.point_redemptions, f.members, f.rewards).select(
        "chain_group_id", "program_id", "member_id", "type", "status", "points_delta", "reward_redemption_id",
        "applied_tier_id", "occurred_at", "reason")


@query("expire_points", """
WITH moves AS (SELECT *, CASE WHEN points_delta > 0 THEN expires_at ELSE occurred_at END AS due, (points_delta < 0)::INT AS spent
  FROM {event_ledger} WHERE status = 'posted' AND points_delta <> 0 AND type <> 'expire'),
run AS (SELECT *, sum(points_delta) OVER (PARTITION BY member_id ORDER BY due, spent, id ROWS UNBOUNDED PRECEDING) AS net
  FROM moves WHERE due <= TIMESTAMP '2024-01-20'),
peaks AS (SELECT *, coalesce(max(net) OVER (PARTITION BY member_id ORDER BY due, spent, id ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS earlier FROM run)
SELECT chain_group_id, CAST(program_id AS BIGINT) AS program_id, member_id, id AS credit_id, 'expire' AS type, 'posted' AS status,
  CAST(greatest(earlier, 0) - net AS BIGINT) AS points_delta, due AS occurred_at FROM peaks WHERE spent = 0 AND net > greatest(earlier, 0)""")
def expire_points(f):
    return ledger.expire_points(f.event_ledger, EVENT_DAY)


@query("reconcile_bonus", """
WITH l AS (SELECT source_transaction_id AS id, sum(points_delta) AS points FROM {stay_ledger} WHERE status = 'posted'
  AND type = 'earn_release' GROUP BY 1)
SELECT t.id AS transaction_id, CAST(round(t.bonus_earned_amount, 0) AS BIGINT) AS expected_points,
  CAST(coalesce(l.points, 0) AS BIGINT) AS ledger_points,
  CAST(coalesce(l.points, 0) - round(t.bonus_earned_amount, 0) AS BIGINT) AS difference
FROM {transactions} t LEFT JOIN l ON l.id = t.id WHERE coalesce(l.points, 0) <> round(t.bonus_earned_amount, 0)""")
def reconcile_bonus(f):
    return ledger.reconcile_bonus(f.stay_ledger, f.transactions)


@query("eligible_rewards", """
WITH b AS (SELECT member_id, sum(points_delta) AS balance FROM {event_ledger} WHERE status = 'posted' GROUP BY 1)
SELECT m.id AS member_id, CAST(m.program_id AS BIGINT) AS program_id, w.id AS reward_id, w.code AS reward_code,
  CAST(w.cost_points AS BIGINT) AS cost_points, CAST(balance - w.cost_points AS BIGINT) AS balance_after
FROM {members} m JOIN b ON b.member_id = m.id JOIN {rewards} w ON w.program_id = m.program_id AND w.cost_points <= balance
LEFT JOIN {tiers} own ON own.id = m.current_tier_id LEFT JOIN {tiers} need ON need.id = w.min_tier_id
WHERE w.is_active AND w.hotel_id IS NULL AND coalesce(w.inventory_remaining, 1) > 0
  AND coalesce(w.valid_from, DATE '1998-06-01') <= DATE '1998-06-01' AND coalesce(w.valid_to, DATE '1998-06-01') >= DATE '1998-06-01'
  AND (w.min_tier_id IS NULL OR own.sort_order >= need.sort_order)""")
def eligible_rewards(f):
    balances = ledger.points_balances(f.members, f.event_ledger, EVENT_START)
    return rules.eligible_rewards(f.members, f.rewards, f.tiers, balances, STAY_DAY)


_METRICS = f"""
WITH facts AS (
  SELECT member_id, 'points' AS metric, points_delta AS v, CAST(occurred_at AS DATE) AS d FROM {{stay_ledger}}
  UNION ALL SELECT member_id, 'nights', nights, arrival_date FROM {{bookings}} WHERE status = 'checked_out'
  UNION ALL SELECT member_id, 'revenue', reporting, posting_date FROM ({fx_sql('''SELECT t.*, c.reporting_currency FROM {transactions} t
    JOIN {chain_groups} c ON c.id = t.chain_group_id''', 'posted_amount', 'posted_currency', 'reporting_currency', 'posting_date', 'reporting')}) z
    WHERE status = 'posted' AND transaction_type IN ('charge', 'adjustment')),
valid AS (SELECT * FROM {{tier_thresholds}} WHERE valid_from <= DATE '1998-06-01' AND coalesce(valid_to, DATE '1998-06-01') >= DATE '1998-06-01'),
tests AS (SELECT m.id AS member_id, t.id AS tier_id, t.sort_order, v.metric, v.min_value, m.current_tier_id,
    coalesce((SELECT sum(f.v) FROM facts f WHERE f.member_id = m.id AND f.metric = v.metric AND f.d <= DATE '1998-06-01'
      AND f.d > DATE '1998-06-01' - to_months(v.qualifying_period_months)), 0) AS reached
  FROM {{members}} m JOIN {{tiers}} t ON t.program_id = m.program_id JOIN valid v ON v.tier_id = t.id)"""


def _qualify_sql(test: str) -> str:
    return _METRICS + f""",
passed AS (SELECT member_id, tier_id, sort_order FROM tests GROUP BY 1, 2, 3 HAVING {test}(reached >= min_value)),
best AS (SELECT member_id, arg_max(tier_id, sort_order) AS tier_id, max(sort_order) AS sort_order FROM passed GROUP BY 1)
SELECT m.id AS member_id, CAST(m.program_id AS BIGINT) AS program_id, CAST(m.current_tier_id AS BIGINT) AS current_tier_id,
  CAST(coalesce(b.tier_id, i.id) AS BIGINT) AS qualified_tier_id, CAST(coalesce(b.sort_order, 1) AS BIGINT) AS qualified_sort_order,
  CASE WHEN c.id IS NULL THEN 'initial' WHEN coalesce(b.sort_order, 1) > c.sort_order THEN 'promote'
    WHEN coalesce(b.sort_order, 1) < c.sort_order THEN 'demote' ELSE 'keep' END AS change
FROM {{members}} m LEFT JOIN best b ON b.member_id = m.id LEFT JOIN {{tiers}} c ON c.id = m.current_tier_id
LEFT JOIN {{tiers}} i ON i.program_id = m.program_id AND i.sort_order = 1"""


def metrics_of(f):
    return tiers.qualifying_metrics(f.tier_thresholds, f.stay_ledger, f.bookings, f.transactions, f.chain_groups,
                                    f.rates, STAY_DAY)


@query("qualify_tiers", _qualify_sql("bool_or"))
def qualify_tiers(f):
    return tiers.qualify_tiers(f.members, f.tiers, f.tier_thresholds, metrics_of(f), STAY_DAY)


@query("qualify_tiers_all", _qualify_sql("bool_and"))
def qualify_tiers_all(f):
    return tiers.qualify_tiers(f.members, f.tiers, f.tier_thresholds, metrics_of(f), STAY_DAY, combine="all")


@query("tier_progress", _METRICS + """,
p AS (SELECT x.member_id, min(x.tier_id) AS tier_id, max(((20000 * CAST(x.reached * 100 AS BIGINT) + CAST(x.min_value * 100 AS BIGINT))
    // (2 * CAST(x.min_value * 100 AS BIGINT))) / 100.0) AS pct
  FROM tests x LEFT JOIN {tiers} c ON c.id = x.current_tier_id WHERE x.sort_order = coalesce(c.sort_order, 0) + 1 GROUP BY 1)
SELECT m.id AS member_id, CAST(m.current_tier_id AS BIGINT) AS current_tier_id, CAST(p.pct AS DOUBLE) AS tier_progress_pct,
  CAST(p.tier_id AS BIGINT) AS next_tier_id FROM {members} m LEFT JOIN p ON p.member_id = m.id""")
def tier_progress(f):
    return tiers.tier_progress_pct(f.members, f.tiers, f.tier_thresholds, metrics_of(f), STAY_DAY)


@query("tier_history", """
SELECT m.id AS member_id, CAST(NULL AS BIGINT) AS from_tier_id, CAST(m.current_tier_id AS BIGINT) AS to_tier_id,
  'initial_assignment' AS change_reason, joined_at AS effective_at FROM {members} m WHERE m.current_tier_id IS NOT NULL
UNION ALL
SELECT m.id, CAST(b.id AS BIGINT), CAST(m.current_tier_id AS BIGINT), 'qualified_by_points', joined_at + INTERVAL 60 DAY FROM {members} m
JOIN {tiers} t ON t.id = m.current_tier_id JOIN {tiers} b ON b.program_id = t.program_id AND b.sort_order = t.sort_order - 1""")
def tier_history(f):
    return tiers.tier_history(f.members, f.tiers)


@query("flag_attributes", """
SELECT m.id AS member_id, a.attr_key, a.attr_value, 'segment_evaluation' AS source, TIMESTAMP '1998-06-01' AS set_at
FROM {members} m JOIN {tiers} t ON t.id = m.current_tier_id AND t.sort_order > 3,
  (VALUES ('vip', 'true'), ('high_value_flag', '"watchlist"')) AS a(attr_key, attr_value)""")
def flag_attributes(f):
    return tiers.flag_attributes(f.members, f.tiers, STAY_DAY)
