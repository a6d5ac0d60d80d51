"""Named queries on what is kept up by change: stored tables, balances, postings by rule, the use of points, and change logs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from stayledger.operators import ledger, refresh, rules, search_index
from stayledger.operators.access import Principal
from stayledger.plans.binding import EVENT_DAY
from stayledger.plans.engagement import _TERMS, _grams_sql
from stayledger.plans.loyalty import _BEST_RULE, _rules
from stayledger.plans.registry import ORACLES, fx_sql, query
from stayledger.session import fresh_path
from stayledger.sources import merge, tables
from stayledger.streaming import changes, streams

# --- stored tables ----------------------------------------------------------------


@query("merge_members", """
SELECT id AS member_id, CASE WHEN id % 4 = 0 OR id % 10 = 1 THEN 'moved' ELSE city END AS city, email,
  CASE WHEN id BETWEEN 100 AND 180 THEN 'archived' ELSE status END AS status FROM {members} WHERE NOT (id BETWEEN 100 AND 180 AND id % 7 = 0)""")
def merge_members(f):
    """Two merges into stored members: new ones and moves all over the table, then an update and a deletion in a narrow range."""
    path = fresh_path(f.spark, "merged-members")
    merge.create(f.members.where("id % 4 <> 0"), path, ["id"])
    moved = f.members.where("id % 4 = 0 OR id % 10 = 1").withColumn("city", F.lit("moved"))
    merge.merge(moved, path, ["id"], update=["city"])
    left = f.members.where("id BETWEEN 100 AND 180").select("id", F.lit("archived").alias("status"))
    merge.merge(left, path, ["id"], insert=False, delete=F.col("id") % 7 == 0)
    return merge.read(f.spark, path).select(F.col("id").alias("member_id"), "city", "email", "status")


# --- balances ---------------------------------------------------------------------

#: Days a refresh is made for, and the share of the ledger that has been loaded by then.
_REFRESHES = [(date(2023, 12, 8), "id % 3 = 0"), (date(2023, 12, 20), "id % 3 = 1"), (date(2024, 1, 9), "id % 3 = 2 AND id % 2 = 0")]


def _refreshed_sql() -> str:
    parts = []
    for i, (day, _) in enumerate(_REFRESHES):
        loaded = " OR ".join(f"({c})" for _, c in _REFRESHES[:i + 1])
        parts.append(f"""SELECT DATE '{day}' AS as_of, m.id AS member_id, m.chain_group_id, CAST(m.program_id AS BIGINT) AS program_id,
  CAST(coalesce(sum(points_delta) FILTER (l.status = 'posted'), 0) AS BIGINT) AS balance_posted,
  CAST(coalesce(sum(points_delta) FILTER (l.status = 'pending'), 0) AS BIGINT) AS balance_pending,
  CAST(coalesce(sum(points_delta) FILTER (l.status = 'posted' AND expires_at <= TIMESTAMP '{day}' + INTERVAL 30 DAY), 0) AS BIGINT) AS expiring_30d,
  max(occurred_at) AS last_activity_at
FROM {{members}} m LEFT JOIN (SELECT * FROM {{event_ledger}} WHERE {loaded}) l ON l.member_id = m.id GROUP BY m.id, m.chain_group_id, m.program_id""")
    return "\nUNION ALL ".join(parts)


@query("balance_refresh", _refreshed_sql())
def balance_refresh(f):
    """Balances after each of three refreshes, every one from the new load and the queue of expiries alone."""
    folder, path = fresh_path(f.spark, "balances"), fresh_path(f.spark, "ledger-loads")
    found = None
    for load, (day, part) in enumerate(_REFRESHES):
        refresh.append_load(f.event_ledger.where(part), path, load)
        refresh.refresh(f.spark, folder, path, day)
        rows = refresh.refreshed_balances(f.members, folder).withColumn("as_of", F.lit(day))
        found = rows if found is None else found.unionByName(rows)
    return found


# --- postings by rule -------------------------------------------------------------

def _earnings(f):
    return rules.earnings(f.transactions, f.bookings, f.members, f.tiers, f.loyalty_programs, _rules(f), f.rates, indexed=True)


_EARNED = f"""ranked AS ({_BEST_RULE}),
paid AS ({fx_sql('''SELECT t.id AS transaction_id, t.booking_id, t.member_id, t.chain_group_id, t.posted_amount, t.posted_currency, t.posting_date,
    p.points_currency, p.points_expiry_months, m.program_id, m.current_tier_id, v.code AS tier_code, v.multiplier_default
  FROM {transactions} t JOIN {members} m ON m.id = t.member_id JOIN {loyalty_programs} p ON p.id = m.program_id
  LEFT JOIN {tiers} v ON v.id = m.current_tier_id WHERE t.status = 'posted' AND t.transaction_type = 'charge' ''',
  'posted_amount', 'posted_currency', 'points_currency', 'posting_date', 'payment')}),
mult AS (SELECT paid.*, rule_id, percent_of_payment AS pct, CAST(CASE WHEN tier_code = 'silver' AND silver_multiplier IS NOT NULL
    THEN CAST(silver_multiplier AS DECIMAL(8,4)) ELSE coalesce(multiplier_default, 1) END AS DECIMAL(8,4)) AS mult
  FROM paid LEFT JOIN ranked ON ranked.booking_id = paid.booking_id AND place = 1),
earned AS (SELECT *, CAST(coalesce(floor(CAST(payment AS DECIMAL(16,2)) * pct * mult * CAST(0.01 AS DECIMAL(3,2))), 0) AS BIGINT) AS points FROM mult)"""


@query("post_rule_earnings", f"""WITH {_EARNED}
SELECT chain_group_id, CAST(program_id AS BIGINT) AS program_id, member_id, 'earn_release' AS type, 'posted' AS status, points AS points_delta,
  transaction_id AS source_transaction_id, booking_id AS source_booking_id, CAST(rule_id AS BIGINT) AS rule_id, CAST(pct AS DOUBLE) AS applied_percent,
  CAST(mult AS DOUBLE) AS applied_multiplier, CAST(current_tier_id AS BIGINT) AS applied_tier_id,
  CAST(posting_date AS TIMESTAMP) + INTERVAL 23 HOUR AS occurred_at, CAST(posting_date AS TIMESTAMP) + to_months(CAST(points_expiry_months AS INTEGER)) AS expires_at
FROM earned WHERE points > 0""")
def post_rule_earnings(f):
    return ledger.post_rule_earnings(_earnings(f)).select(
        "chain_group_id", "program_id", "member_id", "type", "status", "points_delta", "source_transaction_id", "source_booking_id", "rule_id",
        "applied_percent", "applied_multiplier", "applied_tier_id", "occurred_at", "expires_at")


@query("earning_trace", f"""WITH {_EARNED}
SELECT e.booking_id, b.hotel_id, b.channel AS booking_channel, b.arrival_date, e.transaction_id, e.member_id, CAST(e.posted_amount AS DOUBLE) AS posted_amount,
  e.posted_currency, CAST(e.payment AS DOUBLE) AS payment, CAST(e.rule_id AS BIGINT) AS rule_id, CAST(r.percent_of_payment AS DOUBLE) AS rule_percent,
  CAST(r.priority AS BIGINT) AS priority, CAST(e.pct AS DOUBLE) AS applied_percent, CAST(e.mult AS DOUBLE) AS applied_multiplier, e.points,
  b.arrival_date BETWEEN r.valid_from AND coalesce(r.valid_to, b.arrival_date) AS in_force, e.points AS recomputed
FROM earned e JOIN {{bookings}} b ON b.id = e.booking_id JOIN {{points_rules}} r ON r.id = e.rule_id WHERE e.points > 0""")
def earning_trace(f):
    """Booking, charge, rule and credit, the credits read back from a stored ledger."""
    path = fresh_path(f.spark, "rule-ledger")
    tables.append(ledger.post_rule_earnings(_earnings(f)), path, "occurred_at")
    return ledger.earning_trace(tables.read_table(f.spark, path), f.transactions, f.bookings, f.points_rules)


@query("ledger_round_trip", f"""WITH {_EARNED},
written AS (SELECT 'earn_release' AS type, 'posted' AS status, CAST(round(t.bonus_earned_amount, 0) AS BIGINT) AS points_delta, t.posting_date AS day, NULL AS rule_id
  FROM {{transactions}} t JOIN {{members}} m ON m.id = t.member_id WHERE t.bonus_earned_amount > 0 AND t.status = 'posted' AND t.transaction_type = 'charge'
  UNION ALL SELECT 'earn_pending', 'pending', CAST(round(t.bonus_earned_amount, 0) AS BIGINT), t.posting_date, NULL FROM {{transactions}} t
    JOIN {{bookings}} b ON b.id = t.booking_id JOIN {{members}} m ON m.id = t.member_id WHERE t.bonus_earned_amount > 0 AND b.status = 'in_house'
  UNION ALL SELECT 'redeem', 'posted', 0 - r.points_spent, CAST(r.redemption_date AS DATE), NULL FROM {{point_redemptions}} r
    JOIN {{members}} m ON m.id = r.member_id JOIN {{rewards}} w ON w.id = r.reward_id
  UNION ALL SELECT 'earn_release', 'posted', points, posting_date, rule_id FROM earned WHERE points > 0)
SELECT CAST(date_trunc('month', day) AS DATE) AS month, type, status, rule_id IS NOT NULL AS by_rule, count(*) AS row_count,
  CAST(sum(points_delta) AS BIGINT) AS points FROM written GROUP BY ALL""")
def ledger_round_trip(f):
    """One stored ledger filled by all its writers, read back and summed."""
    path = fresh_path(f.spark, "ledger")
    tables.reload(ledger.post_earnings(f.transactions, f.members, f.loyalty_programs, f.tiers), path, "occurred_at")
    for rows in (ledger.post_pending(f.transactions, f.bookings, f.members, f.tiers),
                 ledger.post_redemptions(f.point_redemptions, f.members, f.rewards), ledger.post_rule_earnings(_earnings(f))):
        tables.append(rows, path, "occurred_at")
    return tables.read_table(f.spark, path).groupBy("month", "type", "status", F.col("rule_id").isNotNull().alias("by_rule")) \
        .agg(F.count("*").alias("row_count"), F.sum("points_delta").alias("points"))


# --- use of points ----------------------------------------------------------------

@query("points_consumption", """
WITH moves AS (SELECT *, CASE WHEN points_delta > 0 THEN expires_at ELSE occurred_at END AS due, (points_delta < 0)::INT AS spent
  FROM {event_ledger} WHERE status = 'posted' AND points_delta <> 0 AND type <> 'expire'),
run AS (SELECT *, sum(points_delta) OVER (PARTITION BY member_id ORDER BY due, spent, id ROWS UNBOUNDED PRECEDING) AS net
  FROM moves WHERE due <= TIMESTAMP '2024-01-20'),
peaks AS (SELECT *, coalesce(max(net) OVER (PARTITION BY member_id ORDER BY due, spent, id ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS earlier FROM run),
gone AS (SELECT member_id, id, due, 0 AS turn, 'expire' AS kind, net - greatest(earlier, 0) AS points FROM peaks WHERE spent = 0 AND net > greatest(earlier, 0)
  UNION ALL SELECT member_id, id, occurred_at, 1, 'redeem', 0 - points_delta FROM moves WHERE spent = 1 AND occurred_at <= TIMESTAMP '2024-01-20'),
debit AS (SELECT *, sum(points) OVER (PARTITION BY member_id ORDER BY due, turn, id ROWS UNBOUNDED PRECEDING) AS stop FROM gone),
credit AS (SELECT member_id, id, points_delta AS points, sum(points_delta) OVER (PARTITION BY member_id
  ORDER BY expires_at NULLS LAST, CASE WHEN expires_at IS NULL THEN occurred_at END, id ROWS UNBOUNDED PRECEDING) AS stop
  FROM moves WHERE spent = 0 AND occurred_at <= TIMESTAMP '2024-01-20'),
met AS (SELECT c.member_id, c.id AS credit_id, d.id AS debit_id, d.kind, least(c.stop, d.stop) - greatest(c.stop - c.points, d.stop - d.points) AS points
  FROM credit c JOIN debit d ON d.member_id = c.member_id AND d.stop > c.stop - c.points AND c.stop > d.stop - d.points),
sums AS (SELECT member_id, max(stop) AS total FROM credit GROUP BY 1), spends AS (SELECT member_id, max(stop) AS total FROM debit GROUP BY 1)
SELECT member_id, credit_id, debit_id, kind, CAST(points AS BIGINT) AS points FROM met
UNION ALL SELECT c.member_id, c.id, NULL, 'open', CAST(c.stop - greatest(c.stop - c.points, coalesce(s.total, 0)) AS BIGINT) FROM credit c
  LEFT JOIN spends s ON s.member_id = c.member_id WHERE c.stop > coalesce(s.total, 0)
UNION ALL SELECT d.member_id, NULL, d.id, d.kind, CAST(d.stop - greatest(d.stop - d.points, coalesce(s.total, 0)) AS BIGINT) FROM debit d
  LEFT JOIN sums s ON s.member_id = d.member_id WHERE d.stop > coalesce(s.total, 0)""")
def points_consumption(f):
    return ledger.points_consumption(f.event_ledger, EVENT_DAY).select("member_id", "credit_id", "debit_id", "kind", "points")


# --- change logs ------------------------------------------------------------------

@query("stream_audit", """
WITH s AS (SELECT id, chain_group_id, status, channel, total_amount, channel <> 'walk_in' AS in_1, status <> 'no_show' AS in_2, id % 5 <> 0 AND status <> 'no_show' AS in_3,
  CASE status WHEN 'in_house' THEN 'checked_out' ELSE status END AS later FROM {bookings})
SELECT CAST(2 AS BIGINT) AS snapshot, CASE WHEN NOT in_1 THEN 'insert' WHEN NOT in_2 THEN 'delete' ELSE 'update' END AS action, 'bookings' AS table_name, id AS record_id, chain_group_id,
  'u1' AS actor_user_id, CASE WHEN in_1 THEN status END AS old_status, CASE WHEN in_2 THEN later END AS new_status, CAST(NULL AS BOOLEAN) AS flagged
FROM s WHERE in_1 <> in_2 OR (in_1 AND in_2 AND status <> later)
UNION ALL SELECT 3, CASE WHEN NOT in_3 THEN 'delete' ELSE 'update' END, 'bookings', id, chain_group_id, 'u1', later, CASE WHEN in_3 THEN later END,
  CASE WHEN in_3 THEN true END FROM s WHERE in_2 AND (NOT in_3 OR id % 11 = 0)""")
def stream_audit(f):
    """Three snapshots of the bookings, announced on a stream: the log of both changes."""
    columns = ["id", "chain_group_id", "hotel_id", "member_id", "status", "channel", "total_amount"]
    done = F.when(F.col("status") == "in_house", "checked_out").otherwise(F.col("status"))
    first = f.bookings.select(*columns, F.lit(None).cast("boolean").alias("flagged"))
    second = first.where("status <> 'no_show'").withColumn("status", done)
    third = second.where("id % 5 <> 0").withColumn("flagged", F.when(F.col("id") % 11 == 0, True))
    folder, path = fresh_path(f.spark, "snapshots"), fresh_path(f.spark, "notices")
    for number, rows in enumerate((first.where("channel <> 'walk_in'"), second, third), 1):
        rows.write.parquet(f"{folder}/{number}")
        f.spark.range(1).select(F.lit(number).alias("number"), F.lit(f"{folder}/{number}").alias("folder")).write.mode("append").parquet(path)
    notices = streams.file_stream(f.spark, path, f.spark.read.parquet(path).schema, files_per_batch=1)
    log = changes.audit_stream(notices, "bookings", Principal("chain_admin", 1, sub="u1"))
    return log.select("snapshot", "action", "table_name", "record_id", "chain_group_id", "actor_user_id",
                      F.get_json_object("before_value", "$.status").alias("old_status"), F.get_json_object("after_value", "$.status").alias("new_status"),
                      F.get_json_object("after_value", "$.flagged").cast("boolean").alias("flagged"))


# --- search indexes ---------------------------------------------------------------

def _word_index(f, people):
    """An index built over most members and brought up to all of them, as changes arrive."""
    path = fresh_path(f.spark, "word-index")
    search_index.build_word_index(people.where("id % 5 <> 0").withColumn("last_name", F.when(F.col("id") % 5 == 1, "Gammel").otherwise(F.col("last_name"))), path)
    before = people.where("id % 5 = 1").withColumn("last_name", F.lit("Gammel"))
    search_index.update_word_index(before, people.where("id % 5 IN (0, 1)"), path)
    return path


@query("indexed_search", ORACLES["member_search"])
def indexed_search(f):
    return search_index.indexed_search(f.spark, _word_index(f, f.members), "Hansen anna")


@query("prefix_search", f"""
WITH h AS (SELECT member_id, chain_group_id, lexeme, CASE weight WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.4 ELSE 0.2 END AS s FROM ({_TERMS})),
b AS (SELECT member_id, chain_group_id, max(s) FILTER (lexeme LIKE 'guest1%') AS x, max(s) FILTER (lexeme LIKE 's%') AS y FROM h GROUP BY ALL)
SELECT member_id, chain_group_id, CAST(x + y AS DOUBLE) AS score FROM b WHERE x IS NOT NULL AND y IS NOT NULL""")
def prefix_search(f):
    return search_index.prefix_search(f.spark, _word_index(f, f.members), "guest1 s")


@query("indexed_fuzzy", ORACLES["fuzzy_members"])
def indexed_fuzzy(f):
    path, people = fresh_path(f.spark, "gram-index"), f.named_members
    search_index.build_gram_index(people.where("id % 5 <> 0").withColumn("full_name", F.when(F.col("id") % 5 == 1, "Bjarne").otherwise(F.col("full_name"))), path)
    before = people.where("id % 5 = 1").withColumn("full_name", F.lit("Bjarne"))
    search_index.update_gram_index(before, people.where("id % 5 IN (0, 1)"), path)
    return search_index.indexed_fuzzy(people, path, "bjorn sorensen", 0.3)


@query("fuzzy_pairs", f"""
WITH n AS (SELECT DISTINCT full_name AS t FROM {{named_members}} WHERE full_name IS NOT NULL),
g AS (SELECT t, {_grams_sql('t')} AS g FROM n),
s AS (SELECT a.t AS text, b.t AS other, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity
  FROM g a JOIN g b ON a.t < b.t)
SELECT text, other, similarity FROM s WHERE similarity >= 0.4""")
def fuzzy_pairs(f):
    return search_index.fuzzy_pairs(f.named_members, min_sim=0.4)
