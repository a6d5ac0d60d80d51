from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from stayledger.functions.fx import RateBook
from stayledger.operators import rules

RULE = ("id int, program_id int, hotel_id int, channel string, market_segment_code string, rate_group_code string, "
        "percent_of_payment decimal(5,2), tier_multiplier_override map<string,decimal(8,4)>, priority int, "
        "valid_from date, valid_to date, is_active boolean")
BOOKING = "id int, program_id int, hotel_id int, channel string, market_segment_code string, rate_group_code string, arrival_date date"
OLD, NEW = date(1970, 1, 1), date(2024, 1, 1)


@pytest.fixture(scope="module")
def rule_table(spark):
    def rule(i, pct, hotel=None, channel=None, segment=None, group=None, priority=0, since=OLD, until=None, active=True, over=None):
        return (i, 1, hotel, channel, segment, group, D(pct), over, priority, since, until, active)
    return spark.createDataFrame([
        rule(1, "1.0"), rule(2, "2.0", channel="ota", priority=200), rule(3, "3.0", segment="CGN"),
        rule(4, "4.0", hotel=7), rule(5, "5.0", hotel=7, segment="CGN"), rule(6, "6.0", hotel=7, segment="CGN", until=date(2023, 12, 31)),
        rule(7, "7.0", hotel=8, channel="direct", priority=1), rule(8, "8.0", hotel=8, channel="direct", priority=2),
        rule(9, "9.0", hotel=8, channel="direct", priority=2), rule(10, "10.0", hotel=9, active=False, priority=999),
        rule(11, "11.0", group="BAR", priority=500), rule(12, "12.0", channel="group", priority=1, over={"gold": D("2.5")}),
        rule(13, "13.0", group="MEMBER", priority=50),
    ], RULE)


CASES = [
    # hotel, channel, segment, rate group -> rule
    (1, "direct", None, None, 1), (1, "ota", None, None, 2), (1, "ota", "CGN", None, 3), (7, "ota", None, None, 4),
    (7, "ota", "CGN", None, 5), (8, "direct", "CGN", "BAR", 8), (8, "walk_in", None, "BAR", 11), (9, "direct", None, None, 1),
    (1, "direct", "CGN", "BAR", 3),
    # Rate group and channel add no level: the priority of the agency rule wins, and of the group rule over the default.
    (1, "ota", None, "MEMBER", 2), (1, "direct", None, "MEMBER", 13),
]


@pytest.mark.parametrize("limit", [None, 0])
def test_most_specific_rule(spark, rule_table, limit, monkeypatch):
    if limit is not None:
        from stayledger.functions import sizing
        monkeypatch.setattr(sizing, "MAX_ROWS", limit)
    rows = spark.createDataFrame([(i, 1, h, c, s, g, NEW) for i, (h, c, s, g, _) in enumerate(CASES)] + [(99, 2, 7, "ota", None, None, NEW)], BOOKING)
    got = {r["id"]: r["rule_id"] for r in rules.resolve_points_rule(rows, rule_table).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[-1] for c in CASES]
    assert got[99] is None                                           # no rule in that program


def test_expired_rule_applies_on_its_dates(spark, rule_table):
    rows = spark.createDataFrame([(1, 1, 7, "ota", "CGN", None, date(2023, 12, 31))], BOOKING)
    assert rules.resolve_points_rule(rows, rule_table).first()["rule_id"] in (5, 6)
    assert rules.resolve_points_rule(rows, rule_table.where("id <> 5")).first()["rule_id"] == 6
    later = rows.withColumn("arrival_date", F.lit(NEW))
    assert rules.resolve_points_rule(later, rule_table.where("id <> 5")).first()["rule_id"] == 4


def test_hotel_rules_that_outrank_the_agency_rule_are_listed(rule_table):
    assert {r["id"] for r in rules.wildcard_hotel_rules(rule_table).collect()} == {4, 5, 6}


def test_earned_points_floor_and_override(spark, rule_table):
    members = spark.createDataFrame([(1, 1, 30), (2, 1, 20), (3, 1, None)], "id int, program_id int, current_tier_id int")
    tiers = spark.createDataFrame([(20, "silver", D("1.20")), (30, "gold", D("1.50"))], "id int, code string, multiplier_default decimal(5,2)")
    programs = spark.createDataFrame([(1, "NOK")], "id int, points_currency string")
    bookings = spark.createDataFrame([(i, 1, 1, "group", None, None, NEW) for i in (1, 2, 3)], BOOKING)
    txs = spark.createDataFrame([(i, i, i, "charge", "posted", NEW, D("99.99"), "NOK") for i in (1, 2, 3)],
                                "id int, booking_id int, member_id int, transaction_type string, status string, posting_date date, "
                                "posted_amount decimal(14,2), posted_currency string")
    fx = RateBook.of(spark.createDataFrame([], "from_ccy string, to_ccy string, rate_date date, rate decimal(14,6)"))
    got = {r["member_id"]: (r["points_earned"], r["applied_multiplier"])
           for r in rules.earn_points(txs, bookings.drop("program_id"), members, tiers, programs, rule_table, fx).collect()}
    # 99.99 * 12 % = 11.9988; gold is overridden to 2.5, silver keeps its default, no tier counts once.
    assert got == {1: (29, D("2.5000")), 2: (14, D("1.2000")), 3: (11, D("1.0000"))}


def test_bonus_rounds_half_up_and_guests_earn_nothing(spark):
    members = spark.createDataFrame([(1, 20)], "id int, current_tier_id int")
    tiers = spark.createDataFrame([(20, "silver")], "id int, code string")
    rows = spark.createDataFrame([(1, 1, "corporate", "checked_out", D("0.75")), (2, 1, "corporate", "in_house", D("100.00")),
                                  (3, 1, "corporate", "cancelled", D("100.00")), (4, 1, "group", "checked_out", D("100.00")),
                                  (5, None, "direct", "checked_out", D("100.00")), (6, 1, "direct", "checked_out", D("0.10"))],
                                 "id int, member_id int, channel string, status string, paid_amount decimal(14,2)")
    got = {r["id"]: (r["bonus_percent_at_posting"], r["bonus_earned_amount"], r["bonus_released_amount"])
           for r in rules.bonus_from_lookup(rows, members, tiers, rules.bonus_table(spark)).collect()}
    zero = D("0.00")
    assert got == {1: (D("3.60"), D("0.03"), D("0.03")), 2: (D("3.60"), D("3.60"), zero), 3: (D("3.60"), zero, zero),
                   4: (zero, zero, zero), 5: (zero, zero, zero), 6: (D("5.00"), D("0.01"), D("0.01"))}


def test_refund_is_half_of_the_payment(spark):
    members = spark.createDataFrame([(1, 20)], "id int, current_tier_id int")
    tiers = spark.createDataFrame([(20, "silver")], "id int, code string")
    rows = spark.createDataFrame([(1, 1, 1, 1, "direct", "cancelled", NEW, D("10.01"), D("10.01")), (2, 1, 1, None, "ota", "no_show", NEW, D("0.00"), D("9.00")),
                                  (3, 1, 1, 1, "direct", "upcoming", NEW, D("5.00"), D("5.00")), (4, 1, 1, 1, "direct", "checked_out", NEW, None, D("6.00"))],
                                 "id int, chain_group_id int, hotel_id int, member_id int, channel string, status string, arrival_date date, "
                                 "paid_amount decimal(14,2), total_amount decimal(14,2)") \
        .selectExpr("*", "CAST(NULL AS TIMESTAMP_NTZ) AS check_out_at", "TIMESTAMP_NTZ '2023-12-24 10:00:00' AS cancelled_at", "'NOK' AS currency")
    got = {r["booking_id"]: r for r in rules.build_transactions(rows, members, tiers, rules.bonus_table(spark)).collect()}
    assert set(got) == {1, 4}                                        # nothing paid, nothing posted
    assert (got[1]["transaction_type"], got[1]["posted_amount"], got[1]["posting_date"]) == ("refund", D("-5.01"), date(2023, 12, 24))
    assert (got[4]["posted_amount"], got[4]["bonus_earned_amount"]) == (D("6.00"), D("0.00"))


def test_both_ways_to_find_a_rule_agree(frames, monkeypatch):
    from stayledger.functions import sizing
    from stayledger.plans.loyalty import _rules

    def found():
        rows = rules.resolve_points_rule(frames.bookings, _rules(frames)).select("id", "rule_id", "percent_of_payment", "tier_multiplier_override")
        return sorted((r["id"], r["rule_id"], r["percent_of_payment"], str(r["tier_multiplier_override"])) for r in rows.collect())

    few = found()
    monkeypatch.setattr(sizing, "MAX_ROWS", 0)
    assert found() == few and any(r[1] is not None for r in few)


def test_one_booking_from_payment_to_balance(spark):
    """A stay of 1 000 by a gold member, booked directly: posting, bonus, ledger row, balance."""
    from stayledger.operators import ledger
    members = spark.createDataFrame([(1, 1, 1, 30)], "id int, chain_group_id int, program_id int, current_tier_id int")
    tiers = spark.createDataFrame([(30, "gold", D("1.50"))], "id int, code string, multiplier_default decimal(5,2)")
    programs = spark.createDataFrame([(1, 24)], "id int, points_expiry_months int")
    booking = spark.createDataFrame([(5, 1, 9, 1, "direct", "checked_out", NEW, D("1000.00"), D("1000.00"))],
                                    "id int, chain_group_id int, hotel_id int, member_id int, channel string, status string, arrival_date date, "
                                    "paid_amount decimal(14,2), total_amount decimal(14,2)") \
        .selectExpr("*", "TIMESTAMP_NTZ '2024-01-03 11:00:00' AS check_out_at", "CAST(NULL AS TIMESTAMP_NTZ) AS cancelled_at", "'NOK' AS currency")
    posting = rules.build_transactions(booking, members, tiers, rules.bonus_table(spark)).withColumn("id", F.col("booking_id"))
    row = ledger.post_earnings(posting, members, programs, tiers)
    only = row.first()
    assert (only["points_delta"], only["applied_percent"], only["applied_multiplier"]) == (100, D("10.00"), D("1.50"))
    assert (str(only["occurred_at"]), str(only["expires_at"])) == ("2024-01-03 23:00:00", "2026-01-03 00:00:00")
    assert ledger.points_balances(members, row, NEW).first()["balance_posted"] == 100
