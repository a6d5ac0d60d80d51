from datetime import date, datetime
from decimal import Decimal as D

import pytest

from stayledger.functions.fx import RateBook
from stayledger.operators import reports

AS_OF = date(2024, 6, 15)
BOOKING = ("id int, chain_group_id int, hotel_id int, member_id int, channel string, status string, arrival_date date, "
           "nights int, is_member_booking boolean")
TX = ("id int, chain_group_id int, hotel_id int, member_id int, transaction_type string, status string, "
      "posting_date date, posted_amount decimal(14,2), posted_currency string")
POINT = "member_id int, status string, points_delta bigint, occurred_at timestamp_ntz, expires_at timestamp_ntz"


@pytest.fixture(scope="module")
def world(spark):
    chains = spark.createDataFrame([(1, "A", "active", "NOK"), (2, "B", "active", "EUR")],
                                   "id int, name string, status string, reporting_currency string")
    hotels = spark.createDataFrame([(10, 1, "h10", "active"), (11, 1, "h11", "closed"), (12, 1, "h12", "active"), (13, 2, "h13", "active")],
                                   "id int, chain_group_id int, name string, status string") \
        .selectExpr("*", "'NO' AS country_code", "10 AS room_count")
    rates = spark.createDataFrame([("ISK", "NOK", date(2024, 1, 1), D("0.1"))],
                                  "from_ccy string, to_ccy string, rate_date date, rate decimal(14,6)")
    members = spark.createDataFrame(
        [(i, 1 if i < 7 else 2, 5 if i == 1 else None, "active" if i < 7 else "archived") for i in range(1, 9)],
        "id int, chain_group_id int, current_tier_id int, status string").selectExpr(
        "*", "9 AS program_id", "CAST('2023-01-05' AS TIMESTAMP_NTZ) AS joined_at", "concat('n', id) AS full_name",
        *[f"CAST(NULL AS STRING) AS {c}" for c in ("member_number", "email", "phone_e164", "country_code", "gender",
                                                   "recruitment_source")],
        "CAST(NULL AS DATE) AS birth_date", "false AS recruited_via_ota")
    tiers = spark.createDataFrame([(5, "gold", "Gold", 3)], "id int, code string, name string, sort_order int")
    bookings = spark.createDataFrame([
        (1, 1, 10, 1, "direct", "checked_out", date(2023, 6, 15), 2, True),      # exactly twelve months ago
        (2, 1, 10, 2, "ota", "checked_out", date(2023, 6, 14), 3, True),         # a day longer
        (3, 1, 10, 3, "ota", "cancelled", date(2024, 6, 1), 4, True),            # only cancelled
        (4, 1, 12, 4, "direct", "upcoming", date(2024, 7, 1), 1, True),          # only upcoming
        (5, 1, 12, None, "corporate", "no_show", date(2024, 5, 1), 1, False),
        (6, 1, 10, 1, "direct", "upcoming", date(2024, 9, 1), 5, True)], BOOKING)
    txs = spark.createDataFrame([
        (1, 1, 10, 1, "charge", "posted", date(2024, 3, 1), D("100.00"), "NOK"),
        (2, 1, 10, 1, "refund", "posted", date(2024, 3, 2), D("-40.00"), "NOK"),
        (3, 1, 10, 1, "adjustment", "posted", date(2024, 3, 3), D("7.00"), "ISK"),
        (4, 1, 10, None, "charge", "posted", date(2024, 3, 4), D("50.00"), "NOK"),
        (5, 1, 11, 2, "charge", "pending", date(2024, 3, 4), D("999.00"), "NOK"),
        (6, 1, 11, 2, "charge", "posted", date(2023, 12, 31), D("10.00"), "ISK"),   # before the first rate
        (7, 1, 11, None, "charge", "posted", date(2022, 1, 1), D("5.00"), "NOK")], TX)
    points = spark.createDataFrame([
        (2, "posted", 5, datetime(2024, 1, 1), None), (5, "posted", 5, datetime(2024, 1, 1), None),
        (6, "pending", 5, datetime(2023, 1, 1), None)], POINT)
    return dict(chains=chains, hotels=hotels, members=members, tiers=tiers, bookings=bookings, txs=txs, points=points,
                fx=RateBook.of(rates))


def test_churn_needs_both_conditions(world):
    got = {r["chain_group_id"]: r for r in reports.churn(world["members"], world["chains"], world["points"],
                                                         world["bookings"], AS_OF).collect()}
    # Members 3, 4 and 6 are gone: 1 stayed within the year, 2 and 5 have recent points.
    assert (got[1]["members_total"], got[1]["members_churned"], got[1]["churn_pct"]) == (6, 3, D("50.00"))
    assert got[2]["churn_pct"] == D("100.00")


def test_member_360(world):
    w = world
    rows = reports.member_360(w["members"], w["chains"], w["tiers"], w["points"], w["bookings"], w["txs"], w["fx"], AS_OF)
    assert len(rows.columns) == 34
    got = {r["member_id"]: r for r in rows.collect()}
    # No past booking means churned even with recent points; a cancelled one counts as past.
    assert [got[i]["is_churned"] for i in range(1, 7)] == [False, False, False, True, True, True]
    assert got[3]["last_booking_at"] == date(2024, 6, 1)
    assert got[1]["revenue_lifetime_reporting"] == D("100.70")       # no refund, adjustment converted
    assert got[2]["revenue_lifetime_reporting"] == 0                 # no rate: the row drops out
    assert (got[1]["next_booking_at"], got[1]["nights_total"], got[1]["bookings_upcoming"]) == (date(2024, 9, 1), 2, 1)
    assert (got[8]["bookings_total"], got[8]["tier_code"], got[8]["chain_name"]) == (0, None, "B")


def test_tier_distribution(world):
    got = {(r["chain_group_id"], r["tier_id"]): r
           for r in reports.tier_distribution(world["members"], world["chains"], world["tiers"]).collect()}
    assert got[(1, 5)]["active_pct"] == D("16.67") and got[(1, None)]["member_count"] == 5
    assert got[(2, None)]["active_pct"] is None                      # nobody active in the chain


def test_revenue_per_member(world):
    got = {(r["chain_group_id"], r["month"]): r
           for r in reports.revenue_per_member(world["txs"], world["chains"], world["fx"]).collect()}
    march = got[(1, date(2024, 3, 1))]
    assert (march["revenue_total_reporting"], march["active_member_count"]) == (D("110.70"), 1)
    assert march["revenue_per_active_member"] == D("110.70")
    guests = got[(1, date(2022, 1, 1))]
    assert guests["revenue_per_active_member"] is None and guests["active_member_count"] == 0
    unknown = got[(1, date(2023, 12, 1))]
    assert unknown["revenue_total_reporting"] is None and unknown["fx_missing"] == 1


def test_clv_takes_charges_only(world, spark):
    spent = spark.createDataFrame([(1, 30, "fulfilled"), (1, 99, "cancelled")], "member_id int, points_spent int, status string")
    rows = reports.clv(world["members"], world["chains"], world["txs"], spent, world["bookings"], world["fx"])
    got = {r["member_id"]: r for r in rows.collect()}
    assert (got[1]["gross_revenue"], got[1]["redemption_value"], got[1]["net_value"]) == (D("100.00"), 30, D("70.00"))
    assert got[1]["last_booking_at"] == date(2024, 9, 1)             # any status, also in the future
    assert [r["member_id"] for r in reports.top_ltv(rows, 2).collect()] == [1, 2]


def test_overview_windows(world):
    w = world
    args = (w["chains"], w["hotels"], w["members"], w["bookings"], w["txs"], w["fx"], AS_OF)
    got = {r["chain_group_id"]: r for r in reports.chain_overview(*args).collect()}
    assert (got[1]["bookings_last_365d"], got[1]["bookings_upcoming"], got[1]["active_hotels"]) == (3, 2, 2)
    assert got[2]["direct_share_pct_last_365d"] is None and got[2]["revenue_last_365d_reporting"] == 0
    bounded = {r["chain_group_id"]: r for r in reports.chain_overview(*args, bounded=True).collect()}
    assert bounded[1]["bookings_last_365d"] == 1


def hotels_by_hand(world, as_of_floor):
    """Join both facts row by row, as the literal form does."""
    out = {}
    bookings, txs = world["bookings"].collect(), world["txs"].collect()
    for h in world["hotels"].collect():
        bs = [b for b in bookings if b["hotel_id"] == h["id"]] or [None]
        ts = [t for t in txs if t["hotel_id"] == h["id"]] or [None]
        done = nights = own = revenue = 0
        for b in bs:
            for t in ts:
                if b and b["arrival_date"] >= as_of_floor:
                    done += b["status"] == "checked_out"
                    nights += b["nights"] if b["status"] == "checked_out" else 0
                    own += b["is_member_booking"] and b["status"] != "cancelled"
                if t and t["status"] == "posted" and t["posting_date"] >= as_of_floor:
                    if t["posted_currency"] == "NOK":
                        revenue += t["posted_amount"]
                    elif t["posting_date"] >= date(2024, 1, 1):
                        revenue += round(t["posted_amount"] * D("0.1"), 2)
        out[h["id"]] = (done, nights, own, revenue)
    return out


def test_hotel_comparison(world):
    w = world
    args = (w["hotels"], w["chains"], w["bookings"], w["txs"], w["fx"], AS_OF)
    measures = ("bookings_completed_365d", "nights_365d", "member_bookings_365d", "revenue_365d_reporting")
    literal = {r["hotel_id"]: tuple(r[m] for m in measures)
               for r in reports.hotel_comparison(*args, literal_fanout=True).collect()}
    assert literal == hotels_by_hand(world, date(2023, 6, 16))
    plain = {r["hotel_id"]: tuple(r[m] for m in measures) for r in reports.hotel_comparison(*args).collect()}
    assert plain[10] == (0, 0, 1, D("110.70")) and plain[13] == (0, 0, 0, 0)
    assert plain[11] == (0, 0, 0, 0) and plain[12][2] == 1


def test_size_check_only_changes_the_strategy(world, monkeypatch):
    from stayledger.functions import sizing
    expected = sorted(map(str, reports.revenue_per_member(world["txs"], world["chains"], world["fx"]).collect()))
    monkeypatch.setattr(sizing, "MAX_ROWS", 0)
    rows = reports.revenue_per_member(world["txs"], world["chains"], world["fx"])
    assert sorted(map(str, rows.collect())) == expected


def test_fact_filters_and_columns_reach_the_scan(frames):
    plan = reports.direct_booking_share(frames.bookings, frames.chain_groups)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "o_orderkey" in line)
    assert "o_totalprice" not in scan and "IsNotNull(o_custkey)" in scan
