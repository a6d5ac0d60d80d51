import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stayledger.operators import ledger

LEDGER = """id int, member_id int, chain_group_id int, program_id int, type string, status string, points_delta bigint,
    occurred_at timestamp_ntz, expires_at timestamp_ntz"""


def rows_to_ledger(spark, rows):
    return spark.createDataFrame([(i, m, 1, 1, t, s, p, o, e) for i, (m, t, s, p, o, e) in enumerate(rows)], LEDGER)


def test_balances(spark):
    now = datetime(2024, 5, 1)
    rows = [
        (1, "earn_release", "posted", 100, now, now - timedelta(days=400)),       # already lapsed: still counted
        (1, "earn_release", "posted", 30, now, now + timedelta(days=30)),         # exactly thirty days ahead
        (1, "earn_release", "posted", 7, now, now + timedelta(days=30, seconds=1)),
        (1, "redeem", "posted", -20, now, None), (1, "earn_pending", "pending", 5, now, now),
        (2, "reverse", "reversed", -9, now + timedelta(days=1), None),            # activity of any status
    ]
    members = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1)], "id int, chain_group_id int, program_id int")
    got = {r["member_id"]: r for r in ledger.points_balances(members, rows_to_ledger(spark, rows), now).collect()}
    assert (got[1]["balance_posted"], got[1]["balance_pending"], got[1]["expiring_30d"]) == (117, 5, 130)
    assert (got[2]["balance_posted"], got[2]["last_activity_at"]) == (0, now + timedelta(days=1))
    assert (got[3]["balance_posted"], got[3]["expiring_30d"], got[3]["last_activity_at"]) == (0, 0, None)


def expire_by_hand(rows, as_of):
    """A queue per member: spending takes from the credit that expires first, an overdraft waits for the next credit."""
    events = []
    for i, (m, t, s, p, o, e) in enumerate(rows):
        if s != "posted" or t == "expire" or p == 0:
            continue
        at = e if p > 0 else o
        if at is not None and at <= as_of:
            events.append((at, 0 if p > 0 else 1, i, m, p))
    gone, lapsed, out = {}, {}, {}
    for at, kind, i, m, p in sorted(events):
        if kind == 1:
            gone[m] = gone.get(m, 0) - p
        else:
            lapsed[m] = lapsed.get(m, 0) + p
            lost = lapsed[m] - gone.get(m, 0)
            if lost > 0:
                out[i] = -lost
                gone[m] = lapsed[m]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_expiry_against_a_queue(spark, seed):
    rnd = random.Random(seed)
    start, rows = datetime(2024, 1, 1), []
    for _ in range(400):
        member = rnd.choice([1, 1, 1, 2, 3])
        at = start + timedelta(hours=rnd.randrange(24 * 40))
        if rnd.random() < 0.5:
            rows.append((member, "earn_release", "posted", rnd.randrange(1, 50), at, at + timedelta(days=8)))
        else:
            kind = rnd.choice(["redeem", "manual_adjustment", "expire"])
            rows.append((member, kind, rnd.choice(["posted", "posted", "reversed"]), -rnd.randrange(1, 50), at, None))
    as_of = start + timedelta(days=30)
    got = {r["credit_id"]: r["points_delta"] for r in ledger.expire_points(rows_to_ledger(spark, rows), as_of).collect()}
    assert got == expire_by_hand(rows, as_of)
    assert got


def test_spending_protects_points_and_later_spending_does_not(spark):
    d = datetime(2024, 1, 1)
    rows = [
        (1, "earn_release", "posted", 100, d, d + timedelta(days=10)),
        (1, "redeem", "posted", -40, d + timedelta(days=5), None),                # spent in time
        (1, "redeem", "posted", -60, d + timedelta(days=11), None),               # too late
        (2, "manual_adjustment", "posted", 50, d, None),                          # never lapses
    ]
    got = ledger.expire_points(rows_to_ledger(spark, rows), date(2024, 2, 1)).collect()
    assert [(r["credit_id"], r["points_delta"], r["occurred_at"]) for r in got] == [(0, -60, d + timedelta(days=10))]


def test_repeated_expiry_adds_nothing(spark):
    from stayledger.sources.tables import insert_ignore
    d = datetime(2024, 1, 1)
    book = rows_to_ledger(spark, [(1, "earn_release", "posted", 100, d, d + timedelta(days=1))])
    first = ledger.expire_points(book, date(2024, 2, 1))
    posted = first.select(F.lit(99).alias("id"), "member_id", "chain_group_id", "program_id", "type", "status",
                          "points_delta", "occurred_at", F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    again = ledger.expire_points(book.unionByName(posted), date(2024, 3, 1))
    assert insert_ignore(again, first, ["credit_id"], ["occurred_at"]).count() == 0


def test_program_without_expiry(frames):
    rows = ledger.post_earnings(frames.transactions, frames.members, frames.loyalty_programs, frames.tiers)
    assert rows.columns == ledger.LEDGER_COLUMNS
    assert rows.where("program_id = 104 AND expires_at IS NOT NULL").count() == 0
    assert rows.where("program_id = 100 AND expires_at IS NULL").count() == 0
