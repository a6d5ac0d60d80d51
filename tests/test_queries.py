"""Every named query against its SQL, on the smallest data set."""

import compare
import pytest

from stayledger.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(small_folder):
    return compare.connect(small_folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(name, spark, duck, small_folder):
    found = QUERIES[name](spark, small_folder)
    assert compare.differences(found, duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["build_transactions", "earn_points", "qualify_tiers", "tier_history", "eligible_rewards", "audience_sample",
                                  "sync_errors", "segment_from_channel", "campaign_performance", "member_360"])
def test_matches_sql_without_broadcasts(name, spark, duck, small_folder, monkeypatch):
    """Configuration beyond the size limit takes the plain joins; the rows stay the same."""
    from stayledger.functions import sizing
    monkeypatch.setattr(sizing, "MAX_ROWS", 0)
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for s in settings:
        spark.conf.set(s, "-1")
    try:
        assert compare.differences(QUERIES[name](spark, small_folder), duck, ORACLES[name]) is None
    finally:
        for s in settings:
            spark.conf.unset(s)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as contract
    rows = contract.entry(spark)
    assert rows.columns[:3] == ["chain_group_id", "chain_name", "month"]
    assert rows.limit(1).count() == 1


def test_invariants(frames):
    from pyspark.sql import functions as F

    from stayledger.operators import ledger, reports
    from stayledger.plans.binding import EVENT_START
    n = frames.members.count()
    spread = reports.tier_distribution(frames.members, frames.chain_groups, frames.tiers)
    assert spread.agg(F.sum("member_count")).first()[0] == n
    growth = reports.member_growth(frames.members, frames.chain_groups)
    assert growth.groupBy("chain_group_id").agg(F.max("cumulative_members").alias("m")).agg(F.sum("m")).first()[0] == n
    balance = ledger.points_balances(frames.members, frames.event_ledger, EVENT_START)
    total = frames.event_ledger.where("status = 'posted'").agg(F.sum("points_delta")).first()[0]
    assert balance.agg(F.sum("balance_posted")).first()[0] == total
    assert balance.count() == n
