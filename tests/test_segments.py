"""Stored segments, audiences, flows, anniversaries and the model checks that are taken while writing."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stayledger.operators import engage, quality, segments

DAY = date(2024, 6, 1)
PEOPLE = "member_id long, chain_group_id long, status string, visits int"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, 1, "active", 5), (2, 1, "active", 0), (3, 1, "left", 9), (4, 2, "active", 7), (5, 2, None, None)], PEOPLE)


def stored(spark, *rows):
    return spark.createDataFrame([(i, c, f"s{i}", d, True) for i, c, d in rows], "id long, chain_group_id long, code string, definition string, is_active boolean")


OFTEN = '{"type":"member.visits","op":">","value":4}'


@pytest.mark.parametrize("portion", [200, 1])
def test_segments_hold_members_of_their_chain(spark, people, monkeypatch, portion):
    monkeypatch.setattr(segments, "PORTION", portion)
    table = stored(spark, (1, 1, OFTEN), (2, 2, OFTEN), (3, 1, '{"type":"all"}'), (4, 2, '{"type":"member.status","value":"left"}'), (5, 9, '{"type":"all"}'))
    found = segments.segment_members(people, table, DAY)
    assert sorted((r.segment_id, r.member_id) for r in found.collect()) == [(1, 1), (1, 3), (2, 4), (3, 1), (3, 2), (3, 3)]
    sizes = {r.id: r.estimated_size for r in segments.segment_sizes(table, found, DAY).collect()}
    assert sizes == {1: 2, 2: 1, 3: 3, 4: 0, 5: 0}
    assert segments.segment_members(people, table.where("false"), DAY).count() == 0


def test_many_segments_in_one_scan(spark, people):
    table = stored(spark, *[(i, 1 + i % 2, f'{{"type":"member.visits","op":">","value":{i % 10}}}') for i in range(150)])
    found = segments.segment_members(people, table, DAY)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1
    visits = {1: (1, 5), 2: (1, 0), 3: (1, 9), 4: (2, 7)}
    want = sorted((i, m) for i in range(150) for m, (c, n) in visits.items() if c == 1 + i % 2 and n > i % 10)
    assert sorted((r.segment_id, r.member_id) for r in found.collect()) == want


def test_a_bad_definition_is_named(spark, people):
    with pytest.raises(ValueError, match="segment 7"):
        segments.segment_members(people, stored(spark, (7, 1, '{"type":"member.visits","op":"~","value":1}')), DAY)


def test_audiences(spark, people):
    membership = segments.segment_members(people, stored(spark, (1, 1, OFTEN)), DAY)
    campaigns = spark.createDataFrame([(10, 1, 1), (11, 2, None), (12, 1, 99)], "id long, chain_group_id long, segment_id long")
    found = segments.campaign_audience(campaigns, membership, people.withColumnRenamed("member_id", "id"))
    assert sorted(tuple(r) for r in found.collect()) == [(10, 1), (10, 3), (11, 4), (11, 5)]


def test_flows_read_their_settings(spark, people):
    bookings = spark.createDataFrame([(1, 1, "ota", datetime(2024, 5, 31, 23, 50), date(2024, 6, 3), "upcoming"),
                                      (2, 4, "ota", datetime(2024, 5, 31, 23, 50), date(2024, 6, 3), "upcoming")],
                                     "id long, member_id long, channel string, booked_at timestamp_ntz, arrival_date date, status string")
    members = people.withColumnRenamed("member_id", "id")
    schema = "id long, chain_group_id long, trigger_type string, status string, trigger_config string, segment_id long"
    flows = spark.createDataFrame([(1, 1, "ota_booking_received", "active", '{"delay_minutes":5}', None), (2, 2, "ota_booking_received", "active", '{"delay_minutes":15}', None),
                                   (3, 1, "ota_booking_received", "active", '{"delay_minutes":5,"send_at_local":"09:00"}', 1),
                                   (4, 1, "ota_booking_received", "paused", None, None)], schema)
    membership = segments.segment_members(people, stored(spark, (1, 1, '{"type":"member.visits","op":"<","value":1}')), DAY)
    found = segments.flow_candidates(flows, {"members": members, "bookings": bookings}, membership, DAY)
    # The flow of chain 2 waits until after midnight, and member 1 is not in the segment of flow 3.
    assert [tuple(r) for r in found.collect()] == [(1, 1, 1, datetime(2024, 5, 31, 23, 55))]
    assert segments.flow_candidates(flows.where("false"), {"members": members, "bookings": bookings}, membership, DAY).count() == 0


def test_anniversary_of_29_february(spark):
    members = spark.createDataFrame([(1, "active", datetime(2020, 2, 29)), (2, "active", datetime(2021, 2, 28))], "id long, status string, joined_at timestamp_ntz")

    def who(day):
        return sorted(r.member_id for r in engage.anniversary_candidates(members, day).collect())

    assert who(date(2023, 2, 28)) == [1, 2] and who(date(2024, 2, 28)) == [2] and who(date(2024, 2, 29)) == [1]


def test_checked_while_written(spark, frames, tmp_path):
    """A second load is counted by itself, but its keys are checked against the first."""
    path, every = str(tmp_path / "tx"), {t: frames.frame(t) for t in ("members", "hotels", "chain_groups", "bookings")}
    rows = frames.transactions
    first = {r.rule: r.offending_rows for r in quality.write_checked("transactions", every | {"transactions": rows}, path, "posting_date").collect()}
    assert set(first.values()) == {None}
    again = rows.limit(5).withColumn("posted_amount", F.lit(None).cast("decimal(14,2)"))
    second = {r.rule: r.offending_rows for r in quality.write_checked("transactions", every | {"transactions": again}, path, "posting_date").collect()}
    assert second["not null: posted_amount"] == 5 and second["unique: id"] == 10
    assert spark.read.parquet(path).count() == rows.count() + 5
