"""Stored ledger, one update per row, any key for numbering, check-in and check-out, gaps between tiers."""

import pytest
from pyspark.sql import functions as F

from stayledger.operators import engage, ledger, pms
from stayledger.schemas import schema_of
from stayledger.sources import tables


def test_ledger_is_one_table(spark, frames, tmp_path):
    f = frames
    parts = [ledger.post_earnings(f.transactions, f.members, f.loyalty_programs, f.tiers),
             ledger.post_pending(f.transactions, f.bookings, f.members, f.tiers),
             ledger.post_redemptions(f.point_redemptions, f.members, f.rewards)]
    path = str(tmp_path / "ledger")
    for p in parts:
        assert "void" not in dict(p.dtypes).values()
        tables.append(p, path)
    assert all(p.dtypes == parts[0].dtypes for p in parts)
    model = {x.name: x for x in schema_of("point_transactions", "bigint")}
    back = tables.read_table(spark, path, spark.createDataFrame([], parts[0].schema).schema)
    assert all(x.dataType == model[x.name].dataType for x in back.schema if x.name in model)
    want = sorted(tuple(r) for p in parts for r in p.groupBy("type").agg(F.count("*"), F.sum("points_delta"), F.count("reward_redemption_id")).collect())
    got = sorted(tuple(r) for r in back.groupBy("type").agg(F.count("*"), F.sum("points_delta"), F.count("reward_redemption_id")).collect())
    assert got == want and sum(r[3] for r in got) > 0


def test_update_changes_each_row_once(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    source = spark.createDataFrame([(1, "y"), (1, "x"), (3, "z")], "id int, v string")
    assert sorted(tuple(r) for r in tables.update_from(target, source, ["id"], ["v"]).collect()) == [(1, "x"), (2, "b")]


@pytest.mark.parametrize("pieces", [None, 3])
def test_numbering_by_text(spark, pieces):
    rows = spark.range(100).select(F.md5(F.col("id").cast("string")).alias("k"))
    got = [(r.k, r.position) for r in tables.numbered(rows, "k", pieces=pieces).collect()]
    assert sorted(got) == [(k, i) for i, k in enumerate(sorted(k for k, _ in got), 1)]


def test_check_in_and_check_out(frames):
    history = pms.status_history_from_bookings(frames.bookings)
    stays = {r.id: r for r in frames.bookings.select("id", "status", "check_in_at", "check_out_at").collect()}
    out = {r.booking_id: r.due_at for r in engage.status_candidates(history, "checked_out").collect()}
    assert out == {i: r.check_out_at for i, r in stays.items() if r.status == "checked_out" and r.check_out_at}
    into = {r.booking_id: r.due_at for r in engage.status_candidates(history, "in_house").collect()}
    assert into == {i: r.check_in_at for i, r in stays.items() if r.status in ("checked_out", "in_house") and r.check_in_at}
