"""Named queries that hold spoiled frames against all rules of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stayledger.operators import quality
from stayledger.plans.registry import query
from stayledger.session import fresh_path

_PARENTS = ("hotels", "members", "chain_groups", "loyalty_programs", "bookings")


def _spoiled(df: DataFrame, changes: dict[str, str]) -> DataFrame:
    """``df`` with some columns replaced by SQL expressions over the old values."""
    return df.select(*[F.expr(changes[c]).cast(kind).alias(c) if c in changes else F.col(c) for c, kind in df.dtypes])


def _frames(f, table: str, rows: DataFrame) -> dict[str, DataFrame]:
    return {t: f.frame(t) for t in _PARENTS} | {table: rows}


def _sql(table: str, counted: list[tuple[str, str]], unchecked: list[str]) -> str:
    rows = [f"SELECT '{rule}' AS rule, CAST(({count}) AS BIGINT) AS n" for rule, count in counted]
    missing = [f"SELECT '{table}', 'not checked: {rule}', NULL" for rule in unchecked]
    return f"SELECT '{table}' AS table_name, rule, n AS offending_rows FROM (" + "\n  UNION ALL ".join(rows) + ") WHERE n > 0\nUNION ALL " + "\nUNION ALL ".join(missing)


@query("check_model_bookings", _sql("bookings", [
    ("not null: hotel_id", "SELECT count(*) FROM {bookings} WHERE id % 41 = 0"),
    ("check: departure_date >= arrival_date", "SELECT count(*) FROM {bookings} WHERE id % 13 = 0"),
    ("check: num_rooms > 0", "SELECT count(*) FROM {bookings} WHERE id % 67 = 6"),
    ("values: status", "SELECT count(*) FROM {bookings} WHERE id % 29 = 0"),
    ("unique: pms_code, pms_reservation_no", """SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM {bookings}
      GROUP BY pms_code, id - CASE WHEN id % 16 = 5 THEN 1 ELSE 0 END) WHERE c > 1"""),
    ("reference: member_id", "SELECT count(member_id) FROM {bookings} WHERE id % 37 = 0")],
    ["reference: pms_code", "reference: currency"]))
def check_model_bookings(f):
    rows = _spoiled(f.bookings, {
        "hotel_id": "CASE WHEN id % 41 <> 0 THEN hotel_id END", "departure_date": "CASE WHEN id % 13 = 0 THEN arrival_date - 1 ELSE departure_date END",
        "num_rooms": "CASE WHEN id % 67 = 6 THEN 0 ELSE num_rooms END", "status": "CASE WHEN id % 29 = 0 THEN 'lost' ELSE status END",
        "pms_reservation_no": "CAST(1000000 + id - CASE WHEN id % 16 = 5 THEN 1 ELSE 0 END AS STRING)",
        "member_id": "CASE WHEN id % 37 = 0 THEN -1 - member_id ELSE member_id END"})
    return quality.check_model("bookings", _frames(f, "bookings", rows))


@query("check_model_transactions", _sql("transactions", [
    ("not null: posted_amount", "SELECT count(*) FROM {transactions} WHERE id % 19 = 1"),
    ("values: transaction_type", "SELECT count(*) FROM {transactions} WHERE id % 23 = 2"),
    ("unique: chain_group_id, external_transaction_id", """SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM {transactions}
      WHERE id % 47 = 4 GROUP BY chain_group_id) WHERE c > 1"""),
    ("reference: booking_id", "SELECT count(*) FROM {transactions} WHERE id % 31 = 3")],
    ["not null: bonus_released_amount", "reference: posted_currency", "reference: original_currency"]))
def check_model_transactions(f):
    """Counted while the rows are written."""
    rows = _spoiled(f.transactions, {
        "posted_amount": "CASE WHEN id % 19 <> 1 THEN posted_amount END", "transaction_type": "CASE WHEN id % 23 = 2 THEN 'gift' ELSE transaction_type END",
        "external_transaction_id": "CASE WHEN id % 47 = 4 THEN 'twice' ELSE external_transaction_id END",
        "booking_id": "CASE WHEN id % 31 = 3 THEN -1 - booking_id ELSE booking_id END"})
    return quality.write_checked("transactions", _frames(f, "transactions", rows), fresh_path(f.spark, "checked"), "posting_date")


@query("check_model_point_transactions", _sql("point_transactions", [
    ("not null: status", "SELECT count(*) FROM {event_ledger} WHERE id % 19 = 0"),
    ("values: type", "SELECT count(*) FROM {event_ledger} WHERE id % 17 = 0"),
    ("unique: id", "SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM {event_ledger} GROUP BY id - CASE WHEN id % 53 = 1 THEN 1 ELSE 0 END) WHERE c > 1"),
    ("reference: member_id", "SELECT count(*) FROM {event_ledger} WHERE id % 59 = 0")],
    [f"reference: {c}" for c in ("source_transaction_id", "source_booking_id", "rule_id", "reward_redemption_id", "applied_tier_id")]))
def check_model_point_transactions(f):
    rows = _spoiled(f.event_ledger, {
        "id": "id - CASE WHEN id % 53 = 1 THEN 1 ELSE 0 END", "type": "CASE WHEN id % 17 = 0 THEN 'gift' ELSE type END",
        "status": "CASE WHEN id % 19 <> 0 THEN status END", "member_id": "CASE WHEN id % 59 = 0 THEN -1 - member_id ELSE member_id END"})
    return quality.check_model("point_transactions", _frames(f, "point_transactions", rows))
