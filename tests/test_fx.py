from datetime import date
from decimal import Decimal as D

import pytest

from stayledger.functions.fx import RateBook

RATES = [
    ("SEK", "NOK", date(2020, 1, 1), D("1.040000")), ("SEK", "NOK", date(2020, 3, 1), D("1.100000")),
    # Opposite direction: older than the direct rate of EUR to DKK, and newer than it.
    ("DKK", "EUR", date(2020, 1, 1), D("0.134000")), ("DKK", "EUR", date(2020, 6, 1), D("0.200000")),
    ("EUR", "DKK", date(2020, 5, 1), D("7.460000")),
    ("ISK", "NOK", date(2020, 2, 1), D("0.079000")),
]
CASES = [
    # amount, from, to, day, expected
    (D("10.00"), "NOK", "NOK", None, D("10.00")),                       # same currency needs no date
    (D("10.00"), "NOK", "SEK", None, None),                             # otherwise it does
    (None, "NOK", "NOK", date(2020, 1, 1), None), (D("1.00"), None, "NOK", date(2020, 1, 1), None),
    (D("1.00"), "NOK", None, date(2020, 1, 1), None),
    (D("100.00"), "SEK", "NOK", date(2019, 12, 31), None),              # before the first rate
    (D("100.00"), "SEK", "NOK", date(2020, 1, 1), D("104.00")), (D("100.00"), "SEK", "NOK", date(2020, 2, 29), D("104.00")),
    (D("100.00"), "SEK", "NOK", date(2020, 3, 1), D("110.00")), (D("100.00"), "SEK", "NOK", date(2035, 1, 1), D("110.00")),
    (D("100.00"), "EUR", "DKK", date(2020, 4, 30), D("746.27")),        # inverse until a direct rate exists
    (D("100.00"), "EUR", "DKK", date(2020, 5, 1), D("746.00")), (D("100.00"), "EUR", "DKK", date(2020, 7, 1), D("746.00")),
    (D("100.00"), "NOK", "ISK", date(2020, 2, 1), D("1265.82")),        # inverse only
    (D("100.00"), "ISK", "DKK", date(2020, 7, 1), None),                # no third currency in between
    (D("-0.25"), "SEK", "NOK", date(2020, 3, 1), D("-0.28")),           # half away from zero: -0.275
]


@pytest.fixture(scope="module")
def rates(spark):
    return spark.createDataFrame(RATES, "from_ccy string, to_ccy string, rate_date date, rate decimal(14,6)")


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_conversion(spark, rates, limit):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)],
                                 "i int, amount decimal(14,2), src string, dst string, day date, want decimal(24,2)")
    book = RateBook.of(rates, broadcast_rows=limit)
    got = book.convert(rows, "amount", "src", "dst", "day", "got")
    assert got.columns == [*rows.columns, "got"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (limit > 0)
    for r in got.orderBy("i").collect():
        assert r["got"] == r["want"], r


def test_no_rates_at_all(spark, rates):
    book = RateBook.of(rates.limit(0))
    rows = spark.createDataFrame([(D("1.00"), "A", "A"), (D("1.00"), "A", "B")], "a decimal(14,2), f string, t string")
    from pyspark.sql import functions as F
    got = book.convert(rows.withColumn("d", F.lit(date(2020, 1, 1))), "a", "f", "t", "d", "x").orderBy("t").collect()
    assert [r["x"] for r in got] == [D("1.00"), None]


def test_row_bound_holds(rates):
    book = RateBook.of(rates)
    assert book.daily.count() <= book.row_bound
    assert book.daily.count() == book.daily.select("_from", "_to", "_day").distinct().count()
