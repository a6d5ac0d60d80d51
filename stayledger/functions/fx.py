"""As-of currency conversion as an equi-join on (from, to, day).

A rate holds from its date until the next rate of the same pair. The rate table is
spread over calendar days once, so each fact row finds its rate with one hash
probe instead of a scan over the history of the pair. The spread table has at most
pairs x days rows; that bound is computed from the rates themselves and decides
between a broadcast and a plain join. The plain join shuffles on pair and day, so
one popular pair still spreads over all its days.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from stayledger.functions.scalars import col

RATE = "decimal(23,15)"
BROADCAST_ROWS = 500_000


def rate_spans(rates: DataFrame) -> DataFrame:
    """Rates in both directions with the day they stop applying.

    A pair without a direct rate on or before a day falls back to the inverse of
    the opposite pair; once a direct rate exists it wins, even over a newer inverse.
    """
    known = rates.where(F.col("from_ccy") != F.col("to_ccy"))
    direct = known.select("from_ccy", "to_ccy", "rate_date",
                          F.col("rate").cast(RATE).alias("rate"), F.lit(True).alias("is_direct"))
    inverse = known.select(F.col("to_ccy").alias("from_ccy"), F.col("from_ccy").alias("to_ccy"), "rate_date",
                           (F.lit(1).cast("decimal(1,0)") / F.col("rate").cast("decimal(14,6)")).cast(RATE)
                           .alias("rate"), F.lit(False).alias("is_direct"))
    pair = Window.partitionBy("from_ccy", "to_ccy")
    both = direct.unionByName(inverse).withColumn(
        "direct_since", F.min(F.when(F.col("is_direct"), F.col("rate_date"))).over(pair))
    usable = both.where(F.col("is_direct") | F.col("direct_since").isNull()
                        | (F.col("rate_date") < F.col("direct_since")))
    return usable.withColumn("next_date", F.lead("rate_date").over(pair.orderBy("rate_date"))) \
        .select("from_ccy", "to_ccy", "rate_date", "next_date", "rate")


@dataclass
class RateBook:
    """Currency rates ready for conversion; build it once and share it between reports."""

    daily: DataFrame
    last_day: date | None
    row_bound: int
    broadcast_rows: int = BROADCAST_ROWS

    @classmethod
    def of(cls, rates: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> "RateBook":
        """Reads one summary row of ``rates``: the day range and the number of pairs.

        The pairs seen are bounded by the square of the number of currencies.
        """
        known = rates.where(F.col("from_ccy") != F.col("to_ccy"))
        seen = known.agg(F.min("rate_date").alias("lo"), F.max("rate_date").alias("hi"),
                         F.size(F.collect_set(F.concat("from_ccy", "to_ccy"))).alias("pairs")).first()
        last_day = seen["hi"]
        bound = 0 if last_day is None else 2 * seen["pairs"] * ((last_day - seen["lo"]).days + 1)
        until = F.coalesce(F.date_sub("next_date", 1), F.lit(last_day).cast("date"))
        daily = rate_spans(rates).select(
            F.col("from_ccy").alias("_from"), F.col("to_ccy").alias("_to"),
            F.explode(F.sequence("rate_date", until)).alias("_day"), F.col("rate").alias("_rate"))
        return cls(daily, last_day, bound, broadcast_rows)

    def persisted(self) -> "RateBook":
        """Keep the spread table in memory for several reports; a lost part is formed again."""
        return replace(self, daily=self.daily.persist())

    def convert(self, df: DataFrame, amount: Column | str, from_ccy: Column | str, to_ccy: Column | str,
                on_date: Column | str, out: str) -> DataFrame:
        """Add ``out``: ``amount`` in ``to_ccy``, rounded to two decimals per row.

        The amount comes back unrounded when both currencies agree, and NULL when
        an argument is missing or neither direction has a rate by that day.
        """
        src, dst, value = col(from_ccy), col(to_ccy), col(amount)
        probe = F.least(col(on_date).cast("date"), F.lit(self.last_day).cast("date")) \
            if self.last_day else F.lit(None).cast("date")
        # least() skips NULLs, and a missing date must not find a rate.
        probe = F.when(col(on_date).isNotNull(), probe)
        keyed = df.select("*", src.alias("_src"), dst.alias("_dst"), probe.alias("_on"))
        daily = F.broadcast(self.daily) if self.row_bound <= self.broadcast_rows else self.daily
        joined = keyed.join(daily, (F.col("_src") == F.col("_from")) & (F.col("_dst") == F.col("_to"))
                            & (F.col("_on") == F.col("_day")), "left")
        converted = F.when(F.col("_src") == F.col("_dst"), value) \
            .when(F.col("_src").isNotNull() & F.col("_dst").isNotNull(), F.round(value * F.col("_rate"), 2))
        return joined.withColumn(out, converted) \
            .drop("_src", "_dst", "_on", "_from", "_to", "_day", "_rate")
