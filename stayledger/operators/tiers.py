"""Tier qualification, progress, history and flags."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from stayledger.functions.fx import RateBook
from stayledger.functions.scalars import at_midnight, day, later
from stayledger.functions.sizing import small
from stayledger.operators.rules import in_force


_MEMBER = ["member_id", "program_id", "current_tier_id"]


def qualifying_metrics(thresholds: DataFrame, ledger: DataFrame, bookings: DataFrame, transactions: DataFrame,
                       chains: DataFrame, fx: RateBook, as_of: date) -> DataFrame:
    """Points, nights and revenue per member over every rolling window the thresholds use.

    Points are posted earn credits, nights are those of completed stays by arrival date,
    revenue is posted charges and adjustments in the reporting currency. One row per
    member with a column such as ``points_12`` per metric and number of months; the few
    distinct pairs of the configuration are read first, so that one aggregation does.
    """
    points = ledger.where((F.col("status") == "posted") & (F.col("type") == "earn_release")).select(
        "member_id", F.lit("points").alias("metric"), F.col("points_delta").cast("decimal(24,2)").alias("value"),
        F.col("occurred_at").cast("date").alias("on_date"))
    nights = bookings.where(F.col("member_id").isNotNull() & (F.col("status") == "checked_out")).select(
        "member_id", F.lit("nights").alias("metric"), F.col("nights").cast("decimal(24,2)").alias("value"),
        F.col("arrival_date").alias("on_date"))
    spend = transactions.where(F.col("member_id").isNotNull() & (F.col("status") == "posted")
                               & F.col("transaction_type").isin("charge", "adjustment")) \
        .join(small(chains.select(F.col("id").alias("chain_group_id"), "reporting_currency")), "chain_group_id")
    revenue = fx.convert(spend, "posted_amount", "posted_currency", "reporting_currency", "posting_date", "value") \
        .select("member_id", F.lit("revenue").alias("metric"), F.col("value").cast("decimal(24,2)"),
                F.col("posting_date").alias("on_date"))
    facts = points.unionByName(nights).unionByName(revenue)
    pairs = thresholds.select("metric", F.col("qualifying_period_months").alias("months")).distinct() \
        .orderBy("metric", "months").collect()
    longest = max((p["months"] for p in pairs), default=0)

    def total(metric: str, months: int) -> Column:
        counted = (F.col("metric") == metric) & (F.col("on_date") > F.add_months(day(as_of), -months))
        return F.coalesce(F.sum(F.when(counted, F.col("value"))), F.lit(0)).alias(f"{metric}_{months}")

    recent = (F.col("on_date") > F.add_months(day(as_of), -longest)) & (F.col("on_date") <= day(as_of))
    sums = [total(p["metric"], p["months"]) for p in pairs] or [F.lit(0).alias("points_0")]
    return facts.where(recent).groupBy("member_id").agg(*sums)


def _tier_tests(members: DataFrame, tiers: DataFrame, thresholds: DataFrame, metrics: DataFrame,
                as_of: date) -> DataFrame:
    """Every member against every threshold of the member's program that is valid on ``as_of``.

    Members of a program without thresholds keep one row with an empty tier. The rows stay
    partitioned by member, so what follows groups them without another shuffle.
    """
    rules = thresholds.where(in_force(day(as_of), F.col("valid_from"), F.col("valid_to"))) \
        .select("tier_id", F.concat_ws("_", "metric", "qualifying_period_months").alias("_key"), "min_value")
    levels = small(tiers.select("program_id", F.col("id").alias("tier_id"), "sort_order").join(rules, "tier_id"))
    people = members.select(F.col("id").alias("member_id"), "program_id", "current_tier_id") \
        .join(metrics, "member_id", "left")
    sums = [c for c in metrics.columns if c != "member_id"]
    reached = F.coalesce(*[F.when(F.col("_key") == c, F.col(c)) for c in sums], F.lit(0).cast("decimal(34,2)"))
    return people.join(levels, "program_id", "left").withColumn("reached", reached).drop(*sums, "_key")


def qualify_tiers(members: DataFrame, tiers: DataFrame, thresholds: DataFrame, metrics: DataFrame, as_of: date,
                  combine: str = "any") -> DataFrame:
    """The highest tier each member qualifies for, with the change against the current one.

    ``combine`` says whether one threshold of a tier is enough ("any") or all must hold
    ("all"). Members who reach no threshold fall to the program's initial tier.
    """
    holds = F.col("reached") >= F.col("min_value")
    passed = (F.bool_or if combine == "any" else F.bool_and)(holds)
    best = F.max(F.when(F.col("passed"), F.struct("sort_order", "tier_id"))).alias("best")
    rated = _tier_tests(members, tiers, thresholds, metrics, as_of) \
        .groupBy(*_MEMBER, "tier_id", "sort_order").agg(passed.alias("passed")).groupBy(*_MEMBER).agg(best)
    levels = small(tiers.select("program_id", F.col("id").alias("_id"), "sort_order", "is_default_initial"))
    initial = levels.where("is_default_initial").select(
        "program_id", F.col("_id").alias("initial_id"), F.col("sort_order").alias("initial_order"))
    current = levels.select(F.col("_id").alias("current_tier_id"), F.col("sort_order").alias("current_order"))
    rows = rated.join(initial, "program_id", "left").join(current, "current_tier_id", "left")
    order = F.coalesce(F.col("best.sort_order"), F.col("initial_order"))
    change = F.when(F.col("current_order").isNull() & order.isNotNull(), "initial") \
        .when(order > F.col("current_order"), "promote").when(order < F.col("current_order"), "demote") \
        .otherwise("keep")
    return rows.select("member_id", "program_id", "current_tier_id",
                       F.coalesce(F.col("best.tier_id"), F.col("initial_id")).alias("qualified_tier_id"),
                       order.alias("qualified_sort_order"), change.alias("change"))


def tier_progress_pct(members: DataFrame, tiers: DataFrame, thresholds: DataFrame, metrics: DataFrame, as_of: date,
                      combine: str = "any") -> DataFrame:
    """How far each member is towards the next tier of the program, in percent of its threshold.

    With several thresholds the furthest one counts ("any") or the least ("all"). NULL
    where there is no next tier or it has no thresholds. Members without a tier stand
    before the first one.
    """
    order = small(tiers.select(F.col("id").alias("current_tier_id"), F.col("sort_order").alias("_current")))
    steps = small(tiers.groupBy("program_id").agg(F.collect_set("sort_order").alias("_steps")))
    tests = _tier_tests(members, tiers, thresholds, metrics, as_of).join(order, "current_tier_id", "left").join(steps, "program_id", "left")
    # Orders are unique in a program but may have gaps.
    higher = F.array_min(F.filter("_steps", lambda s: s > F.coalesce(F.col("_current"), F.lit(0))))
    is_next = (F.col("sort_order") == higher) & (F.col("min_value") > 0)
    ratio = F.round(F.col("reached") * F.lit(100).cast("decimal(3,0)") / F.col("min_value"), 2).cast("decimal(24,2)")
    return tests.groupBy(*_MEMBER).agg(
        (F.max if combine == "any" else F.min)(F.when(is_next, ratio)).alias("tier_progress_pct"),
        F.max(F.when(is_next, F.col("tier_id"))).alias("next_tier_id")).drop("program_id")


def tier_history(members: DataFrame, tiers: DataFrame, promoted: Column | None = None,
                 days_to_promotion: int = 60) -> DataFrame:
    """Initial and promotion rows per member with a tier.

    The initial row already names the current tier; a promotion row from the tier one
    step below follows for the members chosen by ``promoted`` (default: everyone above
    the first step). Both rows come from one pass over the members.
    """
    below = F.lag("id").over(Window.partitionBy("program_id").orderBy("sort_order"))
    levels = small(tiers.select(F.col("id").alias("current_tier_id"), below.alias("prev_tier_id")))
    chosen = F.lit(True) if promoted is None else promoted
    rows = members.where(F.col("current_tier_id").isNotNull()) \
        .withColumn("_chosen", chosen).join(levels, "current_tier_id", "left")
    joined_at = F.col("joined_at").cast("timestamp_ntz")
    first = F.struct(F.lit(None).cast(dict(tiers.dtypes)["id"]).alias("from_tier_id"),
                     F.lit("initial_assignment").alias("change_reason"), joined_at.alias("effective_at"))
    rise = F.struct(F.col("prev_tier_id").alias("from_tier_id"), F.lit("qualified_by_points").alias("change_reason"),
                    later(joined_at, days=days_to_promotion).alias("effective_at"))
    steps = F.when(F.col("_chosen") & F.col("prev_tier_id").isNotNull(), F.array(first, rise)).otherwise(F.array(first))
    return rows.select(F.col("id").alias("member_id"), F.col("current_tier_id").alias("to_tier_id"), F.inline(steps)) \
        .select("member_id", "from_tier_id", "to_tier_id", "change_reason", "effective_at")


def flag_attributes(members: DataFrame, tiers: DataFrame, as_of: date, min_order: int = 4) -> DataFrame:
    """VIP and high-value attributes for members on the upper tiers."""
    upper = small(tiers.where(F.col("sort_order") >= min_order).select(F.col("id").alias("current_tier_id")))
    flags = F.array(F.struct(F.lit("vip").alias("attr_key"), F.lit("true").alias("attr_value")),
                    F.struct(F.lit("high_value_flag").alias("attr_key"), F.lit('"watchlist"').alias("attr_value")))
    return members.join(upper, "current_tier_id", "left_semi") \
        .select(F.col("id").alias("member_id"), F.inline(flags)) \
        .select("*", F.lit("segment_evaluation").alias("source"), at_midnight(day(as_of)).alias("set_at"))
