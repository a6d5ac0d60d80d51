"""Earning rules, bonus lookup, transaction derivation and reward eligibility."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from stayledger.functions.fx import RateBook
from stayledger.functions.scalars import day, hash_number, hash_share
from stayledger.functions.sizing import is_small, small
from stayledger.operators.rule_index import rule_by_index

#: Up to so many active rules a booking tries them one by one.
LIST_RULES = 64

# Bonus percent by tier and channel. Every other pair earns nothing.
BONUS_PERCENT = [
    ("bronze", "direct", "2.0"), ("silver", "direct", "5.0"), ("gold", "direct", "10.0"),
    ("platinum", "direct", "15.0"), ("black", "direct", "18.0"),
    ("bronze", "corporate", "3.0"), ("silver", "corporate", "3.6"), ("gold", "corporate", "4.5"),
    ("platinum", "corporate", "5.4"), ("black", "corporate", "6.0"),
]


def in_force(on_date: Column, valid_from: Column, valid_to: Column) -> Column:
    """Validity test with both ends included and an open end for NULL."""
    return (valid_from <= on_date) & (valid_to.isNull() | (on_date <= valid_to))


def valid_range_join(facts: DataFrame, config: DataFrame, keys: list[str], on_date: str,
                     how: str = "left") -> DataFrame:
    """Join facts to configuration rows that share ``keys`` and are valid on the fact's date."""
    terms = small(config).withColumnsRenamed({"valid_from": "_from", "valid_to": "_to"})
    for k in keys:
        terms = terms.withColumnRenamed(k, f"_{k}")
    match = in_force(facts[on_date], F.col("_from"), F.col("_to"))
    for k in keys:
        match = match & (facts[k] == F.col(f"_{k}"))
    return facts.join(terms, match, how).drop(*[f"_{k}" for k in keys], "_from", "_to")


# Fields a rule may pin down besides the hotel. Only the hotel and the segment make it more specific: hotel and segment,
# hotel, segment, default; then priority decides. Rate group and channel are conditions. Hotel rules and
# program-wide rules can be searched apart.
_FIELDS = {"market_segment_code": 1, "rate_group_code": 0, "channel": 0}


def _rule_entry() -> Column:
    """A rule as a struct that sorts best first: specificity, then priority, then the lowest id."""
    rank = sum((F.when(F.col(f).isNotNull(), F.lit(w)).otherwise(F.lit(0)) for f, w in _FIELDS.items()), F.lit(0))
    return F.struct((F.col("hotel_id").isNull()).alias("anywhere"), (-rank).alias("rank"), (-F.col("priority")).alias("turn"),
                    F.col("id"), *_FIELDS, "valid_from", "valid_to", "percent_of_payment",
                    F.map_entries("tier_multiplier_override").alias("overrides"))


def _first_match(rules: Column, on_date: Column) -> Column:
    def matches(rule: Column) -> Column:
        ok = in_force(on_date, rule["valid_from"], rule["valid_to"])
        for field in _FIELDS:
            ok = ok & (rule[field].isNull() | F.coalesce(rule[field] == F.col(field), F.lit(False)))
        return ok

    return F.get(F.filter(rules, matches), F.lit(0))


def _rule_by_lists(bookings: DataFrame, live: DataFrame, on_date: str) -> DataFrame:
    """Few rules: one sorted array per program and per hotel, the first match taken within the row."""
    def lists(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        return F.broadcast(rows.groupBy(*keys).agg(F.sort_array(F.collect_list(_rule_entry())).alias(name)))

    at_hotel = lists(live.where(F.col("hotel_id").isNotNull()), ["program_id", "hotel_id"], "_hotel_rules")
    anywhere = lists(live.where(F.col("hotel_id").isNull()), ["program_id"], "_program_rules")
    rows = bookings.join(at_hotel, ["program_id", "hotel_id"], "left").join(anywhere, "program_id", "left")
    on = F.col(on_date)
    return rows.withColumn("_rule", F.coalesce(_first_match(F.col("_hotel_rules"), on),
                                               _first_match(F.col("_program_rules"), on)))


def resolve_points_rule(bookings: DataFrame, rules: DataFrame, on_date: str = "arrival_date", indexed: bool | None = None) -> DataFrame:
    """Add the one earning rule that applies to each booking; NULLs where none does.

    A NULL field of a rule matches anything, a filled one must agree. The most specific
    rule wins (hotel and segment, hotel, segment, default), then the higher priority, then
    the lower id. ``bookings`` needs program_id, hotel_id, channel, market_segment_code,
    rate_group_code and ``on_date``. A handful of rules is sorted into arrays that a booking goes through; more are
    indexed, and a booking then looks up its combination of values (``rule_index``). ``indexed`` decides between the two by hand.
    """
    live = rules.where(F.col("is_active"))
    few = is_small(live) and is_small(live, LIST_RULES) if indexed is None else not indexed
    rows = _rule_by_lists(bookings, live, on_date) if few else rule_by_index(bookings, live, on_date)
    return rows.select(
        *bookings.columns, F.col("_rule.id").alias("rule_id"),
        F.col("_rule.percent_of_payment").alias("percent_of_payment"),
        F.map_from_entries("_rule.overrides").alias("tier_multiplier_override"))


def earnings(transactions: DataFrame, bookings: DataFrame, members: DataFrame, tiers: DataFrame,
             programs: DataFrame, rules: DataFrame, fx: RateBook, indexed: bool | None = None) -> DataFrame:
    """Member charges with the rule that applies, its multiplier, the payment in points currency and the points earned.

    ``floor(payment in points currency * percent / 100 * multiplier)``; the multiplier is
    the rule's value for the member's tier, else the tier's default, else one.
    ``bookings`` carries channel, market_segment_code and rate_group_code.
    """
    paid = transactions.where(F.col("member_id").isNotNull() & (F.col("status") == "posted")
                              & (F.col("transaction_type") == "charge")) \
        .withColumn("transaction_id", F.col("id")).drop("id", "hotel_id", "status", "transaction_type")
    stays = bookings.select(F.col("id").alias("booking_id"), "hotel_id", "arrival_date", "channel",
                            "market_segment_code", "rate_group_code")
    levels = tiers.select(F.col("id").alias("current_tier_id"), F.col("code").alias("tier_code"), "multiplier_default")
    terms = [c for c in ("points_expiry_months",) if c in programs.columns]
    people = members.select(F.col("id").alias("member_id"), "program_id", "current_tier_id") \
        .join(small(levels), "current_tier_id", "left") \
        .join(small(programs.select(F.col("id").alias("program_id"), "points_currency", *terms)), "program_id")
    rows = paid.join(stays, "booking_id").join(people, "member_id")
    ruled = fx.convert(resolve_points_rule(rows, rules, indexed=indexed), "posted_amount", "posted_currency", "points_currency",
                       "posting_date", "payment")
    override = F.try_element_at(F.col("tier_multiplier_override"), F.col("tier_code"))
    multiplier = F.coalesce(override, F.col("multiplier_default"), F.lit(1)).cast("decimal(8,4)")
    points = F.floor(F.col("payment").cast("decimal(16,2)") * F.col("percent_of_payment") * multiplier
                     / F.lit(100).cast("decimal(3,0)"))
    return ruled.withColumns({"applied_multiplier": multiplier, "points_earned": F.coalesce(points, F.lit(0)).cast("bigint")}) \
        .withColumnRenamed("percent_of_payment", "applied_percent")


def earn_points(transactions: DataFrame, bookings: DataFrame, members: DataFrame, tiers: DataFrame,
                programs: DataFrame, rules: DataFrame, fx: RateBook) -> DataFrame:
    """Points per member transaction by the rule engine; ``ledger.post_rule_earnings`` posts them."""
    return earnings(transactions, bookings, members, tiers, programs, rules, fx).select(
        "transaction_id", "booking_id", "member_id", "rule_id", "tier_code", "applied_percent", "applied_multiplier", "payment", "points_earned")


def bonus_table(spark) -> DataFrame:
    return spark.createDataFrame(BONUS_PERCENT, "tier_code string, channel string, pct string") \
        .withColumn("pct", F.col("pct").cast("decimal(5,2)"))


def bonus_from_lookup(bookings: DataFrame, members: DataFrame, tiers: DataFrame, lookup: DataFrame) -> DataFrame:
    """Add bonus percent, earned and released amounts to bookings by the (tier, channel) table.

    Guests without membership, OTA stays and unlisted pairs earn nothing; cancelled
    stays keep the percent but earn nothing; only completed stays release the bonus.
    """
    # Bookings without a member skip the join, so they do not meet on one NULL key.
    levels = members.select(F.col("id").alias("member_id"), "current_tier_id") \
        .join(small(tiers.select(F.col("id").alias("current_tier_id"), F.col("code").alias("tier_code"))),
              "current_tier_id").select("member_id", "tier_code")
    known = bookings.where(F.col("member_id").isNotNull()).join(levels, "member_id", "left") \
        .join(small(lookup), ["tier_code", "channel"], "left").drop("tier_code")
    guests = bookings.where(F.col("member_id").isNull()).withColumn("pct", F.lit(None).cast("decimal(5,2)"))
    rows = known.unionByName(guests)

    zero = F.lit(0).cast("decimal(14,2)")
    earns = F.col("member_id").isNotNull() & (F.col("channel") != "ota")
    pct = F.coalesce(F.col("pct"), F.lit(0).cast("decimal(5,2)"))
    bonus = F.round(F.coalesce(F.col("paid_amount"), zero) * pct / F.lit(100).cast("decimal(3,0)"), 2) \
        .cast("decimal(14,2)")
    return rows.select(
        *bookings.columns,
        F.when(earns, pct).otherwise(F.lit(0).cast("decimal(5,2)")).alias("bonus_percent_at_posting"),
        F.when(earns & (F.col("status") != "cancelled"), bonus).otherwise(zero).alias("bonus_earned_amount"),
        F.when(earns & (F.col("status") == "checked_out"), bonus).otherwise(zero).alias("bonus_released_amount"))


def build_transactions(bookings: DataFrame, members: DataFrame, tiers: DataFrame, lookup: DataFrame) -> DataFrame:
    """One posting per booking with a payment: a charge, or a refund of half for a cancellation."""
    due = bookings.where(F.col("status").isin("checked_out", "in_house", "cancelled", "no_show")
                         & (F.coalesce("paid_amount", "total_amount") > 0))
    cancelled = F.col("status") == "cancelled"
    refund = F.coalesce((-F.col("paid_amount") * F.lit("0.5").cast("decimal(2,1)")), F.lit(0))
    amount = F.when(cancelled, refund).otherwise(F.coalesce("paid_amount", "total_amount"))
    label = F.when(F.col("channel") == "ota", "OTA").when(F.col("channel") == "direct", "Direct") \
        .when(F.col("channel") == "corporate", "Corporate").otherwise("Other")
    return bonus_from_lookup(due, members, tiers, lookup).select(
        "chain_group_id", "hotel_id", F.col("id").alias("booking_id"), "member_id",
        F.concat(F.lit("4"), F.substring(F.md5(F.col("id").cast("string")), 1, 12)).alias("external_transaction_id"),
        F.when(cancelled, "refund").otherwise("charge").alias("transaction_type"),
        F.lit("posted").alias("status"),
        F.coalesce(F.col("check_out_at").cast("date"), F.col("cancelled_at").cast("date"), F.col("arrival_date"))
        .alias("posting_date"),
        F.col("arrival_date").alias("transaction_date"),
        F.round(amount, 2).cast("decimal(14,2)").alias("posted_amount"), F.col("currency").alias("posted_currency"),
        F.coalesce("paid_amount", F.lit(0)).cast("decimal(14,2)").alias("paid_amount"),
        "bonus_percent_at_posting", "bonus_earned_amount", "bonus_released_amount",
        F.lit(0).cast("decimal(14,2)").alias("giftcard_applied_amount"),
        (F.col("channel") == "ota").alias("is_ota"), label.alias("segment_label"))


def split_transaction_lines(transactions: DataFrame, bookings: DataFrame, member_share: float = 0.30,
                            guest_share: float = 0.15) -> DataFrame:
    """A room line of 92 % for every posting and an extras line of 8 % for some completed stays.

    The room line does not depend on the extras line, so the lines of a posting add up to
    its amount only where both exist. Stays with extras are chosen by a hash of the posting.
    Both lines come from one pass over the joined rows.
    """
    stays = bookings.select(F.col("id").alias("booking_id"), F.col("nights"), F.col("status").alias("_stay"))
    rows = transactions.join(stays, "booking_id")
    key = F.col("id")
    sampled = F.when(F.col("member_id").isNotNull(), hash_share(key, member_share, "extras")) \
        .otherwise(hash_share(key, guest_share, "extras"))
    kind = F.element_at(F.array(*map(F.lit, ("Food", "Beverage", "Spa"))),
                        (hash_number(key, "kind") % 3 + 1).cast("int"))
    amount = F.col("posted_amount")

    def part(share: str) -> Column:
        return F.round(amount * F.lit(share).cast("decimal(3,2)"), 2).cast("decimal(14,2)")

    per_night = F.round(amount / F.nullif(F.col("nights"), F.lit(0)).cast("decimal(10,0)"), 2)
    room = F.struct(F.lit("Accommodation").alias("product_type"),
                    F.greatest("nights", F.lit(1)).cast("decimal(14,4)").alias("quantity"),
                    F.coalesce(per_night, amount).cast("decimal(14,4)").alias("unit_amount"),
                    part("0.92").alias("amount"), F.lit("1.0").cast("decimal(8,4)").alias("bonus_factor"))
    extras = F.struct(kind.alias("product_type"), F.lit(1).cast("decimal(14,4)").alias("quantity"),
                      part("0.08").cast("decimal(14,4)").alias("unit_amount"), part("0.08").alias("amount"),
                      F.lit("0.5").cast("decimal(8,4)").alias("bonus_factor"))
    has_extras = (F.col("_stay") == "checked_out") & sampled
    lines = F.when(has_extras, F.array(room, extras)).otherwise(F.array(room))
    return rows.select(F.col("id").alias("transaction_id"), F.col("posted_currency").alias("currency"),
                       F.inline(lines))


def wildcard_hotel_rules(rules: DataFrame) -> DataFrame:
    """Active hotel rules open to every channel: they outrank the rule that excludes OTA stays."""
    return rules.where(F.col("is_active") & F.col("hotel_id").isNotNull() & F.col("channel").isNull()
                       & (F.col("percent_of_payment") > 0))


def eligible_rewards(members: DataFrame, rewards: DataFrame, tiers: DataFrame, balances: DataFrame, as_of: date,
                     hotel_id=None) -> DataFrame:
    """The rewards each member can redeem now.

    Active, valid on ``as_of``, in stock, affordable, and open to the member's tier.
    Rewards tied to a hotel are offered only when that ``hotel_id`` is asked for.
    """
    order = tiers.select(F.col("id").alias("_tier"), "sort_order")
    on = day(as_of)
    scope = F.col("hotel_id").isNull() if hotel_id is None else \
        F.col("hotel_id").isNull() | (F.col("hotel_id") == F.lit(hotel_id))
    offers = rewards.where(
        F.col("is_active") & scope
        & (F.col("inventory_remaining").isNull() | (F.col("inventory_remaining") > 0))
        & (F.col("valid_from").isNull() | (F.col("valid_from") <= on))
        & (F.col("valid_to").isNull() | (F.col("valid_to") >= on))) \
        .join(order.withColumnRenamed("sort_order", "min_order"), F.col("min_tier_id") == F.col("_tier"), "left") \
        .select("program_id", F.col("id").alias("reward_id"), F.col("code").alias("reward_code"), "cost_points",
                "min_tier_id", "min_order")
    offers = small(offers)
    people = members.select(F.col("id").alias("member_id"), "program_id", "current_tier_id") \
        .join(small(order), F.col("current_tier_id") == F.col("_tier"), "left") \
        .select("member_id", "program_id", "sort_order") \
        .join(balances.select("member_id", "balance_posted"), "member_id")
    fits = (F.col("cost_points") <= F.col("balance_posted")) \
        & (F.col("min_tier_id").isNull() | (F.col("sort_order") >= F.col("min_order")))
    # A member who cannot afford the cheapest offer has no match, whatever the catalogue size.
    matched = people.where(F.col("balance_posted") > 0).join(offers, "program_id").where(fits)
    return matched.select("member_id", "program_id", "reward_id", "reward_code", "cost_points",
                          (F.col("balance_posted") - F.col("cost_points")).alias("balance_after"))
