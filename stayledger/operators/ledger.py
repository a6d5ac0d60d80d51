"""The signed points ledger: balances, postings, expiry and reconciliation."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from stayledger.functions.scalars import at_midnight, later, moment, whole
from stayledger.functions.sizing import small
from stayledger.schemas import columns_of
from stayledger.sources.tables import materialize

#: Rows of a member that one task sweeps in ``points_consumption``.
STRETCH_ROWS = 20_000

LEDGER_COLUMNS = [
    "chain_group_id", "program_id", "member_id", "type", "status", "points_delta",
    "source_transaction_id", "source_booking_id", "rule_id", "reward_redemption_id",
    "applied_percent", "applied_multiplier", "applied_tier_id",
    "occurred_at", "effective_at", "expires_at", "reason", "metadata",
]


def balance_by_member(ledger: DataFrame, as_of: date | datetime) -> DataFrame:
    """Balances of the members that have ledger rows, one shuffle of partial sums.

    ``expiring_30d`` has no lower bound: credits already past their expiry count too.
    """
    posted = F.col("status") == "posted"
    soon = F.col("expires_at") <= later(moment(as_of), days=30)

    def total(rows: Column) -> Column:
        return F.coalesce(F.sum(F.when(rows, F.col("points_delta"))), F.lit(0)).cast("bigint")

    return ledger.groupBy("member_id").agg(
        total(posted).alias("balance_posted"),
        total(F.col("status") == "pending").alias("balance_pending"),
        total(posted & soon).alias("expiring_30d"),
        F.max("occurred_at").alias("last_activity_at"))


def points_balances(members: DataFrame, ledger: DataFrame, as_of: date | datetime) -> DataFrame:
    """One row per member; zero balances and no activity for members without ledger rows."""
    held = balance_by_member(ledger, as_of)
    people = members.select(F.col("id").alias("member_id"), "chain_group_id", "program_id")
    zero = {c: 0 for c in ("balance_posted", "balance_pending", "expiring_30d")}
    return people.join(held, "member_id", "left").fillna(zero)


def _padded(df: DataFrame) -> DataFrame:
    """The ledger's columns, those without a value as typed NULLs, so that all writers fill one table."""
    types = {"metadata": "string"} | {c.name: c.type for c in columns_of("point_transactions", dict(df.dtypes)["member_id"])}
    missing = [F.lit(None).cast(types[c]).alias(c) for c in LEDGER_COLUMNS if c not in df.columns]
    return df.select("*", *missing).select(*[F.col(c).cast(types[c]).alias(c) for c in LEDGER_COLUMNS])


def _member_side(members: DataFrame, tiers: DataFrame) -> DataFrame:
    multipliers = small(tiers.select(F.col("id").alias("current_tier_id"), "multiplier_default"))
    return members.select(F.col("id").alias("member_id"), "program_id", "current_tier_id") \
        .join(multipliers, "current_tier_id", "left") \
        .select("member_id", "program_id", F.col("current_tier_id").alias("applied_tier_id"),
                F.coalesce("multiplier_default", F.lit(1).cast("decimal(5,2)")).alias("applied_multiplier"))


def _earning(transactions: DataFrame, members: DataFrame, tiers: DataFrame) -> DataFrame:
    midnight = at_midnight("posting_date")
    joined = transactions.join(_member_side(members, tiers), "member_id")
    return joined.select(
        "chain_group_id", "program_id", "member_id", whole(F.col("bonus_earned_amount")).alias("points_delta"),
        F.col("id").alias("source_transaction_id"), F.col("booking_id").alias("source_booking_id"),
        F.col("bonus_percent_at_posting").alias("applied_percent"), "applied_multiplier", "applied_tier_id",
        later(midnight, hours=23).alias("occurred_at"),
        later(midnight, hours=23).alias("effective_at"),
        midnight.alias("_posted"), "external_transaction_id")


def post_earnings(transactions: DataFrame, members: DataFrame, programs: DataFrame, tiers: DataFrame,
                  bookings: DataFrame | None = None) -> DataFrame:
    """One posted credit per posted charge that earned a bonus.

    In-house stays earn a posted credit here and a pending one in ``post_pending``;
    pass ``bookings`` to leave them out of the posted credits.
    """
    earned = transactions.where((F.col("bonus_earned_amount") > 0) & (F.col("status") == "posted")
                                & (F.col("transaction_type") == "charge"))
    if bookings is not None:
        staying = bookings.where(F.col("status") == "in_house").select(F.col("id").alias("booking_id"))
        earned = earned.join(staying, "booking_id", "left_anti")
    months = small(programs.select(F.col("id").alias("program_id"), "points_expiry_months"))
    rows = _earning(earned, members, tiers).join(months, "program_id")
    expiry = F.col("_posted") + F.make_ym_interval(F.lit(0), F.col("points_expiry_months"))
    return _padded(rows.select(
        "*", F.lit("earn_release").alias("type"), F.lit("posted").alias("status"),
        expiry.alias("expires_at"), F.lit("Bonus earned on transaction").alias("reason"),
        F.to_json(F.struct(F.lit("earning").alias("source"),
                           F.col("external_transaction_id").alias("transaction_external_id"))).alias("metadata")))


def post_rule_earnings(earned: DataFrame) -> DataFrame:
    """A posted credit for every charge that earned points by a rule, with the rule that gave them.

    ``earned`` comes from ``rules.earnings``. A credit lapses after the months of its program.
    """
    midnight = at_midnight("posting_date")
    expiry = midnight + F.make_ym_interval(F.lit(0), F.col("points_expiry_months"))
    rows = earned.where(F.col("points_earned") > 0).select(
        "chain_group_id", "program_id", "member_id", F.col("points_earned").alias("points_delta"),
        F.col("transaction_id").alias("source_transaction_id"), F.col("booking_id").alias("source_booking_id"), "rule_id",
        "applied_percent", "applied_multiplier", F.col("current_tier_id").alias("applied_tier_id"),
        later(midnight, hours=23).alias("occurred_at"), later(midnight, hours=23).alias("effective_at"), expiry.alias("expires_at"),
        F.to_json(F.struct(F.lit("rule").alias("source"), "payment", F.col("points_currency").alias("currency"))).alias("metadata"))
    return _padded(rows.select("*", F.lit("earn_release").alias("type"), F.lit("posted").alias("status"),
                               F.lit("Points earned by rule").alias("reason")))


def earning_trace(ledger: DataFrame, transactions: DataFrame, bookings: DataFrame, rules: DataFrame) -> DataFrame:
    """The way of each credit that a rule gave: booking, charge, rule, ledger row.

    ``in_force`` says whether the rule was valid on the day of arrival, ``recomputed`` gives the points that the posted payment,
    percent and multiplier make; it differs from ``points`` where a ledger row was changed by hand.
    """
    credits = ledger.where((F.col("type") == "earn_release") & F.col("rule_id").isNotNull()) \
        .select("member_id", F.col("source_transaction_id").alias("transaction_id"), F.col("source_booking_id").alias("booking_id"), "rule_id",
                "applied_percent", "applied_multiplier", F.col("points_delta").alias("points"),
                F.get_json_object("metadata", "$.payment").cast("decimal(16,2)").alias("payment"))
    charges = transactions.select(F.col("id").alias("transaction_id"), "posted_amount", "posted_currency")
    stays = bookings.select(F.col("id").alias("booking_id"), "hotel_id", F.col("channel").alias("booking_channel"), "arrival_date")
    terms = rules.select(F.col("id").alias("rule_id"), F.col("percent_of_payment").alias("rule_percent"), "priority", "valid_from", "valid_to")
    rows = credits.join(charges, "transaction_id", "left").join(stays, "booking_id", "left").join(small(terms), "rule_id", "left")
    in_force = (F.col("arrival_date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("arrival_date") <= F.col("valid_to")))
    recomputed = F.floor(F.col("payment") * F.col("applied_percent") * F.col("applied_multiplier") / F.lit(100).cast("decimal(3,0)"))
    return rows.withColumns({"in_force": in_force, "recomputed": recomputed.cast("bigint")}).drop("valid_from", "valid_to")


def post_pending(transactions: DataFrame, bookings: DataFrame, members: DataFrame, tiers: DataFrame) -> DataFrame:
    """A pending credit for every bonus of a stay that is still in house."""
    staying = bookings.where(F.col("status") == "in_house").select(F.col("id").alias("booking_id"))
    earned = transactions.where(F.col("bonus_earned_amount") > 0).join(staying, "booking_id", "left_semi")
    return _padded(_earning(earned, members, tiers).select(
        "*", F.lit("earn_pending").alias("type"), F.lit("pending").alias("status"),
        F.lit("Bonus pending while the booking is active").alias("reason"),
        F.to_json(F.struct(F.lit("pending").alias("source"))).alias("metadata")))


def post_redemptions(redemptions: DataFrame, members: DataFrame, rewards: DataFrame) -> DataFrame:
    """A posted debit per redemption, linked to it by id."""
    people = members.select(F.col("id").alias("member_id"), "program_id",
                            F.col("current_tier_id").alias("applied_tier_id"))
    offers = small(rewards.select(F.col("id").alias("reward_id"), F.col("name").alias("reward_name"),
                                  F.col("code").alias("reward_code")))
    rows = redemptions.join(offers, "reward_id").join(people, "member_id")
    return _padded(rows.select(
        "chain_group_id", "program_id", "member_id", "applied_tier_id",
        F.lit("redeem").alias("type"), F.lit("posted").alias("status"),
        (-F.col("points_spent")).cast("bigint").alias("points_delta"),
        F.col("id").alias("reward_redemption_id"),
        F.col("redemption_date").alias("occurred_at"), F.col("redemption_date").alias("effective_at"),
        F.concat(F.lit("Reward redemption: "), F.col("reward_name")).alias("reason"),
        F.to_json(F.struct("reward_code")).alias("metadata")))


def expire_points(ledger: DataFrame, as_of: date | datetime) -> DataFrame:
    """Expiry debits for posted credits that lapsed by ``as_of`` and were not spent before.

    Credits are spent in the order they expire, which is the order they were granted
    because a program has one expiry period. Per member let E be the credits lapsed so
    far and R the points spent so far: the points gone from the head of the queue are
    ``R + max(0, E - R seen so far)``, so each lapse expires exactly the growth of that
    running maximum, and neither loops nor per-member state are needed.

    The running values are formed in two levels, within a member and day and then over
    the days of a member, so a member holding a large part of the ledger still spreads
    over all its days. Earlier ``expire`` rows are not counted as spending; the result is
    the full set of expiries, to be appended with ``insert_ignore`` on ``credit_id``.
    """
    now = moment(as_of)
    posted = ledger.where((F.col("status") == "posted") & (F.col("type") != "expire") & (F.col("points_delta") != 0))
    is_credit = F.col("points_delta") > 0
    at = F.when(is_credit, F.col("expires_at")).otherwise(F.col("occurred_at"))
    moves = posted.select(
        "id", "member_id", "chain_group_id", "program_id", at.alias("at"),
        F.when(is_credit, 0).otherwise(1).alias("kind"), F.col("points_delta").cast("bigint").alias("net"),
    ).where(F.col("at") <= now).withColumn("day", F.col("at").cast("date"))

    queue = ["member_id", "program_id", "chain_group_id"]
    in_day = Window.partitionBy(*queue, "day").orderBy("at", "kind", "id")
    so_far = in_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stepped = moves.withColumn("net_in_day", F.sum("net").over(so_far)) \
        .withColumn("peak_in_day", F.max("net_in_day").over(so_far)) \
        .withColumn("peak_before", F.lag("peak_in_day").over(in_day)) \
        .withColumn("is_last", F.lead("net").over(in_day).isNull())

    # The last row of a day holds the day's totals; both uses of the rows share one shuffle.
    before = Window.partitionBy(*queue).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    opening = stepped.where("is_last").select(*queue, "day", "net_in_day", "peak_in_day") \
        .withColumn("open_net", F.coalesce(F.sum("net_in_day").over(before), F.lit(0))) \
        .withColumn("peak", F.col("open_net") + F.col("peak_in_day")) \
        .withColumn("open_peak", F.greatest(F.lit(0), F.max("peak").over(before))) \
        .select(*queue, "day", "open_net", "open_peak")
    lapses = stepped.where(F.col("kind") == 0)
    full = lapses.join(opening, [*queue, "day"])
    reached = F.greatest(F.col("open_peak"), F.col("open_net") + F.col("peak_before"))
    lost = F.col("open_net") + F.col("net_in_day") - reached
    return full.withColumn("lost", lost).where(F.col("lost") > 0).select(
        "chain_group_id", "program_id", "member_id", F.col("id").alias("credit_id"),
        F.lit("expire").alias("type"), F.lit("posted").alias("status"),
        (-F.col("lost")).cast("bigint").alias("points_delta"), F.col("at").alias("occurred_at"))


def points_consumption(ledger: DataFrame, as_of: date | datetime) -> DataFrame:
    """Which credit each point spent or lapsed came from: credit_id, debit_id, kind, points.

    Credits stand in the order in which they lapse (those that never do come last), debits (redemptions, and the expiries
    of ``expire_points``) in the order of time. Both are laid end to end along one line of points, and what a credit and a debit
    have in common there is what the one gave to the other. ``kind`` is redeem, expire, or open for points of a credit
    that are left; points spent beyond all credits have no credit. ``debit_id`` is the redemption's id or, for an
    expiry, the id of the credit that lapsed.

    The places on the line are running sums in two levels, day and member. The line of a member is then cut into stretches
    that hold about ``STRETCH_ROWS`` rows each, and every stretch is swept alone, so a member with a large part of
    the ledger spreads over many tasks.
    """
    now = moment(as_of)
    posted = ledger.where((F.col("status") == "posted") & (F.col("type") != "expire") & (F.col("points_delta") != 0))
    owner = ["member_id", "program_id", "chain_group_id"]
    # Credits that never lapse follow all others, in the order in which they were given.
    never = F.make_ym_interval(F.lit(6000), F.lit(0))
    credits = posted.where((F.col("points_delta") > 0) & (F.col("occurred_at") <= now)) \
        .select(*owner, F.col("id").alias("item"), F.coalesce("expires_at", F.col("occurred_at") + never).alias("at"), F.lit("credit").alias("side"), F.lit(0).alias("turn"), F.col("points_delta").cast("bigint").alias("points"))
    spent = posted.where((F.col("points_delta") < 0) & (F.col("occurred_at") <= now)) \
        .select(*owner, F.col("id").alias("item"), F.col("occurred_at").alias("at"), F.lit("redeem").alias("side"), F.lit(1).alias("turn"),
                (-F.col("points_delta")).cast("bigint").alias("points"))
    lapsed = expire_points(ledger, as_of) \
        .select(*owner, F.col("credit_id").alias("item"), F.col("occurred_at").alias("at"), F.lit("expire").alias("side"), F.lit(0).alias("turn"),
                (-F.col("points_delta")).alias("points"))
    rows = credits.unionByName(spent).unionByName(lapsed).withColumn("line", F.when(F.col("side") == "credit", "credit").otherwise("debit"))
    placed = materialize(_end_to_end(rows, [*owner, "line"], ["at", "turn", "item"]), "point-line")

    # Stretches of equal length per member, as many as its rows ask for; a row that crosses borders is cut at them.
    extent = placed.groupBy(*owner).agg(F.max("stop").alias("_end"), F.count("*").alias("_n"))
    length = F.greatest(F.lit(1), F.ceil(F.col("_end") / F.ceil(F.col("_n") / F.lit(STRETCH_ROWS)))).cast("bigint")
    cut = placed.join(extent.select(*owner, length.alias("_length")), owner)
    first, last = F.expr("start div _length"), F.expr("(stop - 1) div _length")
    pieces = cut.withColumn("stretch", F.explode(F.sequence(first, last))).select(
        *owner, "stretch", "line", "side", "item", F.greatest("start", F.col("stretch") * F.col("_length")).alias("start"),
        F.least("stop", (F.col("stretch") + 1) * F.col("_length")).alias("stop"))
    # Both lines are without gaps from 0 on, so within a stretch a row holds until the next one of its line starts.
    ends = pieces.groupBy(*owner, "stretch", "line").agg(F.max("stop").alias("start")) \
        .select(*owner, "stretch", "line", F.lit(None).cast("string").alias("side"), F.lit(None).cast(dict(ledger.dtypes)["id"]).alias("item"), "start")
    marks = pieces.drop("stop").unionByName(ends)
    sweep = Window.partitionBy(*owner, "stretch").orderBy("start", F.col("item").isNotNull())
    so_far = sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def current(line: str) -> Column:
        return F.last(F.when(F.col("line") == line, F.struct("side", "item")), ignorenulls=True).over(so_far)

    swept = marks.withColumns({"credit": current("credit"), "debit": current("debit"), "points": F.lead("start").over(sweep) - F.col("start")})
    kind = F.coalesce("debit.side", F.lit("open"))
    return swept.where((F.col("points") > 0) & (F.col("credit.item").isNotNull() | F.col("debit.item").isNotNull())) \
        .groupBy(*owner, F.col("credit.item").alias("credit_id"), F.col("debit.item").alias("debit_id"), kind.alias("kind")) \
        .agg(F.sum("points").cast("bigint").alias("points"))


def _end_to_end(rows: DataFrame, line: list[str], order: list[str]) -> DataFrame:
    """``rows`` with the place [start, stop) that ``points`` takes on its line, in two levels: within a day, and over the days."""
    dated = rows.withColumn("_day", F.col(order[0]).cast("date"))
    in_day = Window.partitionBy(*line, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*line).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = dated.groupBy(*line, "_day").agg(F.sum("points").alias("_total")) \
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    placed = dated.withColumn("_in_day", F.sum("points").over(in_day)).join(days, [*line, "_day"])
    stop = (F.col("_before") + F.col("_in_day")).cast("bigint")
    return placed.select(*rows.columns, (stop - F.col("points")).alias("start"), stop.alias("stop"))


def reconcile_bonus(ledger: DataFrame, transactions: DataFrame) -> DataFrame:
    """Transactions whose posted credits differ from the bonus stored on them."""
    credits = ledger.where((F.col("type") == "earn_release") & (F.col("status") == "posted")
                           & F.col("source_transaction_id").isNotNull()) \
        .groupBy(F.col("source_transaction_id").alias("transaction_id")) \
        .agg(F.sum("points_delta").cast("bigint").alias("ledger_points"))
    expected = F.coalesce(whole(F.col("bonus_earned_amount")), F.lit(0))
    rows = transactions.select(F.col("id").alias("transaction_id"), expected.alias("expected_points")) \
        .join(credits, "transaction_id", "left").fillna(0, ["ledger_points"])
    return rows.withColumn("difference", F.col("ledger_points") - F.col("expected_points")) \
        .where(F.col("difference") != 0)
