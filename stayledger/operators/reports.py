"""Reporting operators: one function per report, each a DataFrame to DataFrame step.

Facts are reduced to their grouping key before they meet a dimension or another fact,
so what is shuffled are partial aggregates. ``as_of`` replaces the clock everywhere.
A member's postings are taken to belong to the member's own chain, as tenancy demands;
``quality.check_same_tenant`` reports rows that break this.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from stayledger.functions.fx import RateBook
from stayledger.functions.scalars import day, month_of, months_before, percent
from stayledger.functions.sizing import small
from stayledger.operators.ledger import balance_by_member

AsOf = date | datetime


def _chains(chains: DataFrame, *extra: str) -> DataFrame:
    return chains.select(F.col("id").alias("chain_group_id"), F.col("name").alias("chain_name"), *extra)


def _reporting(chains: DataFrame) -> DataFrame:
    """Chains with their reporting currency, checked to be small enough to meet the facts."""
    return small(_chains(chains, "reporting_currency"))


def _in_reporting_currency(transactions: DataFrame, reporting: DataFrame, fx: RateBook) -> DataFrame:
    with_ccy = transactions.join(reporting, "chain_group_id")
    return fx.convert(with_ccy, "posted_amount", "posted_currency", "reporting_currency", "posting_date", "reporting")


def _year_before(as_of: AsOf) -> Column:
    return F.date_sub(day(as_of), 365)


def _count(rows: Column) -> Column:
    return F.count_if(rows)


def member_360(members: DataFrame, chains: DataFrame, tiers: DataFrame, ledger: DataFrame, bookings: DataFrame,
               transactions: DataFrame, fx: RateBook, as_of: AsOf) -> DataFrame:
    """One row per member with tier, balance, stays, revenue and the churn flag.

    A member without any past booking counts as churned even with recent points
    activity; cancelled and no-show stays count as past bookings here.
    """
    points = balance_by_member(ledger, as_of).select(
        "member_id", F.col("balance_posted").alias("points_balance"), F.col("balance_pending").alias("points_pending"),
        F.col("expiring_30d").alias("points_expiring_30d"), F.col("last_activity_at").alias("points_last_activity_at"))

    status, arrival = F.col("status"), F.col("arrival_date")
    stays = bookings.where(F.col("member_id").isNotNull()).groupBy("member_id").agg(
        F.count("*").alias("bookings_total"),
        _count(status == "checked_out").alias("bookings_completed"),
        _count(status == "cancelled").alias("bookings_cancelled"),
        _count(status.isin("upcoming", "in_house")).alias("bookings_upcoming"),
        F.min("arrival_date").alias("first_booking_at"),
        F.max(F.when(status.isin("checked_out", "in_house", "cancelled", "no_show"), arrival)).alias("last_booking_at"),
        F.min(F.when((status == "upcoming") & (arrival >= day(as_of)), arrival)).alias("next_booking_at"),
        F.coalesce(F.sum(F.when(status == "checked_out", F.col("nights"))), F.lit(0)).alias("nights_total"))

    spend = transactions.where(F.col("member_id").isNotNull() & (status == "posted")
                               & F.col("transaction_type").isin("charge", "adjustment"))
    reporting = _reporting(chains)
    revenue = _in_reporting_currency(spend, reporting, fx).groupBy("member_id") \
        .agg(F.sum("reporting").alias("revenue_lifetime_reporting"))

    levels = tiers.select(F.col("id").alias("current_tier_id"), F.col("code").alias("tier_code"),
                          F.col("name").alias("tier_name"), F.col("sort_order").alias("tier_sort_order"))
    people = members.select(
        F.col("id").alias("member_id"), "chain_group_id", "program_id", "member_number", "full_name", "email",
        "phone_e164", "country_code", "status", "gender", "birth_date", "joined_at", "recruitment_source",
        "recruited_via_ota", "current_tier_id")
    wide = people.join(points, "member_id", "left").join(stays, "member_id", "left") \
        .join(revenue, "member_id", "left") \
        .join(reporting, "chain_group_id", "left") \
        .join(small(levels), "current_tier_id", "left")

    cutoff = months_before(as_of, 12)
    quiet = F.col("points_last_activity_at").isNull() | (F.col("points_last_activity_at") < cutoff)
    churned = F.col("last_booking_at").isNull() | ((F.col("last_booking_at") < cutoff) & quiet)
    zero = ["points_balance", "points_pending", "points_expiring_30d", "bookings_total", "bookings_completed",
            "bookings_cancelled", "bookings_upcoming", "nights_total", "revenue_lifetime_reporting"]
    return wide.fillna(0, zero).select(
        "member_id", "chain_group_id", "chain_name", "program_id", "member_number", "full_name", "email",
        "phone_e164", "country_code", "status", "gender", "birth_date", "joined_at", "recruitment_source",
        "recruited_via_ota", "current_tier_id", "tier_code", "tier_name", "tier_sort_order",
        "points_balance", "points_pending", "points_expiring_30d", "points_last_activity_at",
        "bookings_total", "bookings_completed", "bookings_cancelled", "bookings_upcoming",
        "first_booking_at", "last_booking_at", "next_booking_at", "nights_total",
        "revenue_lifetime_reporting", "reporting_currency", churned.alias("is_churned"))


def tier_distribution(members: DataFrame, chains: DataFrame, tiers: DataFrame) -> DataFrame:
    """Members per chain and tier; members without a tier form their own group."""
    counted = members.groupBy("chain_group_id", "current_tier_id").agg(
        F.count("*").alias("n"), _count(F.col("status") == "active").alias("n_active"))
    levels = tiers.select(F.col("id").alias("tier_id"), F.col("code").alias("tier_code"),
                          F.col("name").alias("tier_name"), "sort_order")
    named = counted.join(_chains(chains), "chain_group_id") \
        .join(levels, F.col("current_tier_id") == F.col("tier_id"), "left")
    keys = ["chain_group_id", "chain_name", "tier_id", "tier_code", "tier_name", "sort_order"]
    grouped = named.groupBy(*keys).agg(F.sum("n").alias("member_count"), F.sum("n_active").alias("active_member_count"))
    active_in_chain = F.sum("active_member_count").over(Window.partitionBy("chain_group_id"))
    return grouped.withColumn("active_pct", percent(F.col("active_member_count"), active_in_chain))


def direct_booking_share(bookings: DataFrame, chains: DataFrame) -> DataFrame:
    """Bookings that were not cancelled per chain and arrival month, by channel."""
    channel = F.col("channel")
    counted = bookings.where(F.col("status") != "cancelled") \
        .groupBy("chain_group_id", month_of("arrival_date").alias("month")).agg(
            _count(channel == "direct").alias("direct_count"),
            _count(channel == "ota").alias("ota_count"),
            _count(channel == "corporate").alias("corporate_count"),
            F.count("*").alias("total_bookings"))
    return counted.join(_chains(chains), "chain_group_id").select(
        "chain_group_id", "chain_name", "month", "direct_count", "ota_count", "corporate_count", "total_bookings",
        percent(F.col("direct_count"), F.col("total_bookings")).alias("direct_share_pct"),
        percent(F.col("ota_count"), F.col("total_bookings")).alias("ota_share_pct"))


def revenue_per_member(transactions: DataFrame, chains: DataFrame, fx: RateBook) -> DataFrame:
    """Posted revenue per chain and month, and per member who posted in that month.

    Rows without a member add to the revenue but not to the divisor.
    ``fx_missing`` counts the rows left out because no rate was known.
    """
    posted = _in_reporting_currency(transactions.where(F.col("status") == "posted"), _reporting(chains), fx)
    grouped = posted.groupBy("chain_group_id", "chain_name", month_of("posting_date").alias("month"),
                             "reporting_currency").agg(
        F.sum("reporting").alias("revenue_total_reporting"),
        F.count_distinct("member_id").alias("active_member_count"),
        _count(F.col("reporting").isNull() & F.col("posted_amount").isNotNull()).alias("fx_missing"))
    per_member = F.col("revenue_total_reporting") / F.nullif(F.col("active_member_count").cast("decimal(19,0)"),
                                                             F.lit(0).cast("decimal(19,0)"))
    return grouped.withColumn("revenue_per_active_member", F.round(per_member, 2))


def member_growth(members: DataFrame, chains: DataFrame) -> DataFrame:
    """New members per chain and month with the running total; empty months are absent."""
    monthly = members.groupBy("chain_group_id", month_of("joined_at").alias("month")) \
        .agg(F.count("*").alias("new_members")).join(_chains(chains), "chain_group_id")
    running = Window.partitionBy("chain_group_id").orderBy("month")
    return monthly.select("chain_group_id", "chain_name", "month", "new_members",
                          F.sum("new_members").over(running).alias("cumulative_members"))


def churn(members: DataFrame, chains: DataFrame, ledger: DataFrame, bookings: DataFrame, as_of: AsOf) -> DataFrame:
    """Members per chain without a stay and without points activity for twelve months."""
    cutoff = months_before(as_of, 12)
    last_stay = bookings.where(F.col("member_id").isNotNull() & F.col("status").isin("checked_out", "in_house")) \
        .groupBy("member_id").agg(F.max("arrival_date").alias("last_booking_at"))
    last_points = ledger.groupBy("member_id").agg(F.max("occurred_at").alias("last_activity_at"))
    people = members.select(F.col("id").alias("member_id"), "chain_group_id") \
        .join(last_stay, "member_id", "left").join(last_points, "member_id", "left")
    gone = (F.col("last_booking_at").isNull() | (F.col("last_booking_at") < cutoff)) \
        & (F.col("last_activity_at").isNull() | (F.col("last_activity_at") < cutoff))
    counted = people.groupBy("chain_group_id").agg(
        F.count("*").alias("members_total"), _count(gone).alias("members_churned"))
    return counted.join(_chains(chains), "chain_group_id").select(
        "chain_group_id", "chain_name", "members_total", "members_churned",
        percent(F.col("members_churned"), F.col("members_total")).alias("churn_pct"))


def clv(members: DataFrame, chains: DataFrame, transactions: DataFrame, redemptions: DataFrame,
        bookings: DataFrame, fx: RateBook) -> DataFrame:
    """Lifetime value per member: posted charges minus redeemed points at one unit each."""
    charges = transactions.where(F.col("member_id").isNotNull() & (F.col("status") == "posted")
                                 & (F.col("transaction_type") == "charge"))
    reporting = _reporting(chains)
    gross = _in_reporting_currency(charges, reporting, fx).groupBy("member_id").agg(F.sum("reporting").alias("gross_revenue"))
    spent = redemptions.where(F.col("status") == "fulfilled").groupBy("member_id") \
        .agg(F.sum("points_spent").cast("bigint").alias("redemption_value"))
    completed = F.col("status") == "checked_out"
    stays = bookings.where(F.col("member_id").isNotNull()).groupBy("member_id").agg(
        _count(completed).alias("bookings_completed"),
        F.sum(F.when(completed, F.col("nights"))).alias("nights_total"),
        F.min("arrival_date").alias("first_booking_at"), F.max("arrival_date").alias("last_booking_at"))
    rows = members.select(F.col("id").alias("member_id"), "chain_group_id", "full_name") \
        .join(gross, "member_id", "left").join(spent, "member_id", "left").join(stays, "member_id", "left") \
        .join(reporting, "chain_group_id") \
        .fillna(0, ["gross_revenue", "redemption_value", "bookings_completed", "nights_total"])
    return rows.select("member_id", "chain_group_id", "chain_name", "full_name", "reporting_currency",
                       "gross_revenue", "redemption_value",
                       (F.col("gross_revenue") - F.col("redemption_value")).alias("net_value"),
                       "bookings_completed", "nights_total", "first_booking_at", "last_booking_at")


def top_ltv(values: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` members with the highest net value; ties go to the lower member id."""
    return values.orderBy(F.desc("net_value"), "member_id").limit(k)


def campaign_performance(campaigns: DataFrame, recipients: DataFrame, chains: DataFrame, fx: RateBook) -> DataFrame:
    """Delivery, engagement and attributed revenue per campaign, also for empty campaigns.

    Revenue is converted at the start date of the campaign.
    """
    terms = small(campaigns.select(F.col("id").alias("campaign_id"), "chain_group_id", "start_date")
                  .join(_chains(chains, "reporting_currency"), "chain_group_id")
                  .select("campaign_id", "start_date", "reporting_currency"))
    valued = fx.convert(recipients.join(terms, "campaign_id"), "attributed_revenue", "attributed_currency",
                        "reporting_currency", "start_date", "revenue")
    measured = valued.groupBy("campaign_id").agg(
        F.count("*").alias("recipients_actual"),
        _count(F.col("status").isin("delivered", "opened", "clicked")).alias("delivered"),
        F.count("opened_at").alias("opened"), F.count("clicked_at").alias("clicked"),
        F.count("bounced_at").alias("bounced"), F.count("attributed_booking_id").alias("attributed_bookings"),
        F.sum("revenue").alias("attributed_revenue_reporting"))
    zero = [c for c in measured.columns if c != "campaign_id"]
    return campaigns.select(F.col("id").alias("campaign_id"), "chain_group_id", F.col("name").alias("campaign_name"),
                            "channel", "status", "start_date", "end_date", "recipient_count") \
        .join(_chains(chains, "reporting_currency"), "chain_group_id") \
        .join(measured, "campaign_id", "left").fillna(0, zero)


def chain_overview(chains: DataFrame, hotels: DataFrame, members: DataFrame, bookings: DataFrame,
                   transactions: DataFrame, fx: RateBook, as_of: AsOf, bounded: bool = False) -> DataFrame:
    """Key figures per chain. The 365-day windows look back only; ``bounded`` also ends them at ``as_of``."""
    since, today = _year_before(as_of), day(as_of)

    def recent(c: str) -> Column:
        window = F.col(c) >= since
        return window & (F.col(c) <= today) if bounded else window

    active = F.col("status") == "active"
    open_hotels = hotels.where(active).groupBy("chain_group_id").agg(F.count("*").alias("active_hotels"))
    active_members = members.where(active).groupBy("chain_group_id").agg(F.count("*").alias("active_members"))

    arrival = F.col("arrival_date")
    counts_recent = recent("arrival_date") & (F.col("status") != "cancelled")
    is_upcoming = (arrival >= today) & F.col("status").isin("upcoming", "in_house")
    booked = bookings.where(arrival >= since).groupBy("chain_group_id").agg(
        _count(counts_recent).alias("bookings_last_365d"),
        _count(is_upcoming).alias("bookings_upcoming"),
        _count(counts_recent & (F.col("channel") == "direct")).alias("_direct"))
    posted = transactions.where((F.col("status") == "posted") & recent("posting_date"))
    revenue = _in_reporting_currency(posted, _reporting(chains), fx).groupBy("chain_group_id") \
        .agg(F.sum("reporting").alias("revenue_last_365d_reporting"))

    rows = _chains(chains, "status", "reporting_currency")
    for part in (open_hotels, active_members, booked, revenue):
        rows = rows.join(part, "chain_group_id", "left")
    share = percent(F.col("_direct"), F.col("bookings_last_365d")).alias("direct_share_pct_last_365d")
    zero = ["active_hotels", "active_members", "bookings_last_365d", "bookings_upcoming", "revenue_last_365d_reporting"]
    return rows.select("*", share).drop("_direct").fillna(0, zero)


def hotel_comparison(hotels: DataFrame, chains: DataFrame, bookings: DataFrame, transactions: DataFrame,
                     fx: RateBook, as_of: AsOf, literal_fanout: bool = False) -> DataFrame:
    """Key figures per hotel over the last 365 days.

    Each fact is aggregated per hotel before the join. ``literal_fanout`` gives the
    figures of joining both facts row by row on the hotel instead: booking measures
    multiplied by the hotel's transactions and revenue by its bookings.
    """
    since = _year_before(as_of)
    in_window = F.col("arrival_date") >= since
    kept = in_window & (F.col("status") != "cancelled")
    done = in_window & (F.col("status") == "checked_out")
    stays = (bookings if literal_fanout else bookings.where(in_window)).groupBy("hotel_id").agg(
        F.count("*").alias("_n_bookings"),
        _count(done).alias("bookings_completed_365d"),
        F.sum(F.when(done, F.col("nights"))).alias("nights_365d"),
        _count(kept & (F.col("channel") == "direct")).alias("_direct"), _count(kept).alias("_kept"),
        _count(kept & F.col("is_member_booking")).alias("member_bookings_365d"))

    counted = (F.col("status") == "posted") & (F.col("posting_date") >= since)
    reporting = _reporting(chains)
    revenue = _in_reporting_currency(transactions.where(counted), reporting, fx).groupBy("hotel_id") \
        .agg(F.sum("reporting").alias("revenue_365d_reporting"))
    rows = hotels.select(F.col("id").alias("hotel_id"), "chain_group_id", F.col("name").alias("hotel_name"),
                         "country_code", "room_count") \
        .join(reporting, "chain_group_id") \
        .join(stays, "hotel_id", "left").join(revenue, "hotel_id", "left")
    measures = ["bookings_completed_365d", "nights_365d", "member_bookings_365d"]
    rows = rows.fillna(0, [*measures, "revenue_365d_reporting"])
    rows = rows.withColumn("direct_share_pct_365d", percent(F.col("_direct"), F.col("_kept")))
    if literal_fanout:
        posted_rows = transactions.groupBy("hotel_id").agg(F.count("*").alias("_n_tx"))
        rows = rows.join(posted_rows, "hotel_id", "left")
        times_tx = F.greatest(F.coalesce("_n_tx", F.lit(0)), F.lit(1))
        times_bookings = F.greatest(F.coalesce("_n_bookings", F.lit(0)), F.lit(1))
        rows = rows.withColumns({c: F.col(c) * times_tx for c in measures}) \
            .withColumn("revenue_365d_reporting", F.col("revenue_365d_reporting") * times_bookings)
    return rows.select("hotel_id", "chain_group_id", "chain_name", "hotel_name", "country_code", "room_count",
                       "reporting_currency", *measures[:2], "revenue_365d_reporting", "direct_share_pct_365d",
                       "member_bookings_365d")
