"""Audiences, message queues, attribution, consents and engagement counters."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from stayledger.functions.scalars import day, later, moment, month_of
from stayledger.functions.sizing import small

# --- audience rules ---------------------------------------------------------------

_COMPARE = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}


def segment_condition(definition: str | dict, as_of: date) -> Column:
    """A stored audience rule as a filter column.

    A rule is ``{"type": "all"}``, a combination ``{"type": "and"|"or"|"not", "children":
    [...]}``, or a comparison ``{"type": "member.<column>", "op": ..., "value": ...}``,
    also written ``{"type": "member_attr", "key": ..., "op": ..., "value": ...}``. The
    column ``birthday_month`` with the value "current" means the month of ``as_of``.
    """
    rule = json.loads(definition) if isinstance(definition, str) else definition
    kind = rule["type"]
    if kind == "all":
        return F.lit(True)
    if kind in ("and", "or", "not"):
        parts = [segment_condition(c, as_of) for c in rule.get("children", [])]
        if kind == "not":
            return ~parts[0]
        joined = F.lit(kind == "and")
        for part in parts:
            joined = (joined & part) if kind == "and" else (joined | part)
        return joined
    name = rule["key"] if kind == "member_attr" else kind.removeprefix("member.")
    value = rule["value"]
    if name == "birthday_month":
        value = as_of.month if value == "current" else int(value)
        subject = F.month("birth_date")
    else:
        subject = F.col(name)
    op = rule.get("op", "=")
    if op == "in":
        return subject.isin(value)
    if op not in _COMPARE:
        raise ValueError(f"unknown comparison {op!r}")
    return _COMPARE[op](subject, F.lit(value))


def evaluate_segment(member_360: DataFrame, definition: str | dict, as_of: date) -> DataFrame:
    """The members that fulfil an audience rule; an unknown comparison does not."""
    return member_360.where(segment_condition(definition, as_of))


def audience_sample(members: DataFrame, campaigns: DataFrame, k: int = 200) -> DataFrame:
    """A fixed audience per campaign: the ``k`` members of its chain with the lowest md5 of both ids.

    Each campaign also names its own ``recipient_count``; the smaller number holds. Since
    md5 spreads evenly, a member can only be among the first ``k`` of N when its hash lies
    in roughly the lowest k/N of the range. The join condition drops all others as it
    meets them, with a wide margin; the few campaigns that would still fall short are
    met again without the margin, so the result is exact.
    """
    wanted = F.least(F.col("recipient_count"), F.lit(k))
    sizes = members.groupBy("chain_group_id").agg(F.count("*").alias("_n"))
    asked = campaigns.select(F.col("id").alias("campaign_id"), "chain_group_id", wanted.alias("_k")) \
        .where(F.col("_k") > 0).join(sizes, "chain_group_id")
    # Compare the first 15 hex digits as a number below 2^60.
    share = F.least(F.lit(1.0), (4 * F.col("_k") + 64) / F.col("_n"))
    asked = asked.withColumn("_limit", (share * F.lit(float(2 ** 60))).cast("bigint"))
    asked = small(asked)
    people = members.select(F.col("id").alias("member_id"), F.col("chain_group_id").alias("_chain"))

    def digest() -> Column:
        return F.md5(F.concat(F.col("member_id").cast("string"), F.col("campaign_id").cast("string")))

    def lead() -> Column:
        return F.conv(F.substring(digest(), 1, 15), 16, 10).cast("bigint")

    def first_k(pairs: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("campaign_id").orderBy("_h", "member_id"))
        return pairs.select("campaign_id", "member_id", "_k", "_n", digest().alias("_h")) \
            .withColumn("position", rank).where((F.col("position") <= k) & (F.col("position") <= F.col("_k")))

    near = (F.col("_chain") == F.col("chain_group_id")) & (lead() <= F.col("_limit"))
    found = first_k(people.join(asked, near))
    got = found.groupBy("campaign_id").agg(F.count("*").alias("_got"))
    short = asked.join(got, "campaign_id", "left") \
        .where(F.coalesce("_got", F.lit(0)) < F.least("_k", "_n")).drop("_got")
    again = first_k(people.join(short, F.col("_chain") == F.col("chain_group_id")))
    complete = found.join(short.select("campaign_id"), "campaign_id", "left_anti")
    return complete.unionByName(again).select("campaign_id", "member_id", "position")


# --- message queues ---------------------------------------------------------------

# Countries with invitations in the local language, wording around the name, link, hotel and code, and how
# message ids begin and what is hashed into them.
SCANDINAVIA = ("NO", "SE", "DK")
INVITATION_BODY = ("Hi ", "! Activate your profile: ")
CONFIRMATION_SUBJECT = ("Your reservation at ", " is confirmed")
CONFIRMATION_BODY = "Confirmation: "
INVITATION_ID, CONFIRMATION_ID = ("msg-", "inv"), ("em-", "conf")


def _message_id(booking: Column, kind: tuple[str, str]) -> Column:
    start, salt = kind
    return F.concat(F.lit(start), F.substring(F.md5(F.concat(booking.cast("string"), F.lit(salt))), 1, 12))


def consents_unpivot(members: DataFrame, granted: dict[str, Column] | None = None) -> DataFrame:
    """One consent row per member and type, dated at joining; agreement to the terms is always granted."""
    types = {"email": F.lit(True), "sms": F.lit(True), "offer": F.lit(True), "user_agreement": F.lit(True)}
    types.update(granted or {})
    types["user_agreement"] = F.lit(True)
    rows = F.array(*[F.struct(F.lit(t).alias("consent_type"), g.alias("granted")) for t, g in types.items()])
    source = F.when(F.col("recruited_via_ota"), "pms_import").otherwise("signup_widget")
    return members.select(F.col("id").alias("member_id"), F.col("joined_at").alias("granted_at"),
                          source.alias("source"), F.inline(rows)) \
        .select("member_id", "consent_type", "granted", "granted_at", "source")


def latest_consents(consents: DataFrame) -> DataFrame:
    """The current consent per member and type: the newest row, a refusal first when tied."""
    newest = F.max(F.struct("granted_at", (~F.col("granted")).alias("refused"))).alias("n")
    return consents.groupBy("member_id", "consent_type").agg(newest) \
        .select("member_id", "consent_type", (~F.col("n.refused")).alias("granted"),
                F.col("n.granted_at").alias("granted_at"))


CONSENT_TYPES = ("email", "sms", "offer", "user_agreement")


def current_consents(consents: DataFrame) -> DataFrame:
    """One row per member with the current consent of each type; NULL where none was recorded.

    One aggregation per member; the newest row per type is found by conditional maxima.
    """
    def newest(t: str) -> Column:
        row = F.struct("granted_at", (~F.col("granted")).alias("refused"))
        return F.max(F.when(F.col("consent_type") == t, row)).alias(f"_{t}")

    wide = consents.groupBy("member_id").agg(*[newest(t) for t in CONSENT_TYPES])
    return wide.select("member_id", *[(~F.col(f"_{t}.refused")).alias(f"{t}_consent") for t in CONSENT_TYPES])


def _consenting(members: DataFrame, consents: DataFrame | None, consent_type: str, key: str = "member_id") -> DataFrame:
    if consents is None:
        return members
    allowed = latest_consents(consents.where(F.col("consent_type") == consent_type)).where("granted")
    return members.join(allowed.select(F.col("member_id").alias(key)), key, "left_semi")


def localized_templates(templates: DataFrame, languages: DataFrame) -> DataFrame:
    """One row per template and language, as asked; the languages go to the templates after a check of their size."""
    return templates.join(small(languages), F.lit(True))


def pick_template(queue: DataFrame, templates: DataFrame, code: str) -> DataFrame:
    """Add the template of ``code`` in the language of each queued message, NULL if there is none."""
    texts = small(templates.where(F.col("code") == code).select("language", F.col("id").alias("template_id")))
    return queue.join(texts, "language", "left")


def ota_invitation_queue(bookings: DataFrame, members: DataFrame, consents: DataFrame | None = None,
                         link: str = "https://join.example/") -> DataFrame:
    """SMS invitations for agency bookings of members with a phone number.

    Queued five and sent six minutes after booking. Pass ``consents`` to keep only
    members with a current SMS consent.
    """
    people = members.where(F.col("phone_e164").isNotNull()) \
        .select(F.col("id").alias("member_id"), "first_name", "phone_e164", "country_code")
    people = _consenting(people, consents, "sms")
    booked = bookings.where((F.col("channel") == "ota") & F.col("member_id").isNotNull()) \
        .select(F.col("id").alias("booking_id"), "chain_group_id", "hotel_id", "member_id", "booked_at")
    nordic = F.col("country_code").isin(*SCANDINAVIA)
    greeting, request = map(F.lit, INVITATION_BODY)
    token = F.substring(F.md5(F.col("booking_id").cast("string")), 1, 22)
    text = F.concat(greeting, F.col("first_name"), request, F.lit(link), token)
    return booked.join(people, "member_id").select(
        "booking_id", "chain_group_id", "hotel_id", "member_id", F.lit("sms").alias("channel"),
        F.lit("personal_invitation").alias("category"), F.col("phone_e164").alias("to_phone"), text.alias("body"),
        F.when(nordic, "nb").otherwise("en").alias("language"),
        later(F.col("booked_at"), mins=5).alias("queued_at"), later(F.col("booked_at"), mins=6).alias("sent_at"),
        _message_id(F.col("booking_id"), INVITATION_ID).alias("external_message_id"),
        nordic.alias("scandinavia_flag"))


def booking_confirmation_queue(bookings: DataFrame, members: DataFrame, hotels: DataFrame,
                               consents: DataFrame | None = None) -> DataFrame:
    """Confirmation e-mails for direct and corporate bookings of members with an address."""
    people = members.where(F.col("email").isNotNull()).select(F.col("id").alias("member_id"), F.col("email").alias("to_email"))
    people = _consenting(people, consents, "email")
    booked = bookings.where(F.col("channel").isin("direct", "corporate") & F.col("member_id").isNotNull()) \
        .select(F.col("id").alias("booking_id"), "chain_group_id", "hotel_id", "member_id", "booked_at",
                "pms_confirmation_code")
    houses = small(hotels.select(F.col("id").alias("hotel_id"), F.col("name").alias("hotel_name")))
    lead, rest = map(F.lit, CONFIRMATION_SUBJECT)
    return booked.join(houses, "hotel_id").join(people, "member_id").select(
        "booking_id", "chain_group_id", "hotel_id", "member_id", F.lit("email").alias("channel"),
        F.lit("transactional").alias("category"), "to_email",
        F.concat(lead, F.col("hotel_name"), rest).alias("subject"), F.concat(F.lit(CONFIRMATION_BODY), F.col("pms_confirmation_code")).alias("body"),
        later(F.col("booked_at"), mins=1).alias("queued_at"), later(F.col("booked_at"), mins=2).alias("delivered_at"),
        _message_id(F.col("booking_id"), CONFIRMATION_ID).alias("external_message_id"))


# --- attribution and counters -----------------------------------------------------

def attribute_bookings(recipients: DataFrame, bookings: DataFrame, window_days: int = 30) -> DataFrame:
    """Credit each booking to the last campaign message its member got within the window before it.

    Messages and bookings are never paired up. The last message so far is carried forward
    within a member and day, and over the days of a member on one row per day, so a
    member with very many rows still spreads over all days. Of messages sent at the same
    moment the one of the highest campaign id counts.
    """
    touches = recipients.where(F.col("sent_at").isNotNull()).select(
        "member_id", F.col("sent_at").alias("at"), F.struct("sent_at", "campaign_id").alias("touch"))
    booked = bookings.where(F.col("member_id").isNotNull() & F.col("booked_at").isNotNull()
                            & (F.col("status") != "cancelled")) \
        .select("member_id", F.col("booked_at").alias("at"),
                F.struct(F.col("id").alias("booking_id"), "total_amount", "currency").alias("booking"))
    events = touches.unionByName(booked, allowMissingColumns=True) \
        .withColumn("day", F.datediff("at", F.lit(date(1970, 1, 1))))

    # A message precedes the bookings of its moment; the greatest so far is the last. The
    # last row of a day holds the last message of that day.
    in_day = Window.partitionBy("member_id", "day").orderBy("at", F.col("booking").isNotNull())
    stepped = events.withColumn("last", F.max("touch").over(in_day.rowsBetween(Window.unboundedPreceding, Window.currentRow))) \
        .withColumn("is_last", F.lead("day").over(in_day).isNull())
    before = Window.partitionBy("member_id").orderBy("day").rangeBetween(-window_days, -1)
    carried = stepped.where("is_last").select("member_id", "day", F.max("last").over(before).alias("carried"))
    seen = stepped.where(F.col("booking").isNotNull())

    found = seen.join(carried, ["member_id", "day"]).withColumn("last", F.coalesce("last", "carried"))
    recent = F.col("last.sent_at") >= F.col("at") - F.make_dt_interval(F.lit(window_days))
    return found.where(recent).select(
        F.col("last.campaign_id").alias("campaign_id"), "member_id", F.col("booking.booking_id").alias("booking_id"),
        F.col("booking.total_amount").alias("attributed_revenue"), F.col("booking.currency").alias("attributed_currency"))


def campaign_counters(recipients: DataFrame) -> DataFrame:
    """The stored totals of a campaign, rebuilt from its recipients."""
    return recipients.groupBy("campaign_id").agg(
        F.count("*").alias("recipient_count"),
        F.count_if(F.col("status").isin("delivered", "opened", "clicked")).alias("delivered_count"),
        F.count("opened_at").alias("opened_count"), F.count("clicked_at").alias("clicked_count"),
        F.count("bounced_at").alias("bounced_count"), F.count("attributed_booking_id").alias("attributed_bookings"),
        F.coalesce(F.sum("attributed_revenue"), F.lit(0)).alias("attributed_revenue"))


def sms_billing(communications: DataFrame) -> DataFrame:
    """Logical and billable SMS per chain and month of sending."""
    sms = communications.where((F.col("channel") == "sms") & F.col("sent_at").isNotNull())
    return sms.groupBy("chain_group_id", month_of("sent_at").alias("month")).agg(
        F.count("*").alias("messages"), F.sum("sms_logical_count").alias("logical_count"),
        F.sum("sms_real_count").alias("real_count"))


def automation_run_stats(runs: DataFrame, automations: DataFrame) -> DataFrame:
    """Runs per flow and status."""
    states = ("queued", "running", "completed", "failed", "skipped")
    counted = runs.groupBy("automation_id").agg(
        F.count("*").alias("runs"), *[F.count_if(F.col("status") == s).alias(s) for s in states])
    return automations.select(F.col("id").alias("automation_id"), "chain_group_id", "code", "trigger_type") \
        .join(counted, "automation_id", "left").fillna(0, ["runs", *states])


def ota_to_direct_converts(bookings: DataFrame) -> DataFrame:
    """Members whose first booking came through an agency and a later one directly.

    One aggregate per member: the earliest booking, and the latest direct arrival.
    """
    kept = bookings.where(F.col("member_id").isNotNull() & (F.col("status") != "cancelled"))
    per_member = kept.groupBy("member_id").agg(
        F.min(F.struct("arrival_date", "id", "channel")).alias("first"),
        F.min(F.when(F.col("channel") == "direct", F.col("arrival_date"))).alias("first_direct_at"),
        F.max(F.when(F.col("channel") == "direct", F.col("arrival_date"))).alias("_last_direct"))
    return per_member.where((F.col("first.channel") == "ota") & (F.col("_last_direct") > F.col("first.arrival_date"))) \
        .select("member_id", F.col("first.arrival_date").alias("first_booking_at"), "_last_direct") \
        .withColumnRenamed("_last_direct", "last_direct_at")


# --- automation triggers ----------------------------------------------------------

def ota_booking_candidates(bookings: DataFrame, delay_minutes: int = 5, channel: str = "ota") -> DataFrame:
    """Members to contact after a booking of the given channel; due when the delay is over."""
    return bookings.where((F.col("channel") == channel) & F.col("member_id").isNotNull()
                          & F.col("booked_at").isNotNull()) \
        .select("member_id", F.col("id").alias("booking_id"),
                later(F.col("booked_at"), mins=delay_minutes).alias("due_at"))


def _same_day(day_of: Column, as_of: date) -> Column:
    """Whether the calendar day comes round on ``as_of``; 29 February does so on the 28th in common years."""
    same = (F.month(day_of) == as_of.month) & (F.dayofmonth(day_of) == as_of.day)
    common_year = as_of.year % 4 != 0 or (as_of.year % 100 == 0 and as_of.year % 400 != 0)
    if (as_of.month, as_of.day) == (2, 28) and common_year:
        same = same | ((F.month(day_of) == 2) & (F.dayofmonth(day_of) == 29))
    return same


def birthday_candidates(members: DataFrame, as_of: date) -> DataFrame:
    """Active members whose birthday is ``as_of``; those of 29 February celebrate on the 28th in common years."""
    return members.where((F.col("status") == "active") & _same_day(F.col("birth_date"), as_of)).select(F.col("id").alias("member_id"), "birth_date")


def inactive_candidates(members: DataFrame, bookings: DataFrame, as_of: date, days_inactive: int = 270) -> DataFrame:
    """Active members without an arrival for ``days_inactive`` days, members who never came included."""
    last = bookings.where(F.col("member_id").isNotNull() & (F.col("status") != "cancelled")) \
        .groupBy("member_id").agg(F.max("arrival_date").alias("last_arrival"))
    idle = F.col("last_arrival").isNull() | (F.col("last_arrival") <= F.date_sub(day(as_of), days_inactive))
    return members.where(F.col("status") == "active").select(F.col("id").alias("member_id")) \
        .join(last, "member_id", "left").where(idle)


def expiring_candidates(balances: DataFrame, min_points: int = 1) -> DataFrame:
    """Members with points that lapse within the next thirty days."""
    return balances.where(F.col("expiring_30d") >= min_points).select("member_id", "expiring_30d")


def tier_change_candidates(changes: DataFrame, direction: str = "promote") -> DataFrame:
    """Members whose qualification moves them up ("promote") or down ("demote")."""
    return changes.where(F.col("change") == direction) \
        .select("member_id", "current_tier_id", "qualified_tier_id")


def status_candidates(history: DataFrame, to_status: str) -> DataFrame:
    """Bookings that entered a status (check-in, check-out, cancellation) and when.

    A completed stay goes from upcoming to checked_out at check-in and from in_house to checked_out at check-out;
    so the first of these counts as check-in and only the second as check-out.
    """
    entered = F.col("to_status") == to_status
    arrived = (F.col("from_status") == "upcoming") & (F.col("to_status") == "checked_out")
    if to_status == "in_house":
        entered = entered | arrived
    elif to_status == "checked_out":
        entered = entered & (F.col("from_status") == "in_house")
    return history.where(entered & F.col("occurred_at").isNotNull()) \
        .groupBy("booking_id").agg(F.min("occurred_at").alias("due_at"))


def anniversary_candidates(members: DataFrame, as_of: date) -> DataFrame:
    """Active members who joined on this calendar day in an earlier year."""
    joined = F.col("joined_at").cast("date")
    same_day = _same_day(joined, as_of) & (F.year(joined) < as_of.year)
    return members.where((F.col("status") == "active") & same_day) \
        .select(F.col("id").alias("member_id"), (F.lit(as_of.year) - F.year(joined)).alias("years"))


def automation_candidates(trigger: str, frames: dict[str, DataFrame], as_of: date, due_only: bool = False,
                          **config) -> DataFrame:
    """Who a flow applies to, by the name of its trigger.

    ``frames`` names what the trigger reads: members, bookings, balances, status_history
    or tier_changes. ``config`` goes to the trigger, e.g. ``days_inactive``. With ``due_only``
    the triggers that fall due at a moment give only those due by ``as_of``.
    """
    entered = {"booking_cancelled": "cancelled", "check_in": "in_house", "check_out": "checked_out"}
    if trigger in entered:
        found = status_candidates(frames["status_history"], entered[trigger])
        return found.where(F.col("due_at") <= moment(as_of)) if due_only else found
    triggers = {
        "ota_booking_received": lambda: ota_booking_candidates(frames["bookings"], **config),
        "direct_booking_received": lambda: ota_booking_candidates(frames["bookings"], channel="direct", **config),
        "tier_upgrade": lambda: tier_change_candidates(frames["tier_changes"], "promote"),
        "tier_downgrade": lambda: tier_change_candidates(frames["tier_changes"], "demote"),
        "birthday": lambda: birthday_candidates(frames["members"], as_of),
        "anniversary": lambda: anniversary_candidates(frames["members"], as_of),
        "points_expiring": lambda: expiring_candidates(frames["balances"], **config),
        "inactive_member": lambda: inactive_candidates(frames["members"], frames["bookings"], as_of, **config),
    }
    if trigger not in triggers:
        raise ValueError(f"unknown trigger {trigger!r}")
    found = triggers[trigger]()
    return found.where(F.col("due_at") <= moment(as_of)) if due_only and "due_at" in found.columns else found
