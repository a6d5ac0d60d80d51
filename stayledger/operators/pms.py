"""Property-system feeds: normalization, channel classification, error routing and derived stay rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stayledger.functions.scalars import at_midnight, excel_serial, later
from stayledger.functions.sizing import small
from stayledger.sources.tables import insert_ignore

# Names of external id systems in feeds and in the tables.
EXTERNAL_ID_TYPES = {"FMOldId": "fm_old_id", "SJprioId": "sj_prio_id", "GuestConnectId": "guest_connect_id",
                     "PMSGuestId": "pms_guest_id"}

# Online travel agencies, and what a booking channel says about the segment.
OTA_MANAGERS = ("Booking.com", "Expedia", "Hotels.com", "Agoda", "Trip.com")
CHANNEL_SEGMENTS = [
    # channel, segment code, segment label, source code, business segment, origin
    ("ota", "OTA", "OTA - Online travel agency", "Channel Manager", "Unqualified discount rate", "ChannelManager"),
    ("direct", "WEB", "WEB - Direct chain web booking", "Brand.com", "Rack rate", "Direct"),
    ("corporate", "CGN", "CGN - Corporate groups on negotiated rates", "Company direct", "Negotiated rate", "Direct"),
    ("group", "GRP", "GRP - Group block reservation", None, "Group rate", "Direct"),
    ("walk_in", "WLK", "WLK - Walk-in guest", None, "Other", "Walk-In"),
]
_OTHER_SEGMENT = ("WLK", "WLK - Walk-in guest", None, "Other", "Direct")

EXTERNAL_ID_SCHEMA = "array<struct<Type:string,Value:string,ValidFromUtc:string,IsValid:int>>"


def explode_external_ids(members: DataFrame) -> DataFrame:
    """One row per external id in the members' JSON; on a repeated (type, value) the lowest member id wins."""
    entry = F.explode(F.from_json("external_membership_raw", EXTERNAL_ID_SCHEMA)).alias("e")
    listed = members.where(F.col("external_membership_raw").isNotNull()).select(F.col("id").alias("member_id"), entry)
    id_type = F.lit("legacy_other")
    for feed_name, name in EXTERNAL_ID_TYPES.items():
        id_type = F.when(F.col("e.Type") == feed_name, F.lit(name)).otherwise(id_type)
    rows = listed.select("member_id", id_type.alias("id_type"), F.col("e.Value").alias("id_value"),
                         (F.col("e.IsValid") == 1).alias("is_valid"),
                         F.col("e.ValidFromUtc").try_cast("timestamp_ntz").alias("valid_from"))
    return insert_ignore(rows, None, ["id_type", "id_value"], ["member_id", "valid_from"])


# The fields of all feeds in one schema: a payload is parsed once, absent fields are NULL.
PAYLOAD_SCHEMA = """
    reservation_number string, department_id string, arrival_time string, departure_time string,
    reservation_source string, transaction_sum decimal(14,2), currency string,
    enterprise string, program_id string, reservation_nr string, origin string, channel_manager string,
    business_segment string, rate_group string, rate string, service_name string, source_code string,
    bill_amount decimal(14,2), bill_currency string, booking_start double, booking_end double,
    reservation_id string, booking_id string, amount decimal(14,2), guest_email string
"""


def classify_channel(channel_manager: Column, source_code: Column, rate_group: Column, origin: Column) -> Column:
    """Booking channel by the first rule that fits: agency, company, group block, own sales, else other."""
    group_rate = F.upper(rate_group).startswith("GROUP") | F.upper(rate_group).startswith("GRP")
    return F.when(channel_manager.isin(*OTA_MANAGERS), "ota") \
        .when(source_code == "Company direct", "corporate") \
        .when(group_rate, "group") \
        .when(origin.isin("Direct", "Web", "Phone") | source_code.isin("Brand.com", "Web", "Phone"), "direct") \
        .otherwise("other")


def normalize_payloads(raw: DataFrame) -> DataFrame:
    """Reservations of all property systems in one shape, from one parse of the raw JSON.

    Spreadsheet serial dates are turned into dates. Payloads that are no JSON object
    yield NULL fields, which ``route_sync_errors`` reports.
    """
    p = raw.withColumn("p", F.from_json("payload", PAYLOAD_SCHEMA, {"mode": "PERMISSIVE"}))

    def by_system(stayntouch, mews, protel, visbook) -> Column:
        code = F.col("pms_code")
        return F.when(code == "stayntouch", stayntouch).when(code == "mews", mews) \
            .when(code == "protel_air", protel).when(code == "visbook", visbook)

    none = F.lit(None)
    starts = by_system(F.col("p.arrival_time").try_cast("timestamp_ntz"), excel_serial("p.booking_start"), none, none)
    ends = by_system(F.col("p.departure_time").try_cast("timestamp_ntz"), excel_serial("p.booking_end"), none, none)
    return p.select(
        "id", "import_id", "pms_code",
        by_system(F.col("p.reservation_number"), F.col("p.reservation_nr"), F.col("p.reservation_id"),
                  F.col("p.booking_id")).alias("pms_reservation_no"),
        F.col("p.department_id").alias("external_property_id"),
        starts.cast("date").alias("arrival_date"), ends.cast("date").alias("departure_date"),
        by_system(F.col("p.transaction_sum"), F.col("p.bill_amount"), F.col("p.amount"), F.col("p.amount"))
        .alias("total_amount"),
        F.coalesce("p.bill_currency", "p.currency").alias("currency"),
        classify_channel(F.col("p.channel_manager"), F.col("p.source_code"), F.col("p.rate_group"),
                         F.col("p.origin")).alias("channel"),
        F.coalesce("p.reservation_source", "p.origin").alias("reservation_source_label"),
        F.col("p.channel_manager").alias("channel_manager"), F.col("p.business_segment").alias("business_segment"),
        F.col("p.rate_group").alias("rate_group_code"), F.lower("p.guest_email").alias("guest_email"))


def pms_property_lookup(reservations: DataFrame, connections: DataFrame) -> DataFrame:
    """Add ``hotel_id`` by the active connection of the reservation's external property; NULL if unknown."""
    active = small(connections.where(F.col("is_active")).select("pms_code", "external_property_id", "hotel_id"))
    return reservations.join(active, ["pms_code", "external_property_id"], "left")


def sync_errors(reservations: DataFrame, hotels: DataFrame, need_email: bool = True) -> DataFrame:
    """Add ``error_codes``: what keeps each reservation from being taken over.

    Expects ``hotel_id`` from the property lookup. The rows are read twice, so pass a
    table in which the payloads are already parsed. Of several rows with one reservation
    number the lowest id is kept. Counting copies is a partial aggregate. Rows without a
    number are no copies of each other and spread over all tasks of the join by their id; those of a
    number that fills a large part of a feed meet one row in the join, where AQE splits them.
    """
    key = ["pms_code", "pms_reservation_no"]
    copies = reservations.groupBy(*key).agg(F.count("*").alias("_n"), F.min("id").alias("_first")) \
        .where(F.col("pms_reservation_no").isNotNull() & (F.col("_n") > 1)).drop("_n").withColumn("_spread", F.lit(0).cast("bigint"))
    spread = F.when(F.col("pms_reservation_no").isNull(), F.xxhash64("id")).otherwise(0)
    local = small(hotels.select(F.col("id").alias("hotel_id"), F.col("default_currency").alias("_ccy")))
    rows = reservations.withColumn("_spread", spread).join(copies, [*key, "_spread"], "left").drop("_spread").join(local, "hotel_id", "left")
    tests = {
        "MAP_MISSING": F.col("hotel_id").isNull() | F.col("pms_reservation_no").isNull(),
        "CCY_MISMATCH": F.col("_ccy").isNotNull() & ~F.col("currency").eqNullSafe(F.col("_ccy")),
        "DUP_RESV": F.col("id") != F.col("_first"),
    }
    if need_email:
        tests["MISSING_EMAIL"] = F.col("guest_email").isNull()
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests.items()]))
    return rows.withColumn("error_codes", codes).drop("_first", "_ccy")


def route_sync_errors(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split checked reservations into valid ones and one error row per code."""
    valid = checked.where(F.size("error_codes") == 0).drop("error_codes")
    errors = checked.select("import_id", "id", "pms_code", "pms_reservation_no",
                            F.explode("error_codes").alias("error_code"))
    return valid, errors


def dedupe_payloads(raw: DataFrame) -> DataFrame:
    """One row per distinct payload: the earliest, then the lowest id; with its hash and number of copies.

    Copies are counted and reduced before the shuffle, so a payload that makes up a large
    part of the feed costs one row per task.
    """
    hashed = raw.withColumn("payload_hash", F.sha2(F.col("payload").cast("string"), 256))
    first = F.min(F.struct("ingested_at", "id", "import_id", "pms_code", "payload")).alias("first")
    return hashed.groupBy("payload_hash").agg(first, F.count("*").alias("copies")) \
        .select("first.id", "first.import_id", "first.pms_code", "first.payload", "first.ingested_at",
                "payload_hash", "copies")


def import_summary(checked: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Rows seen, taken over and refused per import, with the resulting status.

    With ``imports`` (id), an import that brought no rows has a line as well, and counts as completed;
    rows of an import that is not listed keep theirs.
    """
    ok = F.size("error_codes") == 0
    counted = checked.groupBy("import_id").agg(
        F.count("*").alias("rows_total"), F.count_if(ok).alias("rows_succeeded"), F.count_if(~ok).alias("rows_failed"))
    if imports is not None:
        counted = counted.join(imports.select(F.col("id").alias("import_id")).distinct(), "import_id", "full") \
            .na.fill(0, ["rows_total", "rows_succeeded", "rows_failed"])
    status = F.when(F.col("rows_failed") == 0, "completed").when(F.col("rows_succeeded") == 0, "failed") \
        .otherwise("partial")
    return counted.withColumn("status", status)


def channel_segments(spark) -> DataFrame:
    return spark.createDataFrame(CHANNEL_SEGMENTS, """channel string, market_segment_code string,
        market_segment_label string, source_code string, business_segment string, origin string""")


def segment_from_channel(bookings: DataFrame, mapping: DataFrame) -> DataFrame:
    """Market segment, source and origin of each booking by its channel; unlisted channels count as walk-in."""
    names = [c for c in mapping.columns if c != "channel"]
    rows = bookings.select(F.col("id").alias("booking_id"), "channel") \
        .join(small(mapping).withColumn("_listed", F.lit(True)), "channel", "left")
    listed = F.col("_listed").isNotNull()
    filled = [F.when(listed, F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in zip(names, _OTHER_SEGMENT)]
    return rows.select("booking_id", "channel", *filled, F.lit("Accommodation").alias("service_name"))


def room_stays_from_bookings(bookings: DataFrame) -> DataFrame:
    """One row per room: the first at the nightly rate, a second one at 85 % of it; one pass.

    Each amount is rounded once, from the exact nightly rate.
    """
    rate = F.col("total_amount") / F.nullif(F.col("nights"), F.lit(0)).cast("decimal(10,0)")
    first = F.round(rate, 2).cast("decimal(14,2)")
    second = F.round(F.col("total_amount") * F.lit("0.85").cast("decimal(3,2)")
                     / F.nullif(F.col("nights"), F.lit(0)).cast("decimal(10,0)"), 2).cast("decimal(14,2)")

    def room(no: int, amount: Column) -> Column:
        return F.struct(F.lit(no).alias("room_index"), amount.alias("rate_amount_per_night"))

    rooms = F.when(F.col("num_rooms") >= 2, F.array(room(1, first), room(2, second))) \
        .otherwise(F.array(room(1, first)))
    return bookings.select(F.col("id").alias("booking_id"), "hotel_id", "arrival_date", "departure_date", "currency",
                           F.inline(rooms))


ORDER_LINES_SCHEMA = """array<struct<ProductType:string,Quantity:decimal(14,4),Sum:decimal(14,2),
    LineInfo:string,BonusFactor:decimal(8,4)>>"""


def explode_order_lines(raw: DataFrame, column: str = "order_lines") -> DataFrame:
    """Order-line JSON of a posting to transaction lines; a missing factor counts as one."""
    line = F.explode(F.from_json(column, ORDER_LINES_SCHEMA)).alias("l")
    one = F.lit(1).cast("decimal(14,4)")
    quantity = F.coalesce(F.col("l.Quantity"), one)
    unit = F.round(F.col("l.Sum") / F.nullif(quantity, F.lit(0).cast("decimal(14,4)")), 4).cast("decimal(14,4)")
    return raw.select("transaction_id", "currency", line).select(
        "transaction_id", F.col("l.ProductType").alias("product_type"), F.col("l.LineInfo").alias("line_info"),
        quantity.alias("quantity"), unit.alias("unit_amount"), F.col("l.Sum").alias("amount"), "currency",
        F.coalesce(F.col("l.BonusFactor"), F.lit(1)).cast("decimal(8,4)").alias("bonus_factor"))


def status_history_from_bookings(bookings: DataFrame) -> DataFrame:
    """Status changes of each booking, rebuilt from its timestamps in one pass.

    A completed stay is entered straight from upcoming at check-in and then once more
    from in_house at check-out, as the source derives it.
    """
    status = F.col("status")
    entered = F.when(status == "cancelled", F.col("cancelled_at")) \
        .when(status.isin("in_house", "checked_out"), F.col("check_in_at")) \
        .when(status == "no_show", later(at_midnight("arrival_date"), hours=23))

    def change(when: Column, old, new: Column | str, at: Column) -> Column:
        new = F.lit(new) if isinstance(new, str) else new
        step = F.struct(F.lit(old).cast("string").alias("from_status"), new.alias("to_status"), at.alias("occurred_at"))
        return F.when(when, step)

    steps = F.array_compact(F.array(
        change(F.col("booked_at").isNotNull(), None, "upcoming", F.col("booked_at")),
        change(status != "upcoming", "upcoming", status, entered),
        change(status == "checked_out", "in_house", "checked_out", F.col("check_out_at"))))
    return bookings.select(F.col("id").alias("booking_id"), F.inline(steps))
