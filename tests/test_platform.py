"""Change capture, data quality, table writing, feeds, search, schemas and streams."""

import json
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from stayledger import schemas
from stayledger.functions import scalars
from stayledger.operators import audit, pms, quality, search, tiers
from stayledger.operators.access import Principal
from stayledger.sources import feeds, tables
from stayledger.streaming import streams

ACTOR = Principal("chain_admin", "a", sub="u1")


def test_audit_replays_before_into_after(spark):
    schema = "id int, chain_group_id string, name string, tags array<string>"
    before = spark.createDataFrame([(1, "a", "x", ["p"]), (2, "a", None, None), (3, "b", "z", []), (4, "b", "same", None)], schema)
    after = spark.createDataFrame([(1, "a", "x", ["q"]), (2, "a", "now", None), (4, "b", "same", None), (5, "c", None, ["n"])], schema)
    log = audit.audit_diff(before, after, "members", ACTOR).collect()
    assert {(r["record_id"], r["action"], r["chain_group_id"]) for r in log} == \
        {(1, "update", "a"), (2, "update", "a"), (3, "delete", "b"), (5, "insert", "c")}
    state = {r["id"]: r.asDict() for r in before.collect()}
    for r in log:
        if r["before_value"] is not None:
            assert json.loads(r["before_value"]) == state[r["record_id"]]
            del state[r["record_id"]]
        if r["after_value"] is not None:
            state[r["record_id"]] = json.loads(r["after_value"])
    assert state == {r["id"]: r.asDict() for r in after.collect()}


def test_audit_of_insert_only_tables_and_map_columns(spark):
    schema = "id int, m map<string,int>"
    before = spark.createDataFrame([(1, {"a": 1}), (2, {"a": 1})], schema)
    after = spark.createDataFrame([(1, {"a": 2}), (3, None)], schema)
    assert [r["action"] for r in audit.audit_diff(before, after, "member_tier_history", ACTOR).collect()] == ["insert"]
    assert audit.audit_diff(before, after, "tiers", ACTOR).count() == 3


def test_manual_points_are_audited_from_either_side(spark):
    schema = "id int, chain_group_id string, type string, points_delta int"
    before = spark.createDataFrame([(1, "a", "redeem", 1), (2, "a", "manual_adjustment", 1), (3, "a", "manual_adjustment", 1), (4, "a", "redeem", 1)], schema)
    after = spark.createDataFrame([(1, "a", "manual_adjustment", 1), (2, "a", "redeem", 1), (4, "a", "redeem", 2), (5, "a", "manual_adjustment", 9),
                                   (6, "a", "redeem", 9)], schema)
    got = {(r["record_id"], r["action"]) for r in audit.audit_manual_points(before, after, ACTOR).collect()}
    assert got == {(1, "update"), (2, "update"), (3, "delete"), (5, "manual_adjust")}


def test_insert_ignore(spark):
    batch = spark.createDataFrame([("k", "1", 5, "late"), ("k", "1", 2, "early"), ("k", "2", 1, "taken"), (None, "1", 1, "a"), (None, "1", 1, "a")],
                                  "t string, v string, n int, note string")
    target = spark.createDataFrame([("k", "2"), (None, "1")], "t string, v string")
    got = sorted(map(tuple, tables.insert_ignore(batch, target, ["t", "v"], ["n"]).collect()), key=str)
    assert got == sorted([("k", "1", 2, "early"), (None, "1", 1, "a"), (None, "1", 1, "a")], key=str)
    assert tables.insert_ignore(batch.select("t", "v"), None, ["t", "v"], []).count() == 4


def test_update_and_numbering(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    new = spark.createDataFrame([(2, None), (3, "z")], "id int, v string")
    assert sorted(map(tuple, tables.update_from(rows, new, ["id"], ["v"]).collect())) == [(1, "a"), (2, None), (3, "z")]
    odd = spark.range(1000).select((F.col("id") * 7 + F.col("id") % 3).alias("id"))
    got = [tuple(r) for r in tables.numbered(odd, "id", pieces=8).orderBy("position").collect()]
    assert got == [(v, i + 1) for i, v in enumerate(sorted(x * 7 + x % 3 for x in range(1000)))]
    months = [r["month"] for r in tables.months_between(spark, date(2023, 11, 1), date(2024, 2, 1)).collect()]
    assert months == [date(2023, 11, 1), date(2023, 12, 1), date(2024, 1, 1), date(2024, 2, 1)]


def test_tables_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(1, date(2024, 1, 5)), (2, date(2024, 2, 5))], "id int, arrival_date date")
    path = str(tmp_path / "t")
    tables.reload(rows, path, "arrival_date")
    tables.append(rows, path, "arrival_date")
    read = tables.read_table(spark, path, rows.schema)
    assert read.count() == 4
    months = spark.read.parquet(path).where(F.col("month") == date(2024, 2, 1))
    assert months.count() == 2 and "PartitionFilters: [isnotnull(month" in months._jdf.queryExecution().executedPlan().toString()
    tables.reload(rows, path, "arrival_date")
    assert tables.read_table(spark, path).count() == 2
    folder = str(tmp_path / "s")
    for n in (2, 1):
        tables.save_snapshot(rows.limit(n), folder, date(2024, 1, 1))
    tables.save_snapshot(rows, folder, date(2024, 1, 2))
    assert [tables.load_snapshot(spark, folder, date(2024, 1, d)).count() for d in (1, 2)] == [1, 2]


def test_recent_months_only(spark, tmp_path):
    rows = spark.createDataFrame([(m, date(2024, m, 20)) for m in range(1, 7)], "id int, arrival_date date")
    path = str(tmp_path / "t")
    tables.append(rows, path, "arrival_date")
    got = tables.read_since(spark, path, "arrival_date", date(2024, 4, 21), rows.schema)
    assert sorted(r["id"] for r in got.collect()) == [5, 6] and got.columns == rows.columns
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "month" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_feeds(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Reservation Number;Department ID;Amount\n100;2401;12,5\n101;2402;\n", encoding="utf-8")
    got = feeds.read_csv_feed(spark, str(tmp_path / "a.csv"), "`Reservation Number` string, `Department ID` string, Amount string",
                              "imp1", "stayntouch", "Reservation Number").orderBy("source_id").collect()
    assert [r["source_id"] for r in got] == ["100", "101"]
    assert json.loads(got[0]["payload"]) == {"Reservation Number": "100", "Department ID": "2401", "Amount": "12,5"}
    (tmp_path / "b.json").write_text('[{"booking_id":"VB-1","amount":5.5,"currency":"SEK"},{"booking_id":"VB-2"}]')
    rows = feeds.read_json_feed(spark, str(tmp_path / "b.json"), "booking_id string, amount decimal(14,2), currency string", "imp2", "visbook",
                                "booking_id", multi_line=True)
    normal = pms.normalize_payloads(rows.withColumn("id", F.col("source_id"))).orderBy("id").collect()
    assert [(r["pms_reservation_no"], r["total_amount"], r["currency"]) for r in normal] == [("VB-1", D("5.50"), "SEK"), ("VB-2", None, None)]


def test_feeds_keep_all_fields_and_report_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("no;amount;note\n1;5.5;x\n2;many;y\n3\n4;1.0;z;more\n", encoding="utf-8")
    landed = feeds.read_csv_feed(spark, str(tmp_path / "a.csv"), "no string, amount decimal(14,2)", "imp1", "other", "no")
    rows = {r["source_id"]: r for r in landed.collect()}
    assert json.loads(rows["1"]["payload"]) == {"no": "1", "amount": 5.5, "note": "x"} and rows["1"]["raw_row"] is None
    assert json.loads(rows["2"]["raw_row"]) == {"no": "2", "amount": "many", "note": "y"}
    assert rows["3"]["raw_row"] == "3" and rows["4"]["raw_row"] == "4;1.0;z;more"
    assert sorted(r["source_id"] for r in feeds.feed_errors(landed).collect()) == ["2", "3", "4"]
    lines = ['{"no":"1","extra":"kept?","nested":{"a":1}}', '{"no":"2","amount":"many"}', "no json"]
    (tmp_path / "b.json").write_text("\n".join([*lines, ""]))
    landed = feeds.read_json_feed(spark, str(tmp_path / "b.json"), "no string, amount decimal(14,2)", "imp2", "other", "no")
    assert sorted(r["payload"] for r in landed.collect()) == sorted(lines)
    assert sorted(r["raw_row"] for r in feeds.feed_errors(landed).collect()) == sorted(lines[1:])
    with pytest.raises(ValueError):
        feeds.read_csv_feed(spark, str(tmp_path / "a.csv"), "absent string", "imp1", "other")


def test_bad_payloads_are_reported_not_lost(spark):
    raw = spark.createDataFrame([(1, 1, "visbook", '{"booking_id":"A","department_id":"5","amount":1,"currency":"NOK"}'), (2, 1, "visbook", "no json"),
                                 (3, 1, "visbook", '{"booking_id":"A","department_id":"5","amount":1,"currency":"SEK"}'), (4, 1, "unknown", "{}")],
                                "id int, import_id int, pms_code string, payload string")
    links = spark.createDataFrame([("visbook", "5", 9, True), ("visbook", "6", 9, False)],
                                  "pms_code string, external_property_id string, hotel_id int, is_active boolean")
    hotels = spark.createDataFrame([(9, "NOK")], "id int, default_currency string")
    checked = pms.sync_errors(pms.pms_property_lookup(pms.normalize_payloads(raw), links), hotels, need_email=False)
    valid, errors = pms.route_sync_errors(checked)
    assert [r["id"] for r in valid.collect()] == [1]
    assert {(r["id"], r["error_code"]) for r in errors.collect()} == {(2, "MAP_MISSING"), (3, "CCY_MISMATCH"), (3, "DUP_RESV"), (4, "MAP_MISSING")}
    summary = pms.import_summary(checked).first()
    assert (summary["rows_total"], summary["rows_succeeded"], summary["rows_failed"], summary["status"]) == (4, 1, 3, "partial")
    imports = spark.createDataFrame([(1,), (7,)], "id int")
    assert {tuple(r) for r in pms.import_summary(checked, imports).collect()} == {(1, 4, 1, 3, "partial"), (7, 0, 0, 0, "completed")}
    assert {tuple(r) for r in pms.import_summary(checked, imports.where("id = 7")).collect()} == {(1, 4, 1, 3, "partial"), (7, 0, 0, 0, "completed")}


def test_rows_without_a_number_are_no_copies(spark):
    rows = spark.createDataFrame([(i, "visbook", None if i % 2 else "A", 9, "NOK", "g@example.com") for i in range(1, 7)],
                                 "id long, pms_code string, pms_reservation_no string, hotel_id int, currency string, guest_email string")
    hotels = spark.createDataFrame([(9, "NOK")], "id int, default_currency string")
    checked = pms.sync_errors(rows, hotels)
    assert set(checked.columns) == {*rows.columns, "error_codes"}
    assert {r["id"]: r["error_codes"] for r in checked.collect()} == {
        1: ["MAP_MISSING"], 2: [], 3: ["MAP_MISSING"], 4: ["DUP_RESV"], 5: ["MAP_MISSING"], 6: ["DUP_RESV"]}


def test_channel_rules_in_order(spark):
    rows = [("Booking.com", "Company direct", None, None, "ota"), (None, "Company direct", "GROUP-NEGO", None, "corporate"),
            (None, None, "Group block", "Direct", "group"), (None, None, "BAR", "Web", "direct"), (None, "Brand.com", None, None, "direct"),
            (None, None, None, None, "other"), ("", "x", "", "", "other")]
    df = spark.createDataFrame(rows, "m string, s string, r string, o string, want string")
    got = df.withColumn("got", pms.classify_channel(F.col("m"), F.col("s"), F.col("r"), F.col("o"))).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_scalars(spark):
    def one(c):
        return spark.range(1).select(c.alias("v")).first()["v"]

    lit = F.lit
    assert one(scalars.full_name(lit(None).cast("string"), lit("Berg"))) == "Berg"
    assert one(scalars.full_name(lit(" "), lit(""))) is None
    assert one(scalars.nights(lit(date(2024, 1, 5)), lit(date(2024, 1, 3)))) == 0
    assert [one(scalars.whole(lit(v).cast("decimal(5,2)"))) for v in ("2.5", "-2.5", "2.49")] == [3, -3, 2]
    assert one(scalars.excel_serial(lit(46112.5))) == datetime(2026, 3, 31, 12)
    assert one(scalars.excel_serial(lit("46112.53056"))) == datetime(2026, 3, 31, 12, 44)
    assert one(scalars.plain_ascii(lit("Søren Þórðardóttir Ångström Æbler"))) == "Soren THordardottir Angstrom AEbler"
    assert one(scalars.percent(lit(201), lit(4000))) == D("5.03") and one(scalars.percent(lit(1), lit(0))) is None
    late = lit("2024-06-01 23:30:00").cast("timestamp_ntz")
    assert one(scalars.hotel_local_date(late, lit("Europe/Oslo"))) == date(2024, 6, 2)
    assert one(scalars.hotel_local_date(late, lit("Atlantic/Reykjavik"))) == date(2024, 6, 1)
    assert one(scalars.months_before(date(2024, 2, 29), 12)) == date(2023, 2, 28)
    assert one(scalars.months_before(datetime(2024, 3, 31, 5), 1)) == datetime(2024, 2, 29, 5)


def test_quality(spark):
    rows = spark.createDataFrame([(1, "a", "X"), (2, "a", None), (3, None, "y"), (4, None, "y")], "id int, k string, email string")
    assert [tuple(r) for r in quality.check_unique(rows, ["k"]).collect()] == [("a", 2)]
    assert [tuple(r) for r in quality.check_unique(rows, ["k"], F.col("id") > 1).collect()] == []
    assert [r["id"] for r in quality.check_predicate(rows, F.col("email") == F.lower("email")).collect()] == [1]
    assert [tuple(r) for r in quality.check_fk(rows, "k", spark.createDataFrame([("b",)], "id string")).collect()] == [("k", "a", 2)]
    cleaned = quality.clean_placeholders(spark.createDataFrame([(date(1800, 1, 1), -1), (date(1990, 1, 1), None)], "d date, n int"),
                                         {"d": [date(1800, 1, 1)], "n": [-1]})
    assert [tuple(r) for r in cleaned.collect()] == [(None, None), (date(1990, 1, 1), None)]


def test_model(spark, frames):
    assert len(schemas.TABLES) == 40
    assert schemas.references_of("bookings") == [("chain_group_id", "chain_groups", "id"), ("hotel_id", "hotels", "id"), ("member_id", "members", "id"),
                                                 ("pms_code", "pms_systems", "code"), ("currency", "currencies", "code")]
    words = {r["column_name"]: r for r in schemas.data_dictionary(spark, ["point_transactions"], "bigint").collect()}
    assert (words["member_id"]["data_type"], words["member_id"]["foreign_table"], words["id"]["is_primary_key"]) == ("bigint", "members", True)
    assert words["expires_at"]["is_nullable"] and words["expires_at"]["column_description"]
    assert words["status"]["column_default"] == "posted"
    assert schemas.data_dictionary(spark).select("table_name").distinct().count() == 40
    assert all(schemas.schema_of(t) for t in schemas.TABLES)
    broken = quality.check_model("bookings", {"bookings": frames.bookings, "hotels": frames.hotels, "members": frames.members,
                                              "chain_groups": frames.chain_groups})
    assert {(r["rule"], r["offending_rows"]) for r in broken.collect()} == {("not checked: reference: pms_code", None), ("not checked: reference: currency", None)}
    wrong = frames.bookings.withColumn("status", F.when(F.col("id") == 3, "lost").otherwise(F.col("status")))
    found = [tuple(r)[1:] for r in quality.check_model("bookings", {"bookings": wrong.drop("chain_group_id")}).collect()]
    assert [r for r in found if r[1] is not None] == [("values: status", 1)]
    assert {("not checked: not null: chain_group_id", None), ("not checked: reference: hotel_id", None)} <= set(found)


def test_rows_take_the_shape_of_their_table(spark):
    rows = spark.createDataFrame([("1", "2", "5", "2024-01-05", "2024-01-03", "12.345"), ("2", "2", "x", "soon", "2024-01-09", None)],
                                 "id string, chain_group_id string, hotel_id string, arrival_date string, departure_date string, total_amount string")
    shaped = schemas.conform(rows, "bookings", "bigint")
    assert shaped.columns == schemas.schema_of("bookings").fieldNames()
    first, second = shaped.orderBy("id").collect()
    assert (first["nights"], first["status"], first["channel"], first["total_amount"]) == (0, "upcoming", "other", D("12.35"))
    assert (second["hotel_id"], second["arrival_date"], second["is_member_booking"]) == (None, None, False)
    found = {r["rule"] for r in quality.check_model("bookings", {"bookings": shaped}).collect()}
    assert {"not null: hotel_id", "not null: arrival_date", "check: departure_date >= arrival_date"} <= found
    people = schemas.conform(spark.createDataFrame([(1, " ", "Berg")], "id int, first_name string, last_name string"), "members", "bigint")
    assert people.first()["full_name"] == "Berg"


def test_search(spark):
    rows = spark.createDataFrame([(1, "a", "Anna-Lise", "Berg", "Anna@X.no", None, "M-7", "Oslo", "Anna-Lise Berg"), (2, "a", "Bo", None, None, "+47123", None, "Annaberg", "Bo")],
                                 "id int, chain_group_id string, first_name string, last_name string, email string, phone_e164 string, "
                                 "member_number string, city string, full_name string")
    terms = search.member_search_terms(rows)
    got = {(r["lexeme"], r["weight"]) for r in terms.where("member_id = 1").collect()}
    assert got == {("anna-lise", "A"), ("anna", "A"), ("lise", "A"), ("berg", "A"), ("anna@x.no", "B"), ("m", "B"), ("7", "B"), ("oslo", "C")}
    assert [(r["member_id"], r["score"]) for r in search.member_search(terms, "Berg oslo").collect()] == [(1, 1.2)]
    assert search.member_search(terms, "berg bo").count() == 0
    # Word "cat" has the pieces "  c", " ca", "cat", "at "; "cats" shares three of six.
    near = search.fuzzy_members(rows.withColumn("full_name", F.lit("cat")).where("id = 2"), "cats", 0.1).first()
    assert near["similarity"] == pytest.approx(3 / 6)


def test_tier_history_chain(frames):
    rows = tiers.tier_history(frames.members, frames.tiers)
    first = rows.where("change_reason = 'initial_assignment'")
    assert first.count() == frames.members.where("current_tier_id IS NOT NULL").count()
    assert first.where("from_tier_id IS NOT NULL").count() == 0
    assert rows.where("change_reason <> 'initial_assignment' AND to_tier_id <> from_tier_id + 1").count() == 0


def array_file(spark, folder, text, block=None):
    folder.mkdir()
    (folder / "a.json").write_text(text)
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        rows = feeds.read_json_array(spark, str(folder), "id int, note string", "i", "other", "id").collect()
    finally:
        for c in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{c}")
    return [r.payload for r in rows if r.raw_row is None], [r.raw_row for r in rows if r.raw_row is not None]


@pytest.mark.parametrize("block", [None, 997])
def test_json_array_over_several_tasks(spark, tmp_path, block):
    import random
    pick = random.Random(1)
    notes = ["{", "}", '"', "\\", "}{", "[],", '\\"}', "a\nb", "", 'x{"y', "é}"]
    objects = [{"id": i, "note": "".join(pick.choices(notes, k=pick.randrange(5))), "more": {"list": [{"k": pick.choice(notes)}, {}], "deep": {"e": {}}}} for i in range(300)]
    text = json.dumps(objects, indent=pick.choice([None, 1]), ensure_ascii=False)
    good, bad = array_file(spark, tmp_path / "x", text, block)
    assert sorted(map(json.dumps, map(json.loads, good))) == sorted(map(json.dumps, objects)) and bad == []


def test_json_array_with_broken_objects(spark, tmp_path):
    good, bad = array_file(spark, tmp_path / "a", '[{"id": 1}, {"id": , "x": {"y": 2}}, {"id": 3, "note": "a"}]')
    assert sorted(json.loads(x)["id"] for x in good) == [1, 3] and bad == ['{"id": , "x": {"y": 2}}']
    good, bad = array_file(spark, tmp_path / "b", '[{"id": 1}}, {"id": 2, "x": {"y": {}}}, {"id": 3}]', 7)
    assert sorted(json.loads(x)["id"] for x in good) == [1, 2, 3] and bad == ["}"]
    good, bad = array_file(spark, tmp_path / "c", '[{"id": 1}, {"id": 2, "x": {"y": 2}')
    assert good == ['{"id": 1}'] and bad == ['{"id": 2, "x": {"y": 2}']
    assert array_file(spark, tmp_path / "d", "no array") == ([], ["no array"])
    assert array_file(spark, tmp_path / "e", "[]\n") == ([], []) and array_file(spark, tmp_path / "f", "") == ([], [])


def test_json_array_in_short_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "_STRETCH", 3)
    objects = [{"id": i, "note": '}{"' * (i % 4), "more": [{"k": {}}] * (i % 5)} for i in range(60)]
    good, bad = array_file(spark, tmp_path / "x", json.dumps(objects), 700)
    assert sorted(map(json.dumps, map(json.loads, good))) == sorted(map(json.dumps, objects)) and bad == []
    # In one block, what the lost brace takes along is one bad row however many stretches it covers.
    text = '[{"id": 1}, ' + '{"id": 2, ' + ", ".join('"a%d": {"b": {}}' % i for i in range(20)) + "]"
    good, bad = array_file(spark, tmp_path / "y", text)
    assert good == ['{"id": 1}'] and len(bad) == 1 and bad[0].count("{}") == 20


def test_json_array_query_writes_by_several_tasks(spark, frames, tmp_path, monkeypatch):
    from types import SimpleNamespace
    from stayledger.plans import platform
    path = tmp_path / "array"
    monkeypatch.setattr(platform, "fresh_path", lambda spark, name: str(path))
    got = platform.json_array_feed(SimpleNamespace(spark=spark, bookings=frames.bookings.repartition(3)))
    assert sum(r.reservations for r in got.collect()) == frames.bookings.count() and len(list(path.glob("part-*"))) == 3


def test_streams_resume_without_repeating(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id int, payload string, ingested_at timestamp_ntz"
    at = datetime(2024, 1, 1)
    spark.createDataFrame([(1, "a", at), (2, "a", at), (3, "b", at)], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = streams.file_stream(spark, source, spark.read.parquet(source).schema)
        return sorted(r["payload"] for r in streams.dedupe_stream(stream, spark, out).collect())

    assert run() == ["a", "b"]
    spark.createDataFrame([(4, "b", at), (5, "c", at)], schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]


def test_running_balance_over_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "member_id int, status string, points_delta bigint, occurred_at timestamp_ntz"
    at = datetime(2024, 1, 1)
    for batch in ([(1, "posted", 5, at), (2, "pending", 1, at)], [(1, "posted", -2, at)], [(1, "reversed", 9, at), (1, "posted", 4, at)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        got = streams.balance_stream(streams.file_stream(spark, source), spark, out)
    assert {r["member_id"]: (r["balance_posted"], r["balance_pending"]) for r in got.collect()} == {1: (7, 0), 2: (0, 1)}


def test_work_folder_is_the_one_the_session_names(spark):
    from stayledger.session import fresh_path, work_folder
    assert work_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
