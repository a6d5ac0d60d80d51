"""Stored tables under merge, refreshed balances, rule bitmaps, the use of points, change capture and the search indexes."""

import os
import random
import time
from collections import Counter
from datetime import date, datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from stayledger.operators import audit, ledger, refresh, rules, search, search_index
from stayledger.operators.access import Principal
from stayledger.sources import merge
from stayledger.streaming import changes, streams

# --- merge ---------------------------------------------------------------------------------------------------------

ROW = "id long, city string, n int"


def stored(spark, path):
    return sorted(tuple(r) for r in merge.read(spark, path).collect())


def names(spark, path):
    return {os.path.basename(r.file) for r in merge.files(spark, path).collect()}


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    merge.create(spark.createDataFrame([(i, f"c{i}", i) for i in range(0, 1000, 2)], ROW), path, ["id"], file_rows=50)
    return path


def test_merge_leaves_untouched_files(spark, table):
    before = names(spark, table)
    assert len(before) >= 10
    done = merge.merge(spark.createDataFrame([(100, "new", 1), (101, "added", 2)], ROW), table, ["id"], file_rows=50)
    after = names(spark, table)
    assert done.rewritten == 1 and done.kept == len(before) - 1 and len(before & after) == len(before) - 1
    want = {i: (i, f"c{i}", i) for i in range(0, 1000, 2)} | {100: (100, "new", 1), 101: (101, "added", 2)}
    assert stored(spark, table) == sorted(want.values())
    gone = {os.path.basename(r.file) for r in merge.unreferenced(spark, table).collect()}
    assert gone == before - after


def test_a_reader_keeps_its_version(spark, table):
    old = merge.read(spark, table)
    merge.merge(spark.createDataFrame([(2,)], "id long"), table, ["id"], delete=F.lit(True))
    assert old.count() == 500 and merge.read(spark, table).count() == 499


def test_merge_against_plain(spark, tmp_path):
    """Random updates, insertions and deletions, several source rows per key, nulls in the key."""
    pick = random.Random(3)
    path = str(tmp_path / "t")
    want = {(i, "a"): (i, "a", 0, "x") for i in range(200)}
    schema = "id long, part string, n int, kept string"
    merge.create(spark.createDataFrame(list(want.values()), schema), path, ["id", "part"], file_rows=20)
    loose = []
    for step in range(4):
        rows = [(pick.choice([None, *range(step * 60, step * 60 + 90)]), pick.choice("ab"), pick.randrange(100), pick.random() < 0.2) for _ in range(80)]
        merge.merge(spark.createDataFrame(rows, "id long, part string, n int, gone boolean"), path, ["id", "part"], update=["n"], delete=F.col("gone"), file_rows=20)
        best = {}
        for i, part, n, gone in rows:
            if i is None:
                loose += [] if gone else [(None, part, n, None)]
            elif (i, part) not in best or (n, gone) < best[i, part]:
                best[i, part] = (n, gone)
        for key, (n, gone) in best.items():
            if gone:
                want.pop(key, None)
            else:
                want[key] = (*key, n, want[key][3] if key in want else None)
    assert Counter(map(tuple, merge.read(spark, path).collect())) == Counter([*want.values(), *loose])


def test_insert_only_update_only_and_empty(spark, table):
    rows = spark.createDataFrame([(4, "x", 9), (5, "y", 9)], ROW)
    merge.merge(rows, table, ["id"], update=[])
    got = dict((r[0], r) for r in stored(spark, table))
    assert got[4] == (4, "c4", 4) and got[5] == (5, "y", 9)
    merge.merge(rows.withColumn("id", F.col("id") + 2), table, ["id"], insert=False)
    got = dict((r[0], r) for r in stored(spark, table))
    assert got[6] == (6, "x", 9) and 7 not in got
    before = merge.files(spark, table).count()
    merge.merge(rows.where("false"), table, ["id"])
    assert merge.files(spark, table).count() == before
    merge.merge(merge.read(spark, table), table, ["id"], delete=F.lit(True))
    assert stored(spark, table) == []
    assert merge.upsert(rows, table, ["id"]).written == 1 and len(stored(spark, table)) == 2


def test_a_second_writer_of_a_version_fails(spark, table):
    version = 1
    merge._commit(merge.files(spark, table), table, version)
    with pytest.raises(Exception, match="(?i)exists"):
        merge._commit(merge.files(spark, table), table, version)


# --- running balances ----------------------------------------------------------------------------------------------

def test_running_balance_keeps_one_row_per_member(spark, tmp_path):
    pick = random.Random(1)
    schema = "member_id long, status string, points_delta long, occurred_at timestamp_ntz"
    rows = [(pick.randrange(40), pick.choice(["posted", "pending"]), pick.randrange(-5, 9), datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(240)]
    for i in range(20):
        spark.createDataFrame(rows[12 * i:12 * i + 12], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    source = streams.file_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    got = {r.member_id: (r.balance_posted, r.balance_pending, r.last_activity_at) for r in streams.balance_stream(source, spark, out, compact_every=9).collect()}
    want = {}
    for m, status, points, at in rows:
        a, b, last = want.get(m, (0, 0, at))
        want[m] = (a + points * (status == "posted"), b + points * (status == "pending"), max(last, at))
    assert got == want
    assert merge.read(spark, f"{out}/current").count() == len(want)
    assert len([d for d in os.listdir(f"{out}/changes") if d.startswith("batch=")]) >= 20


def test_balances_between_merges(spark, tmp_path):
    """Changes that are not merged yet count; a batch that is repeated after its merge does not."""
    path, schema = str(tmp_path), "member_id long, balance_posted long, balance_pending long, last_activity_at timestamp_ntz"

    def batch(number, *rows):
        spark.createDataFrame([(m, n, 0, None) for m, n in rows], schema).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    def now():
        return {r.member_id: r.balance_posted for r in streams.current_balances(spark, path).collect()}

    batch(0, (1, 10), (2, 20))
    assert now() == {1: 10, 2: 20}
    streams.compact_balances(spark, path)
    batch(1, (2, 25), (3, 30))
    assert now() == {1: 10, 2: 25, 3: 30}
    batch(2, (2, 27))
    streams.compact_balances(spark, path)
    batch(1, (2, 25), (3, 30))
    streams.compact_balances(spark, path)
    assert now() == {1: 10, 2: 27, 3: 30}


# --- refreshed balances --------------------------------------------------------------------------------------------

LEDGER = ("id long, chain_group_id long, program_id long, member_id long, type string, status string, points_delta long, "
          "occurred_at timestamp_ntz, expires_at timestamp_ntz")


def random_ledger(seed, n, members=12, start=date(2024, 1, 1)):
    pick, out = random.Random(seed), []
    for i in range(n):
        at = datetime(start.year, start.month, start.day) + timedelta(days=pick.randrange(60), hours=pick.randrange(24))
        kind = pick.choice(["earn_release"] * 3 + ["redeem"] * 2 + ["earn_pending"])
        points = pick.randrange(1, 50) * (-1 if kind == "redeem" else 1)
        lapse = at + timedelta(days=pick.randrange(20, 90)) if kind == "earn_release" and pick.random() < 0.8 else None
        out.append((i, 1, 1, pick.randrange(members), kind, "pending" if kind == "earn_pending" else "posted", points, at, lapse))
    return out


def test_refresh_reads_new_loads_only(spark, tmp_path):
    folder, path = str(tmp_path / "balances"), str(tmp_path / "ledger")
    members = spark.createDataFrame([(i, 1, 1) for i in range(14)], "id long, chain_group_id long, program_id long")
    rows = random_ledger(5, 300)
    days = [date(2024, 1, 10), date(2024, 1, 10), date(2024, 2, 20), date(2024, 6, 1)]
    for load, day in enumerate(days):
        part = rows[100 * load:100 * load + 100]
        if part:
            refresh.append_load(spark.createDataFrame(part, LEDGER), path, load)
        refresh.refresh(spark, folder, path, day)
        got = {tuple(r) for r in refresh.refreshed_balances(members, folder).select("member_id", *refresh.VALUES, "last_activity_at").collect()}
        whole = spark.createDataFrame(rows[:100 * load + 100], LEDGER)
        want = ledger.points_balances(members, whole, day)
        assert got == {tuple(r) for r in want.select("member_id", *refresh.VALUES, "last_activity_at").collect()}
        if part:  # What has been read once is not read again: rows put in its place later change nothing.
            refresh.append_load(spark.createDataFrame([(0, 1, 1, 0, "redeem", "posted", -10**6, datetime(2024, 1, 1), None)], LEDGER), path, load)
    with pytest.raises(ValueError, match="go back"):
        refresh.refresh(spark, folder, path, date(2024, 1, 1))


def test_refresh_after_a_crash(spark, tmp_path, monkeypatch):
    folder, path = str(tmp_path / "balances"), str(tmp_path / "ledger")
    rows = random_ledger(6, 200)
    refresh.append_load(spark.createDataFrame(rows[:100], LEDGER), path, 0)
    refresh.refresh(spark, folder, path, date(2024, 1, 5))
    refresh.append_load(spark.createDataFrame(rows[100:], LEDGER), path, 1)
    real = refresh._apply

    def then_fail(*a):
        real(*a)
        raise RuntimeError("lost")

    monkeypatch.setattr(refresh, "_apply", then_fail)
    with pytest.raises(RuntimeError):
        refresh.refresh(spark, folder, path, date(2024, 2, 1))
    monkeypatch.setattr(refresh, "_apply", real)
    refresh.refresh(spark, folder, path, date(2024, 2, 1))
    want = ledger.balance_by_member(spark.createDataFrame(rows, LEDGER), date(2024, 2, 1))
    got = merge.read(spark, f"{folder}/balances").select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


# --- rules ---------------------------------------------------------------------------------------------------------

RULE = ("id long, program_id long, hotel_id long, channel string, market_segment_code string, rate_group_code string, "
        "percent_of_payment decimal(5,2), tier_multiplier_override map<string,decimal(8,4)>, priority int, valid_from date, valid_to date, is_active boolean")
BOOKING = "id long, program_id long, hotel_id long, channel string, market_segment_code string, rate_group_code string, arrival_date date"


def random_rules(pick, n):
    def maybe(values, share):
        return pick.choice(values) if pick.random() < share else None
    out = []
    for i in range(n):
        since = date(2023, 1, 1) + timedelta(days=pick.randrange(500))
        out.append((i, pick.randrange(2), maybe(range(20), 0.8), maybe(["ota", "direct", "group"], 0.6), maybe(["CGN", "WEB", "any", "other", "none"], 0.6),
                    maybe(["BAR", "NEGO"], 0.4), D(pick.randrange(100)), None, pick.randrange(5), since,
                    since + timedelta(days=pick.randrange(400)) if pick.random() < 0.5 else None, pick.random() < 0.9))
    return out


def random_bookings(pick, n):
    return [(i, pick.choice([0, 1, 2, None]), pick.choice([*range(25), None]), pick.choice(["ota", "direct", "walk_in", None]),
             pick.choice(["CGN", "WEB", "none", "other", "new", None]), pick.choice(["BAR", "X", None]), date(2023, 6, 1) + timedelta(days=pick.randrange(400)))
            for i in range(n)]


@pytest.mark.parametrize("n", [1, 40, 700])
def test_bitmaps_against_plain(spark, n):
    pick = random.Random(n)
    rule_rows, bookings = random_rules(pick, n), random_bookings(pick, 400)
    found = rules.resolve_points_rule(spark.createDataFrame(bookings, BOOKING), spark.createDataFrame(rule_rows, RULE), indexed=True)
    got = {r.id: r.rule_id for r in found.collect()}
    for b in bookings:
        fits = [r for r in rule_rows if r[11] and r[1] == b[1] and r[9] <= b[6] and (r[10] is None or b[6] <= r[10])
                and all(r[k] is None or r[k] == b[k] for k in (2, 3, 4, 5))]
        best = min(fits, key=lambda r: (r[2] is None, r[4] is None, -r[8], r[0]), default=None)
        assert got[b[0]] == (best and best[0])


def test_ten_thousand_rules_cost_about_as_much_as_ten(spark):
    pick = random.Random(0)
    bookings = spark.createDataFrame(random_bookings(pick, 2000), BOOKING)
    many = bookings.crossJoin(spark.range(50)).drop("id").withColumn("id", F.monotonically_increasing_id()).withColumn("program_id", F.lit(1)).cache()
    many.count()

    def seconds(n):
        rows = [(*r[:1], 1, *r[2:]) for r in random_rules(random.Random(n), n)]
        table = spark.createDataFrame(rows, RULE).cache()
        table.count()
        found = []
        for _ in range(2):
            started = time.perf_counter()
            rules.resolve_points_rule(many, table, indexed=True).write.format("noop").mode("overwrite").save()
            found.append(time.perf_counter() - started)
        return min(found)

    assert seconds(10_000) < 6 * seconds(10) + 2


# --- use of points -------------------------------------------------------------------------------------------------

def consumption(frame):
    return Counter({(r.member_id, r.credit_id, r.debit_id, r.kind): r.points for r in frame.collect()})


def plain_consumption(rows, lapses, now):
    """Points as a queue, one at a time."""
    out = Counter()
    for member in {r[3] for r in rows}:
        mine = [r for r in rows if r[3] == member and r[5] == "posted" and r[6] != 0 and r[7] <= now]
        never = datetime(9000, 1, 1)
        queue = [r[0] for r in sorted((r for r in mine if r[6] > 0), key=lambda r: (r[8] or never, r[7] if r[8] is None else never, r[0])) for _ in range(r[6])]
        debits = [(r[7], 1, r[0], "redeem", -r[6]) for r in mine if r[6] < 0]
        debits += [(x.occurred_at, 0, x.credit_id, "expire", -x.points_delta) for x in lapses if x.member_id == member]
        at = 0
        for _, _, i, kind, points in sorted(debits):
            for _ in range(points):
                out[member, queue[at] if at < len(queue) else None, i, kind] += 1
                at += 1
        for c in queue[at:]:
            out[member, c, None, "open"] += 1
    return out


@pytest.mark.parametrize("stretch", [20_000, 3])
def test_consumption_against_plain(spark, monkeypatch, stretch):
    monkeypatch.setattr(ledger, "STRETCH_ROWS", stretch)
    rows = random_ledger(9, 250, members=5)
    frame, now = spark.createDataFrame(rows, LEDGER), datetime(2024, 3, 10)
    lapses = ledger.expire_points(frame, now).collect()
    got = consumption(ledger.points_consumption(frame, now))
    assert got == plain_consumption(rows, lapses, now)
    assert all(credit == debit for (_, credit, debit, kind) in got if kind == "expire")
    spent = Counter()
    for (member, _, _, kind), points in got.items():
        spent[member] += points if kind == "redeem" else 0
    assert spent == Counter({m: -sum(r[6] for r in rows if r[3] == m and r[6] < 0 and r[7] <= now) for m in spent})


def test_consumption_beyond_credits_and_empty(spark):
    rows = [(1, 1, 1, 7, "earn_release", "posted", 10, datetime(2024, 1, 1), None), (2, 1, 1, 7, "redeem", "posted", -25, datetime(2024, 1, 2), None)]
    frame = spark.createDataFrame(rows, LEDGER)
    assert consumption(ledger.points_consumption(frame, date(2024, 2, 1))) == Counter({(7, 1, 2, "redeem"): 10, (7, None, 2, "redeem"): 15})
    assert ledger.points_consumption(frame.where("false"), date(2024, 2, 1)).count() == 0


# --- change capture ------------------------------------------------------------------------------------------------

IMAGE = "id long, chain_group_id long, status string, tags array<string>, note string"


def test_capture_equals_summed_diffs(spark, tmp_path):
    pick, path, actor = random.Random(2), str(tmp_path), Principal("chain_admin", 1, sub=None)

    def row(i):
        return (i, i % 3, pick.choice("abc"), pick.choice([None, [], ["x"], [None]]), pick.choice([None, "", "null"]))

    state, snapshots = {i: row(i) for i in range(60)}, []
    for step in range(4):
        snapshots.append(spark.createDataFrame(list(state.values()), IMAGE))
        if step != 2:  # The fourth snapshot equals the third.
            for i in pick.sample(range(90), 25):
                if i in state and pick.random() < 0.4:
                    del state[i]
                else:
                    state[i] = row(i)
    for number, rows in enumerate(snapshots):
        changes.capture(rows, path, number, "bookings", actor)
    log = changes.change_log(spark, path)
    columns = [c for c in log.columns if c != "snapshot"]
    want = Counter()
    for number in range(1, 4):
        diff = audit.audit_diff(snapshots[number - 1], snapshots[number], "bookings", actor)
        assert "void" not in dict(diff.dtypes).values()
        want += Counter((number, *r) for r in diff.select(*columns).collect())
    assert Counter((r.snapshot, *[r[c] for c in columns]) for r in log.collect()) == want and len(want) > 30
    # Captured again, as after a failure, a snapshot adds nothing.
    changes.capture(snapshots[-1], path, 3, "bookings", actor)
    assert changes.change_log(spark, path).count() == sum(want.values())


def test_capture_logs_only_audited_changes(spark, tmp_path):
    path, actor = str(tmp_path), Principal("chain_admin", 1, sub="u")
    first = spark.createDataFrame([(1, 2, "a", None, None)], IMAGE)
    changes.capture(first, path, 0, "member_tier_history", actor, log_first=True)
    second = spark.createDataFrame([(1, 2, "b", None, None), (2, 2, "c", None, None)], IMAGE)
    changes.capture(second, path, 1, "member_tier_history", actor)
    assert {(r.snapshot, r.action, r.record_id) for r in changes.change_log(spark, path).collect()} == {(0, "insert", 1), (1, "insert", 2)}


# --- search indexes ------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def people(frames):
    return frames.members.limit(0).unionByName(frames.members).join(frames.named_members.select("id", "full_name"), "id").cache()


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_word_index_finds_what_a_scan_finds(spark, people, tmp_path):
    path = str(tmp_path / "words")
    search_index.build_word_index(people, path, file_rows=60)
    terms = search.member_search_terms(people)
    for query in ("hansen", "anna hansen", "Carl Erik", "guest7@example.com", "nobody"):
        assert rows_of(search_index.indexed_search(spark, path, query)) == rows_of(search.member_search(terms, query))
    every = merge.files(spark, path).count()
    opened = {f for f in search_index.indexed_search(spark, path, "strand").inputFiles()}
    holding = {r.file for r in merge.files(spark, path).where("low <= 'strand' AND high >= 'strand'").collect()}
    assert {os.path.basename(f) for f in opened} == {os.path.basename(f) for f in holding} and 0 < len(opened) < every / 3
    got = {r.member_id for r in search_index.prefix_search(spark, path, "ann han").collect()}
    assert got == {r.id for r in people.where("first_name = 'Anna' AND last_name = 'Hansen'").collect()}


def test_word_index_follows_changes(spark, people, tmp_path):
    path = str(tmp_path / "words")
    search_index.build_word_index(people, path, file_rows=60)
    before = people.where("id IN (3, 4, 5)")
    after = before.where("id <> 4").withColumn("last_name", F.lit("Zetterlund"))
    files = names(spark, path)
    search_index.update_word_index(before, after, path, file_rows=60)
    now = people.where("id NOT IN (3, 4, 5)").unionByName(after)
    assert rows_of(merge.read(spark, path)) == rows_of(search.member_search_terms(now).select("lexeme", "member_id", "chain_group_id", "weight"))
    assert {r.member_id for r in search_index.indexed_search(spark, path, "zetterlund").collect()} == {3, 5}
    assert names(spark, path) & files


def test_gram_index_finds_what_a_scan_finds(spark, people, tmp_path):
    path = str(tmp_path / "grams")
    search_index.build_gram_index(people, path, file_rows=200)
    for query, least in (("hanson", 0.3), ("Anna Hansen", 0.5), ("guest12@exampel.com", 0.6), ("anna hansen", 1.0), ("zzz", 0.2)):
        assert rows_of(search_index.indexed_fuzzy(people, path, query, least)) == rows_of(search.fuzzy_members(people, query, least))
    changed = people.where("id = 7").withColumn("full_name", F.lit("Quentin Quist"))
    search_index.update_gram_index(people.where("id = 7"), changed, path, file_rows=200)
    now = people.where("id <> 7").unionByName(changed)
    assert rows_of(search_index.indexed_fuzzy(now, path, "quentin quist", 0.4)) == rows_of(search.fuzzy_members(now, "quentin quist", 0.4))


def test_postings_are_formed_and_merged_in_parts_by_rows(spark, people, tmp_path, monkeypatch):
    from stayledger.functions import sizing
    assert [sizing.tasks(spark, n, 100, 10) for n in (0, 9, 25, 800, 801, 5000)] == [1, 1, 2, 8, 9, 50]
    monkeypatch.setattr(search_index, "TASK_MEMBERS", 20)
    monkeypatch.setattr(search_index, "LEAST_MEMBERS", 20)
    one = people.coalesce(1)
    held = search_index._pieces(one).groupBy(F.spark_partition_id()).agg(F.countDistinct("member_id").alias("n")).collect()
    assert len(held) > one.count() / 40 and max(r.n for r in held) < 45
    # A piece that all members have is one key of those that files are chosen by.
    seen = []
    touched = merge._touched
    monkeypatch.setattr(merge, "_touched", lambda manifest, keys: seen.append(keys.groupBy("key").count().agg(F.max("count")).first()[0]) or touched(manifest, keys))
    path = str(tmp_path / "grams")
    search_index.build_gram_index(one, path, file_rows=200)
    search_index.update_gram_index(one, one.withColumn("full_name", F.lit("Quentin Quist")), path, file_rows=200)
    now = one.withColumn("full_name", F.lit("Quentin Quist"))
    assert seen == [1] and rows_of(merge.read(spark, path)) == rows_of(search_index._pieces(now).select(*merge.read(spark, path).columns))


def test_ends_of_files_with_null_keys(spark, tmp_path):
    rows = [(None, 1), (None, 2), ("å", 3), ("b", 4), ("b", 5), ("c", 6), (None, 7)]
    path = str(tmp_path / "t")
    merge.create(spark.createDataFrame(rows, "k string, v int"), path, ["k", "v"], file_rows=2)
    # Sorted: three nulls, then b, b, c, å, cut into files of two.
    got = {(r.low, r.high, r.rows) for r in merge.files(spark, path).collect()}
    assert got == {(None, None, 2), ("b", "b", 2), ("b", "c", 2), ("å", "å", 1)}


@pytest.mark.parametrize("least", [0.4, 0.6])
def test_fuzzy_pairs_against_plain(spark, least):
    pick = random.Random(4)
    texts = ["".join(pick.choices("abn", k=pick.randrange(1, 4))) + " " + pick.choice(["hansen", "hanson", "hansson", "olsen", "olson"]) for _ in range(120)]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",), (texts[0],)], "full_name string")

    def grams(t):
        return {f"  {w} "[i:i + 3] for w in t.split() for i in range(len(w) + 1)}

    want = {(a, b, round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 6)) for a in set(texts) for b in set(texts)
            if a < b and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= least}
    assert {tuple(r) for r in search_index.fuzzy_pairs(frame, min_sim=least).collect()} == want and want
