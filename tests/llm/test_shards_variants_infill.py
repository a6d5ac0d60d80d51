"""Histogram sort, spelling variants and fill-in-middle against plain versions, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stayledger.llm import histogram_sort, infill, letter_trie, queries

# --- sharding ------------------------------------------------------------------------------------------------------


def shards_of(frame):
    found = defaultdict(list)
    for r in frame.select("_shard", "_slot", "_size", "_row.doc_id").collect():
        found[r._shard].append((r._slot, r._size, r.doc_id))
    for rows in found.values():
        assert sorted(s for s, *_ in rows) == list(range(len(rows)))
    return found


def check_sizes(found, shards, slack):
    sizes = [sum(n for _, n, _ in found.get(s, ())) for s in range(shards)]
    largest = max((n for rows in found.values() for _, n, _ in rows), default=0)
    mean = sum(sizes) / shards
    # Each border is off by the slack or by half a row.
    assert all(abs(x - mean) <= 2 * slack * mean + largest + 1 for x in sizes), sizes


def test_shards_of_all_documents(spark, small_folder):
    docs = spark.read.parquet(f"{small_folder}/documents.parquet")
    found = shards_of(histogram_sort.sharded(docs))
    assert Counter(i for rows in found.values() for *_, i in rows) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    check_sizes(found, 16, histogram_sort.TOLERANCE)
    rows = queries.op11_histogram_sort(spark, small_folder).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert {(r.shard, r.slot) for r in rows} == {(s, slot) for s, x in found.items() for slot, *_ in x}


def test_shards_in_several_pieces(spark, small_folder):
    """Shards of many pieces have the same borders up to the slack, and slots without gaps."""
    docs = spark.read.parquet(f"{small_folder}/documents.parquet")
    found = shards_of(histogram_sort.sharded(docs, shards=3, piece_bytes=10_000))
    check_sizes(found, 3, histogram_sort.TOLERANCE)
    assert sum(map(len, found.values())) == docs.count()


def test_shards_of_one_hot_row(spark):
    """A third of the rows are equal in all columns, another third share their text: shards still are near equal."""
    rows = [(7, "same text")] * 1000 + [(i, "shared text") for i in range(1000)] + [(5000 + i, f"text {i}") for i in range(1000)]
    found = shards_of(histogram_sort.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    check_sizes(found, 16, 0.02)
    assert sum(map(len, found.values())) == 3000


def test_small_groups_stay_together(spark):
    rows = [(10 * i + j, f"text number {i}") for i in range(4000) for j in range(2)]
    found = histogram_sort.sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=4, tolerance=0.02)
    cut = found.groupBy("_row.text").agg(F.count_distinct("_shard").alias("n")).where("n > 1").count()
    assert cut == 0


def test_shard_edge_rows(spark):
    schema = "doc_id long, text string, _row string, _shard int, `a.b` int"
    rows = [(None, None, None, None, 1), (None, None, None, None, 1), (1, "", "x", 3, None), (2, "é" * 50_000, "y", 4, 2)]
    found = histogram_sort.sharded(spark.createDataFrame(rows, schema), shards=2)
    got = Counter((r._row.doc_id, r._row.text, r._row._shard, r._row["a.b"], r._size) for r in found.collect())
    assert got == Counter((i, t, s, b, len((t or "").encode()) + 1) for i, t, _, s, b in rows)
    empty = histogram_sort.sharded(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns == ["_row", "_size", "_shard", "_slot"]


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i}", "a") for i in range(100)]
    histogram_sort.write_shards(spark.createDataFrame(rows, "doc_id long, text string, _slot string"), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {"doc_id", "text", "_row_slot", "_slot", "_shard"} and back.count() == 100


@given(st.lists(st.tuples(st.integers(0, 2**63 - 1), st.integers(1, 50)), min_size=1, max_size=60), st.integers(2, 9))
@settings(max_examples=8, deadline=None)
def test_borders(spark, rows, parts):
    """Each border is the best key there is, or within the slack."""
    keys = spark.createDataFrame(rows, "key long, size long")
    cuts = histogram_sort.borders(keys, parts, 0)
    assert cuts == sorted(cuts) and len(cuts) == parts - 1
    total = sum(s for _, s in rows)
    steps = [sum(s for k, s in rows if k < c) for c in {0, 2**63 - 1, *(k for k, _ in rows), *(min(k + 1, 2**63 - 1) for k, _ in rows)}]
    for i, c in enumerate(cuts):
        aim = total * (i + 1) // parts
        below = sum(s for k, s in rows if k < c)
        assert abs(below - aim) <= min(abs(x - aim) for x in steps) or max(k for k, _ in rows) == 2**63 - 1


# --- spelling variants ---------------------------------------------------------------------------------------------

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows, noise, least, occurrences):
    counts = Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if noise and h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= occurrences}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def plain_variants(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return out


def variants_of(frame):
    return {tuple(r) for r in frame.select("word", "n", "n_near", "form", "form_n", "root").collect()}


def noisy_rows(seed, words, docs):
    pick = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(pick.choices(words, weights, k=60))) for i in range(docs)]


WORDS = ["Überfall", "überfallen", "nationale", "nationals", "nationaal", "rational", "reasoning", "seasoning", "treason", "aaaaaaa", "aaaaaaaa",
         "listening", "enlisting", "tinseling", "elevénth", "eleventh", "eléventh"]


@pytest.mark.parametrize("limits", [{}, {"NODE_WORDS": 3}, {"NODE_WORDS": 1, "BUCKET_WORDS": 2, "DIRECT": 1}])
def test_variants_against_plain(spark, monkeypatch, limits):
    """Whole nodes, deeper levels, and nodes cut into blocks give the same rows."""
    for k, v in limits.items():
        monkeypatch.setattr(letter_trie, k, v)
    rows = noisy_rows(1, WORDS, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_variants(plain_words(rows, 3, 7, 2))
    assert any(f for _, _, _, f, _, _ in want)
    assert variants_of(letter_trie.variants(docs, noise=3)) == want


def test_one_hot_node(spark, monkeypatch):
    """Many words of the same letters lie in one leaf, whose blocks meet each other."""
    monkeypatch.setattr(letter_trie, "NODE_WORDS", 20)
    words = ["".join(x) for x in itertools.islice(itertools.permutations("abcdefgh"), 0, 40_000, 320)]
    words += [w[:3] + "x" + w[4:] for w in words[:40]]
    rows = [(i, " ".join(words)) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert variants_of(letter_trie.variants(docs, noise=0)) == plain_variants(plain_words(rows, 0, 7, 2))


def test_root_chain(spark):
    counts = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000}
    rows = [(1, " ".join(f"{w} " * n for w, n in counts.items()))]
    found = letter_trie.variants(spark.createDataFrame(rows, "doc_id long, text string"), noise=0, min_count=1)
    assert {(r.word, r.root) for r in found.collect()} == {(w, "aaaabbb") for w in counts}


def test_variant_edge_rows(spark):
    """Null ids and texts, very long words, letters at the border of the range, ties, names that clash."""
    long = "ab" * 3000
    rows = [(None, None, 1), (None, "", 2), (3, "naïveté÷ naïveté÷ naïvete÷ naïvete÷", 3), (4, f"{long} {long} {long}c {long}c", 4),
            (5, "ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÿ ÀÀÀÀÀÀÿ ÀÀÀÀÀÀĀ word", 5), (None, "lettering lettering letterings letterings", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int")
    pairs = [(i, t) for i, t, _ in rows]
    assert variants_of(letter_trie.variants(docs, noise=0)) == plain_variants(plain_words(pairs, 0, 7, 2))
    assert variants_of(letter_trie.variants(docs, noise=2, min_count=1)) == plain_variants(plain_words(pairs, 2, 7, 1))
    assert variants_of(letter_trie.variants(docs.where("false"))) == set()


@given(st.lists(st.text("abeinrsé", min_size=1, max_size=9), min_size=1, max_size=60, unique=True))
@settings(max_examples=60, deadline=None)
def test_trie_finds_each_pair_once(words):
    column = letter_trie.Words(pa.chunked_array([pa.array(words)]))
    q, w = letter_trie.Trie(column).near(column)
    got = Counter(tuple(sorted((words[i], words[j]))) for i, j in zip(q.tolist(), w.tolist()))
    assert got == Counter(tuple(sorted(p)) for p in itertools.combinations(words, 2) if one_edit(*p))


# --- fill-in-middle ------------------------------------------------------------------------------------------------

UNIT = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_cut(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text, text
    spm = h4 % 100 < 80
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), "spm" if spm else "psm", len(prefix), len(middle), output, text


def cuts_of(spark, rows, schema="doc_id long, text string"):
    done = infill.restored(infill.transformed(spark.createDataFrame(rows, schema)))
    return Counter((r._row.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in done.collect())


def test_infill_against_plain(spark, monkeypatch):
    monkeypatch.setattr(infill, "WINDOW", 7)
    pieces = [" ", "\n\t", "a", "été", "日本", "<", "<P", "P>", "<M>", ">", "word", " ", "\x0b", "<S"]
    pick = random.Random(5)
    rows = [(i, "".join(pick.choices(pieces, k=pick.randrange(0, 14)))) for i in range(400)]
    rows += [(None, None), (None, "null id"), (7, None), (8, ""), (9, "   "), (9, "   "), (10, "<P> marked"), (11, " lead and trail ")]
    want = Counter((i, *plain_cut(i, t)) for i, t in rows)
    assert {"plain", "psm", "spm"} == {w[2] for w in want}
    assert cuts_of(spark, rows) == want


def test_infill_long_text_and_clashing_names(spark):
    rows = [(i, "many words é " * 150_000, "x", "y", 1) for i in range(4)] + [(5, "short text", None, None, None)]
    got = cuts_of(spark, rows, "doc_id long, text string, output string, _text string, n int")
    assert got == Counter((i, *plain_cut(i, t)) for i, t, *_ in rows)
    empty = infill.restored(infill.transformed(spark.createDataFrame([], "doc_id long, text string")))
    assert empty.count() == 0 and empty.columns[-1] == "restored"


@given(st.lists(st.text(st.sampled_from("a <PSM>é\n"), max_size=12), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_round_trip(texts):
    cut = infill.Cut(list(range(len(texts))), pa.array(texts), 42, 100, 50)
    out = cut.outputs()
    back = infill.restored_texts(out, cut.form != infill.PLAIN)
    assert back.to_pylist() == texts and cut.units.tolist() == [len(UNIT.findall(t)) for t in texts]
    assert np.array_equal(cut.form == infill.PLAIN, [not t or any(m in t for m in ("<P>", "<S>", "<M>")) for t in texts])
