"""Exact dedup and packing against plain versions and exact round trips."""

import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stayledger.llm import exact_dedup, packing
from stayledger.llm.queries import op3_packing

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def copies_rows():
    rnd = random.Random(2)
    base = ["a  b", "a b", "a\tb ", " a b", "", None, " ", "x" * 50_000, "à b"]
    return [(i * 2, rnd.choice(base)) for i in range(300)]


def colliding(text):
    return F.unhex(F.hex(F.length(text)))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, colliding])
@pytest.mark.parametrize("salts", [1, 7])
def test_exact_copies(spark, digest, salts):
    """Also with a digest that many different texts share: the whole text decides."""
    rows = copies_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    groups = defaultdict(list)
    for i, t in rows:
        groups[BLANK.sub(" ", t or "")].append(i)
    want = {i: (min(g), len(g), i == min(g)) for g in groups.values() for i in g}
    got = exact_dedup.copies(docs, digest, salts).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == want and len(got) == len(rows)
    if digest is exact_dedup.sha256:
        by_id = {i: sha256(BLANK.sub(" ", t or "").encode()).hexdigest() for i, t in rows}
        assert all(r.text_sha256 == by_id[r.doc_id] for r in got)


def test_exact_edge_rows(spark):
    rows = [(None, "t"), (None, "u"), (5, "t"), (5, "t"), (7, "t"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit(1), "salt": F.lit("x"), "_row": F.lit(2)})
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.copies(docs).collect())
    assert got == [("5", "5", 4, True), ("5", "5", 4, True), ("7", "5", 4, False), ("8", "8", 1, True),
                   ("None", "5", 4, False), ("None", "None", 1, True)]
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "5", "8", "None"]
    assert exact_dedup.copies(docs.limit(0)).count() == 0


ODD = ["a  b", "\n\n x", "  lead", "tail ", "it's 'S", "x\x1c\x1dy", "\u0085 z", "\U0001f600 né", "<|endoftext|> hi", "\r\n\t\ta",
       "日本語 テキスト", "1234 ½ Ⅷ", "", None, " ", "x" * 100_000, "\n" * 3000]


def check_pieces(rows, pieces, length, end_id=0):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            part = np.array(ids[at:at + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and getattr(r, "ids", list(part)) == list(part)
            at += r.length
        assert at == len(ids)
    total = sum(r.length for r in pieces)
    assert sorted(by_sequence) == list(range(-(-total // length)))
    for s, parts in by_sequence.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        rest = total % length
        last = s == total // length
        assert at == (rest if last else length)
        assert {r.sequence_length for r in parts} == {rest if last and rest & (rest - 1) == 0 else length}


@pytest.mark.parametrize("length", [16, 1024])
def test_packing(spark, tmp_path, length):
    rnd = random.Random(1)
    rows = [(i, " ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.randrange(120)))) for i in range(200)] + list(enumerate(ODD, 1000))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "run": F.lit("r"), "ids": F.lit(2.0)})
    check_pieces(rows, packing.pieces(docs.repartition(5), length, with_ids=True).collect(), length)
    docs.repartition(4).write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    pieces = packing.pieces(stored, length).collect()
    check_pieces(rows, pieces, length)
    # The stream follows the files: documents of one file stand together, in the order of its rows.
    order = [r.doc_id for r in stored.select("doc_id", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()]
    assert [r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0] == order
    whole = packing.sequences(stored, length).collect()
    assert sum(len(r.doc_ids) for r in whole) == len(pieces) and all(len(r.ids) in (length, len(whole[-1].ids)) for r in whole)


def test_packing_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "b c"), (1, "b c")], "doc_id long, text string")
    got = packing.pieces(docs).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("1", 3), ("1", 3), ("None", 2)]
    assert {r.sequence_length for r in got} == {8}
    assert packing.pieces(docs.limit(0)).count() == 0


def test_added_tokens(spark):
    """An added token in a text is one id, as the library gives it."""
    got = packing.pieces(spark.createDataFrame([(1, "hello <|endoftext|> world")], "doc_id long, text string"), with_ids=True).first()
    assert got.ids == [31373, 220, 50256, 995, 0]


def test_a_file_read_twice(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, f"word {i}") for i in range(40)], "doc_id long, text string").coalesce(1).write.parquet(path)
    pieces = packing.pieces(spark.read.parquet(path, path), 16).collect()
    places = [(r.sequence_id, r.offset + k) for r in pieces for k in range(r.length)]
    assert len(places) == len(set(places)) and len({r.doc_id for r in pieces}) == 40
    assert sum(r.length for r in pieces) == 2 * sum(r.length for r in packing.pieces(spark.read.parquet(path), 16).collect())


def test_other_vocabulary(spark):
    """A file that is no byte-level BPE goes through its own library."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pieces(spark.createDataFrame([(1, "Some words, here.")], "doc_id long, text string"), tokenizer=path, with_ids=True).collect()
    assert got[0].ids == tokenizer.encode("Some words, here.", add_special_tokens=False).ids + [0]


def test_whole_query(spark, small_folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_folder}/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(rows, op3_packing(spark, small_folder).collect(), 1024)
