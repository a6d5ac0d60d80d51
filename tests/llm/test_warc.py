"""The WARC round trip: records, segments, digests, and the files themselves."""

import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stayledger.llm import warc


def expected(rows, least=0):
    last = {}
    for i, _, html in rows:
        h = html or ""
        if i is not None and len(h.encode()) >= least:
            last[h] = max(last.get(h, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = last.get(html or "")
        revisit = i is not None and first is not None and first != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def pages():
    rnd = random.Random(3)
    tricky = ["", None, "WARC/1.1\r\nWARC-Type: response\r\n\r\nx", "a\r\n\r\n", "\r\n\r\n\r\n", "é" * 50, "<p>😀</p>" * 40, "x" * 1000]
    rows = [(i, f"http://h/{i}", rnd.choice(tricky)) for i in range(60)]
    return rows + [(100, None, "u"), (101, "", "v"), (102, "http://h/a b\r\nX: y", "w"), (None, "n", "null id"), (None, "n", "u"),
                   (103, "q", "é" * 200_000), (104, "q", "é" * 200_000), (105, "q", "y" * 300_001)]


@pytest.mark.parametrize("chunk", [64, 65536])
@pytest.mark.parametrize("least", [0, 60])
def test_round_trip(spark, tmp_path, monkeypatch, chunk, least):
    rows = pages()
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"strong": F.lit(1), "refers_to": F.lit("x")})
    folder = str(tmp_path / "w")
    warc.write(docs.repartition(3), folder, least, chunk)
    got = warc.read(spark, folder).collect()
    assert all(r.valid for r in got)
    assert sorted([tuple(r)[:5] for r in got], key=str) == expected(rows, least)
    segments = [s for f in sorted(Path(folder).glob("*.gz")) for s in warc.parse(iter([gzip.decompress(f.read_bytes())]))]
    kinds = [h["WARC-Type"] for h, _ in segments]
    assert ("continuation" in kinds) and max(len(b) for _, b in segments) <= chunk + 200
    # The segments of a record, in order, are its payload again.
    whole = {}
    for h, block in sorted(segments, key=lambda s: int(s[0].get("WARC-Segment-Number", 0))):
        key = h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"])
        whole[key] = whole.get(key, b"") + (block if h["WARC-Type"] == "continuation" else block.partition(b"\r\n\r\n")[2])
    totals = {h["WARC-Segment-Origin-ID"]: int(h["WARC-Segment-Total-Length"]) for h, _ in segments if "WARC-Segment-Total-Length" in h}
    assert {len(whole[k]) for k in totals} <= {len((r[2] or "").encode()) for r in rows}
    assert ("é" * 200_000).encode() in whole.values()


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (2, "u", "b")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(docs).collect())
    assert got == [(1, 1, "response", None), (1, 1, "response", None), (1, 1, "revisit", 2), (2, 1, "response", None)]
    assert warc.round_trip(docs.limit(0)).count() == 0


def test_damaged_archive():
    head = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\n"
    with pytest.raises(ValueError):
        list(warc.parse(iter([head.encode() + b"123"])))
    with pytest.raises(ValueError):
        list(warc.parse(iter([b"garbage without an end"])))
