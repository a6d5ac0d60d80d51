"""WARC archives through a chunked record table.

A page becomes rows of (record identifier, chunk number, chunk): a payload over ``CHUNK_BYTES`` is cut at character borders and
goes on as the first segment of its record and ``continuation`` segments, as the format provides, so that
no step after the page's own row holds a whole record. Digests are carried incrementally, chunk by chunk.
Of pages with equal payloads the one with the largest page_id is written as ``response`` and the others
as ``revisit``, which repeat digest and length but not the payload.

Each row is one WARC segment and the text sink ends it with the separator of the format, so the files are valid
archives on any file system, of at most ``FILE_ROWS`` segments each. Reading takes one archive at a
time, inflates it as a stream, cuts segments by Content-Length, and recomputes lengths and digests.

A null html is an empty payload, a null url leaves the target out. Rows that repeat a page_id are records of their
own; among equal payloads those with the largest id are all responses. A null page_id is written without record number.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stayledger.llm.batches import bound_batches
from stayledger.llm.tokens import slices
from stayledger.session import fresh_path
from stayledger.sources.tables import materialize

CHUNK_BYTES = 64 << 10
FILE_ROWS = 256
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"


def record_urn(page_id: int | None, copy: str = "0" * 12) -> str:
    """A record identifier that carries the page's number."""
    if page_id is None:
        return f"<urn:x-page:none:{copy}>"
    return f"<urn:x-page:{page_id}:{copy}>"


def _chunks(payload: memoryview, size: int) -> Iterator[memoryview]:
    """Pieces of at most ``size`` bytes that end at a character border."""
    start = 0
    while start < len(payload) or start == 0:
        stop = min(start + size, len(payload))
        while stop < len(payload) and payload[stop] & 0xC0 == 0x80:
            stop -= 1
        yield payload[start:stop]
        start = stop
        if not len(payload):
            return


def _base32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, occurrence, payload_bytes, payload_digest: lengths and SHA-1 of the payloads, in base32."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums, strong = [], [], []
            for value in batch.column("html"):
                payload = memoryview(value.as_buffer() or b"") if value.is_valid else memoryview(b"")
                sha1, sha2 = hashlib.sha1(), hashlib.sha256()
                for chunk in _chunks(payload, CHUNK_BYTES):
                    sha1.update(chunk)
                    sha2.update(chunk)
                sizes.append(len(payload))
                sums.append(_base32(sha1))
                strong.append(sha2.digest())
            yield pa.record_batch({"page_id": batch.column("page_id"), "payload_bytes": pa.array(sizes, pa.int64()),
                                   "payload_digest": pa.array(sums, pa.string()), "strong": pa.array(strong, pa.binary())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(
        digests, "page_id long, payload_bytes long, payload_digest string, strong binary")


def record_table(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table: page_id, chunk, segment (text of one WARC segment without its end)."""
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                ids, numbers, texts = [], [], []
                for i in range(part.num_rows):
                    get = lambda c: part.column(c)[i].as_py()  # noqa: B023, E731
                    value = part.column("html")[i]
                    payload = memoryview(value.as_buffer() or b"") if value.is_valid else memoryview(b"")
                    for number, text in enumerate(_segments(get, payload, chunk_bytes)):
                        ids.append(get("page_id"))
                        numbers.append(number)
                        texts.append(text)
                yield pa.record_batch({"page_id": pa.array(ids, pa.int64()), "chunk": pa.array(numbers, pa.int32()),
                                       "segment": pa.array(texts, pa.binary()).cast(pa.string())})

    bound_batches(pages.sparkSession)
    digests = materialize(with_digests(pages), "warc-digests")
    winners = digests.where(F.col("payload_bytes") >= min_bytes).groupBy("strong", "payload_bytes").agg(F.max("page_id").alias("winner"))
    # Payloads are equal if SHA-256 and length are.
    typed = digests.join(winners, ["strong", "payload_bytes"], "left").select(
        "page_id", "payload_digest", "strong",
        F.when(F.col("winner") != F.col("page_id"), F.col("winner")).alias("refers_to")).distinct()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.unhex(F.sha2(F.coalesce(
        F.col("html"), F.lit("")).cast("binary"), 256)).alias("strong"))
    both = F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.strong") == F.col("b.strong"))
    planned = rows.alias("a").join(typed.alias("b"), both).select("a.page_id", "url", "html", "payload_digest", "refers_to")
    return planned.mapInArrow(segments, "page_id long, chunk int, segment string")


def _segments(get, payload: memoryview, chunk_bytes: int) -> Iterator[bytes]:
    page, target, digest, first = get("page_id"), get("url"), get("payload_digest"), get("refers_to")
    urn = record_urn(page, digest[:12])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if target is not None:
        common.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in target))

    def segment(kind: str, block: bytes, *more: str) -> bytes:
        head = ["WARC/1.1", f"WARC-Type: {kind}", *common, *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + END.encode() + block

    if first is not None:
        yield segment("revisit", http, f"WARC-Record-ID: {urn}", f"WARC-Refers-To: {record_urn(first, digest[:12])}",
                      "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                      "Content-Type: application/http; msgtype=response")
        return
    total = len(http) + len(payload)
    done = 0
    for number, chunk in enumerate(_chunks(payload, chunk_bytes), 1):
        done += len(chunk)
        content = "Content-Type: application/http; msgtype=response"
        if len(payload) <= chunk_bytes:
            yield segment("response", http + bytes(chunk), f"WARC-Record-ID: {urn}", content)
        elif number == 1:
            yield segment("response", http + bytes(chunk), f"WARC-Record-ID: {urn}", "WARC-Segment-Number: 1", content)
        else:
            own = record_urn(page, f"{digest[:12]}:{number}")
            more = [f"WARC-Segment-Total-Length: {total}"] if done == len(payload) else []
            yield segment("continuation", bytes(chunk), f"WARC-Record-ID: {own}", f"WARC-Segment-Origin-ID: {urn}",
                          f"WARC-Segment-Number: {number}", *more)


def write(pages: DataFrame, folder: str, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write the archives, gzip files that hold ``FILE_ROWS`` segments at most."""
    record_table(pages, min_bytes, chunk_bytes).select("segment").write.option("lineSep", END).option("compression", "gzip") \
        .option("maxRecordsPerFile", FILE_ROWS).text(folder)


def _inflated(content: memoryview) -> Iterator[bytes]:
    """A gzip stream, or several in a row, in pieces."""
    stream = zlib.decompressobj(31)
    for start in range(0, len(content), 1 << 16):
        data = bytes(content[start:start + (1 << 16)])
        while data:
            yield stream.decompress(data)
            data = stream.unused_data
            if stream.eof:
                stream = zlib.decompressobj(31)
    yield stream.flush()


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each segment; holds one segment and one piece."""
    held = bytearray()
    pieces = iter(pieces)

    def fill(size: int) -> bool:
        while len(held) < size:
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("archive ends within a header")
                return
        version, *lines = held[:at].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC segment: {version[:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        if not fill(at + 4 + size + 4):
            raise ValueError("archive ends within a segment")
        block = bytes(held[at + 4:at + 4 + size])
        del held[:at + 4 + size + 4]
        yield headers, block


_CHUNK_NAMES = ("record", "page_id", "record_type", "refers_to", "target", "digest", "length", "chunk", "payload")


def _page(urn: str | None) -> int | None:
    number = urn.split(":")[2] if urn else "none"
    return None if number == "none" else int(number)


def _chunk_row(headers: dict[str, str], block: bytes) -> tuple:
    kind = headers["WARC-Type"]
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "continuation":
        urn = headers["WARC-Segment-Origin-ID"]
        return urn, _page(urn), kind, None, headers.get("WARC-Target-URI"), digest, None, int(headers["WARC-Segment-Number"]), block
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
    urn = headers["WARC-Record-ID"]
    number = int(headers["WARC-Segment-Number"]) if "WARC-Segment-Number" in headers else 0
    return urn, _page(urn), kind, _page(headers.get("WARC-Refers-To")), headers.get("WARC-Target-URI"), digest, length, number, payload


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, valid (payload as announced).

    A record in one segment is checked where it is read. The chunks of longer ones are written, sorted by record and
    number, and a digest runs over them one after the other.
    """
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sha1, size = None, None, 0
        for batch in batches:
            done = []
            for part in slices(batch, "payload", 1 << 20):
                for row in part.to_pylist():
                    if row["record_type"] != "continuation":
                        if head is not None:
                            done.append((head, sha1, size))
                        head, sha1, size = row, hashlib.sha1(), 0
                    sha1.update(row["payload"])
                    size += len(row["payload"])
            yield _checked(done)
        if head is not None:
            yield _checked([(head, sha1, size)])

    rows = materialize(_read_segments(spark, folder), "warc-segments")
    several = rows.where("record is not null").select("record", "page_id", "record_type", "refers_to", "digest", "length", "chunk", "payload")
    several = several.repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(joined, _RECORD)
    return rows.where("record is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid") \
        .unionByName(several)


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, valid boolean"


def _read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Finished records, and with ``record`` the chunks of those in several segments."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("content"):
                done, chunks, size = [], [], 0
                for headers, block in parse(_inflated(memoryview(value.as_buffer()))):
                    row = dict(zip(_CHUNK_NAMES, _chunk_row(headers, block)))
                    if row["chunk"]:
                        chunks.append(row)
                        size += len(block)
                    else:
                        done.append((row, hashlib.sha1(row["payload"]), len(row["payload"])))
                    if size > 1 << 20 or len(done) >= 1000:
                        yield both(done, chunks)
                        done, chunks, size = [], [], 0
                yield both(done, chunks)

    def both(done: list, chunks: list) -> pa.RecordBatch:
        checked = _checked(done)
        columns, names = [], []
        for name, column in zip(checked.schema.names, checked.columns):
            more = [c.get(name) for c in chunks]
            columns.append(pa.concat_arrays([column, pa.array(more, column.type)]))
            names.append(name)
        for name, kind in (("record", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("chunk", pa.int32()), ("payload", pa.binary())):
            columns.append(pa.array([None] * len(done) + [c[name] for c in chunks], kind))
            names.append(name)
        return pa.record_batch(columns, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(scan, _RECORD + ", record string, digest string, length long, chunk int, payload binary")


def _checked(done: list) -> pa.RecordBatch:
    out = []
    for row, sha1, size in done:
        if row["record_type"] == "revisit":  # has no payload of its own: what it announces is that of the response
            out.append((row["page_id"], row["length"], row["digest"], "revisit", row["refers_to"], True))
        else:
            out.append((row["page_id"], size, _base32(sha1), row["record_type"], row["refers_to"],
                        size == row["length"] and _base32(sha1) == row["digest"]))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")
    return pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives to the shared work folder and read them back."""
    folder = fresh_path(pages.sparkSession, "warc")
    write(pages, folder, min_bytes)
    return read(pages.sparkSession, folder)
