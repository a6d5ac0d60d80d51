"""Sharding by histogram sort: equal shares of bytes, found by counting below candidate keys, then one exchange.

Every row has a sort key of 63 bits: the hash of its text, then that of its doc_id, then of the place it was read from, so
that equal texts stand together and a text that a third of all rows share can still be cut anywhere. The keys and sizes are
written once. A round counts the exact bytes and rows below evenly spaced candidate keys over all partitions: the first round over
all keys, each later one only in the intervals in which a border still lies. A border is settled when the
bytes below a candidate are within ``TOLERANCE`` of a share of the aim, or when its interval holds a single row (or rows of
one key); so a group of equal texts smaller than that is not cut, and larger ones are cut only at a border. Shards
consist of pieces, which have such borders too; rows then go to their piece in one exchange and are sorted there, and
the rows of earlier pieces give each its slot.

Everything runs in DataFrame operations; the driver holds the counts of one round, a bounded number per piece.

The size of a row is the UTF-8 bytes of its text (a null text has none) plus 1. Null ids, rows that repeat and texts of any
length are sharded like others; a row larger than a share makes its shard larger. Rows keep all their columns in ``_row``, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stayledger.functions.sizing import small
from stayledger.sources.tables import materialize

SHARDS = 16
#: Share of a shard's bytes by which a border may be off.
TOLERANCE = 0.002
PIECE_BYTES = 256 << 20
KEY_BITS = 63
#: Bits of the key per part: text, doc_id, place.
TEXT_BITS, ID_BITS, PLACE_BITS = 32, 20, 11
#: Bits of a key that one round adds, and candidates per border in the first round.
ROUND_BITS, FIRST_CANDIDATES = 8, 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def sort_key(text: Column, doc_id: Column, place: Column) -> Column:
    """A key in [0, 2**63) that is the same for equal rows but for its last bits."""
    def bits(value: Column, n: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(value), 64 - n)
    return F.shiftleft(bits(text, TEXT_BITS), ID_BITS + PLACE_BITS).bitwiseOR(
        F.shiftleft(bits(doc_id, ID_BITS), PLACE_BITS)).bitwiseOR(bits(place, PLACE_BITS))


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small relation from one JSON literal."""
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _histogram(sized: DataFrame, prefix: Column) -> dict[int, list[tuple[int, int, int]]]:
    """Per open interval (``prefix``) the bytes and rows from each candidate key (``bin``) to the next."""
    counted = sized.groupBy(prefix.alias("open"), "bin").agg(F.sum("size").alias("bytes"), F.sum("rows").alias("rows"))
    out: dict[int, list[tuple[int, int, int]]] = {}
    for r in counted.collect():
        out.setdefault(r.open, []).append((r.bin, r.bytes, r.rows))
    return {k: sorted(v) for k, v in out.items()}


def borders(keys: DataFrame, parts: int, slack: float) -> list[int]:
    """The ``parts - 1`` keys that cut the rows of ``keys`` (key, size) into parts of equal bytes, each to within ``slack`` bytes.

    A border is the least key of its part. The number of rounds is at most that of the key's bits by ``ROUND_BITS``.
    """
    spark = keys.sparkSession
    bits = max(12, (parts * FIRST_CANDIDATES - 1).bit_length())
    rows = keys.select("key", "size", F.lit(1).cast("long").alias("rows"))
    counts = _histogram(rows.withColumn("bin", F.shiftright("key", KEY_BITS - bits)), F.lit(0).cast("long"))
    total = sum(b for _, b, _ in counts.get(0, []))
    aims = [total * i // parts for i in range(1, parts)]
    found: dict[int, int] = {}
    # Per open interval: bytes below it, and the aims in it.
    open_at = {0: (0, aims)}
    while True:
        shift = KEY_BITS - bits
        following: dict[int, tuple[int, list[int]]] = {}
        for prefix, (below, wanted) in open_at.items():
            bins = counts.get(prefix, [])
            starts = [below]
            for _, size, _ in bins:
                starts.append(starts[-1] + size)
            for aim in wanted:
                # The last candidate at or below the aim, and the first above it.
                k = bisect_left(starts, aim + 1) - 1
                if not bins:
                    found[aim] = 0
                    continue
                number, size, rows_in = bins[k]
                low, high = aim - starts[k], starts[k] + size - aim
                if low <= slack or high <= slack or rows_in == 1 or not shift:
                    found[aim] = min((number if low <= high else number + 1) << shift, (1 << KEY_BITS) - 1)
                else:
                    following.setdefault(number, (starts[k], []))[1].append(aim)
        if not following:
            return [found[a] for a in aims]
        step = min(ROUND_BITS, shift)
        inside = F.broadcast(_table(spark, [{"open": p} for p in following], "open:long"))
        narrowed = rows.withColumn("open", F.shiftright("key", shift)).join(inside, "open") \
            .withColumn("bin", F.shiftright("key", shift - step))
        counts, open_at, bits = _histogram(narrowed, F.col("open")), following, bits + step


def _piece(spark: SparkSession, rows: DataFrame, cuts: list[int]) -> DataFrame:
    """``rows`` with the piece that ``_key`` lies in: a lookup by the key's first bits, then the few cuts in that interval."""
    bits = max(6, len(cuts).bit_length() + 2)
    by_start: dict[int, list[int]] = {}
    for c in cuts:
        by_start.setdefault(min(c >> (KEY_BITS - bits), (1 << bits) - 1), []).append(c)
    table, passed = [], 0
    for start in range(1 << bits):
        inside = by_start.get(start, [])
        table.append({"_start": start, "_passed": passed, "_cuts": inside})
        passed += len(inside)
    lookup = small(_table(spark, table, "_start:long,_passed:long,_cuts:array<long>"))
    placed = rows.withColumn("_start", F.shiftright("_key", KEY_BITS - bits)).join(lookup, "_start")
    return placed.withColumn("_piece", (F.col("_passed") + F.size(F.filter("_cuts", lambda c: c <= F.col("_key")))).cast("int")) \
        .drop("_start", "_passed", "_cuts")


def sharded(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The rows of ``docs`` as ``_row``, with _size, _shard and _slot: shards in the order of the keys, slots gapless from 0 in each."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.monotonically_increasing_id().alias("_place")) \
        .select("_row", size_of(F.col("_row.text")).alias("_size"), sort_key(F.col("_row.text"), F.col("_row.doc_id"), F.col("_place")).alias("_key"))
    keys = materialize(rows.select(F.col("_key").alias("key"), F.col("_size").alias("size")), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    per_shard = max(1, -(-total // (shards * piece_bytes)))
    parts = shards * per_shard
    cuts = borders(keys, parts, tolerance * total / shards / per_shard)
    dealt = _piece(spark, rows, cuts).repartitionById(parts, "_piece").sortWithinPartitions("_key")
    # The number of a row in its task; the partition's number fills the bits above.
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    stored = materialize(dealt.select("_row", "_size", "_piece", within.alias("_within")), "shards")
    counts = {r._piece: r.n for r in stored.groupBy("_piece").agg(F.count("*").alias("n")).collect()}
    shifts, passed = [], 0
    for p in range(parts):
        passed = passed if p % per_shard else 0
        shifts.append({"_piece": p, "_shard": p // per_shard, "_passed": passed})
        passed += counts.get(p, 0)
    return stored.join(small(_table(spark, shifts, "_piece:int,_shard:int,_passed:long")), "_piece") \
        .select("_row", "_size", "_shard", (F.col("_passed") + F.col("_within")).alias("_slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The rows of ``docs`` in one folder per shard, ``_shard=0`` and on, with their ``_slot`` (a column of that name is kept as ``_row_slot``)."""
    found = sharded(docs, shards)
    kept = [F.col(f"_row.`{c}`").alias(f"_row{c}" if c in ("_shard", "_slot") else c) for c in docs.columns]
    found.select(*kept, "_slot", "_shard").write.partitionBy("_shard").parquet(path)
