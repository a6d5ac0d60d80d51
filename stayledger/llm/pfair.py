"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are numbered and cut into blocks. A source with weight ``w`` has its block ``i`` released at
slot ``floor(i / w)`` and due by ``ceil((i + 1) / w)``; one block goes into each slot, earliest deadline first. As long
as all sources last, no source is a whole block ahead of or behind its share at any slot.

Weights are whole parts of a period of slots, so the schedule repeats and is worked out once: the slot of
block ``i`` of a source with ``k`` parts is ``period * (i // k)`` plus a lookup by ``i % k``. The lookup has one row per slot of
the period, whose length depends on the number of sources alone. Documents are numbered in pieces
of a source, so that no task holds a whole source.

No document is dropped or repeated: when a source runs out, its slots stay empty and the others go on in their order.
``balanced`` marks the slots before the first source runs out, where the target weights hold. A null source is a source of
its own. Rows that repeat are mixed like any other; an empty table gives an empty mix.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window, functions as F

from stayledger.sources.tables import materialize

BLOCK = 8
PERIOD = 4096
PIECE_ROWS = 5_000
#: Exponent on the sources' sizes that gives the target weights: between equal shares (0) and shares as found (1).
TEMPERATURE = 0.5


def tempered(counts: dict[str, int], temperature: float = TEMPERATURE) -> dict[str, float]:
    total = sum(n ** temperature for n in counts.values())
    return {s: n ** temperature / total for s, n in counts.items()}


def parts_of(weights: dict[str, float], period: int) -> dict[str, int]:
    """Weights as whole parts of the period, one at least, by largest remainders."""
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    spare, total = period - len(weights), sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    over = {s: max(0.0, x - 1) for s, x in exact.items()}
    scale = spare / sum(over.values()) if sum(over.values()) else 0.0
    parts = {s: 1 + int(x * scale) for s, x in over.items()}
    rest = sorted(over, key=lambda s: (-(over[s] * scale % 1), s))
    for s in (rest * 2)[:period - sum(parts.values())]:
        parts[s] += 1
    return parts


def schedule(parts: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, number of the block, slot) for one period, earliest deadline first among released blocks."""
    period = sum(parts.values())
    ready: list[tuple[int, str, int]] = []
    coming = [(0, s, 0) for s in sorted(parts)]
    out = []
    for slot in range(period):
        while coming and coming[0][0] <= slot:
            _, s, i = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(i + 1) * period // parts[s]), s, i))
        _, s, i = heapq.heappop(ready)
        out.append((s, i, slot))
        if i + 1 < parts[s]:
            heapq.heappush(coming, ((i + 1) * period // parts[s], s, i + 1))
    return out


def source_key(source: Column) -> Column:
    """Null apart from the empty string."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """The rows of ``docs``, packed as ``_row``, with ``_slot``, ``_place`` (in its block), ``_source_rank`` and ``_balanced``.

    ``weights`` has a positive target per key of ``source_key``; without it, sizes to the power ``TEMPERATURE``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select(
        "_row", source_key(F.col("_row.source")).alias("_source"), F.xxhash64("_row.doc_id", "_row.text").alias("_order"))
    total_rows = docs.count()
    width = max(1, total_rows // PIECE_ROWS)
    piece = F.pmod(F.col("_order"), F.lit(width))
    sizes = materialize(rows.groupBy("_source", piece.alias("_piece")).agg(F.count("*").alias("n")), "mix-sizes")
    counts = {r._source: r.n for r in sizes.groupBy("_source").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return rows.select("_row", *[F.lit(0).cast("long").alias(c) for c in ("_slot", "_place", "_source_rank")],
                           F.lit(True).alias("_balanced"))
    period = max(period, 4 * len(counts))
    target = tempered(counts) if weights is None else {s: weights[s] for s in counts}
    parts = parts_of(target, period)
    lookup = spark.createDataFrame([(s, i, slot, parts[s]) for s, i, slot in schedule(parts)],
                                   "_source string, _turn long, _offset long, _parts long")
    # Slots until a source lacks a full block of its own.
    end = min((counts[s] // block) // parts[s] * period + (counts[s] // block) % parts[s] * period // parts[s] for s in counts)
    before = Window.partitionBy("_source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_source", "_piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy("_source", "_piece").orderBy("_order", "_row.doc_id"))
    ranked = rows.withColumn("_piece", piece).withColumn("_number", within).join(shifts, ["_source", "_piece"]) \
        .withColumn("_source_rank", F.col("_number") + F.col("_shift") - 1)
    block_number = F.floor(F.col("_source_rank") / block).cast("long")
    sized = spark.createDataFrame(list(parts.items()), "_source string, _parts long")
    turned = ranked.join(F.broadcast(sized), "_source").withColumns(
        {"_turn": F.pmod(block_number, F.col("_parts")), "_round": F.floor(block_number / F.col("_parts")).cast("long")}).drop("_parts")
    # One row per slot of the period: its size follows the number of sources, not of documents.
    placed = turned.join(F.broadcast(lookup.drop("_parts")), ["_source", "_turn"])
    slot = F.col("_round") * period + F.col("_offset")
    return placed.select("_row", slot.alias("_slot"), F.pmod("_source_rank", F.lit(block)).cast("long").alias("_place"),
                         F.col("_source_rank").cast("long").alias("_source_rank"), (slot < end).alias("_balanced"))


def interleaved(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` in the order of the mix: sorted over all partitions, so that files written from it keep it."""
    return mixed(docs, weights, block).orderBy("_slot", "_place").select("_row.*")
