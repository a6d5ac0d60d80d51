"""Windows of tokens that occur earlier in the corpus: the frame shared by the three repeat finders.

A window is ``window`` consecutive tokens (words, or lines that are not blank) of one document. It
is a repeat if the same tokens also start earlier: in a document with a smaller id, or in the same
document before it. Finding them takes these steps:

1. Each window has an anchor, the least hash among the ``gram``-token pieces in it. A run of
   windows with one anchor is a segment. Equal windows have equal anchors, wherever they stand.
2. Anchors are counted over the whole corpus. A segment whose anchor occurs once, and stands in it
   once, holds no repeat and ends here, so the text that moves on is the repeated part.
3. The other segments travel with their text to the shard of their anchor. Copies of a segment
   found in one slice of a task travel once. An anchor with over ``HOT`` occurrences (a common line
   or phrase with ever other surroundings) is spread: each of its windows travels by its own hash.
4. In the shard, a matcher (suffix array, winnowing join, FM-index) finds the earliest
   occurrence of every window of the distinct segments. Copies of a segment are repeats as a whole.
5. The repeats of a document are gathered and joined with its row.

Nothing is dropped or capped; a window is compared by the 64-bit hashes of its tokens.
Shards are cut from a sorted partition at anchor borders, so memory does not follow the partition.

Rows are told apart by (id, hash of the text): rows that repeat both count as one document and
get the same verdict; equal ids with different texts are documents in the order of the hash. A null
id sorts first. A null text has no tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from stayledger.llm.batches import bound_batches
from stayledger.llm.tokens import Tokens, range_hash, sliding_min, slices
from stayledger.sources.tables import materialize

HOT = 1000
#: Most windows of a segment: bounds what one segment of a monotonous text carries.
RUN = 64
SHARD_BYTES = 2 << 20
Matcher = Callable[["Shard"], np.ndarray]


class Shard:
    """Distinct segments of some anchors, as the matchers see them.

    ``ids``: small integers from 1 for the tokens of all segments; ``first``: token number at which
    each segment starts, one entry more than segments; ``occurrence``: rank in corpus order of the
    first window of each segment, so that window ``j`` has ``occurrence + j``.
    """

    def __init__(self, tokens: Tokens, occurrence: np.ndarray, window: int, gram: int) -> None:
        self.ids = np.unique(tokens.hashes, return_inverse=True)[1].astype(np.int64) + 1
        self.first, self.window, self.gram = tokens.first, window, gram
        counts = np.diff(self.first) - window + 1
        self.segment = np.repeat(np.arange(len(counts)), counts)
        self.offset = np.arange(len(self.segment)) - np.repeat(np.cumsum(counts) - counts, counts)
        #: Token at which each window starts, and the rank of the window in corpus order.
        self.start = self.first[:-1][self.segment] + self.offset
        self.rank = occurrence[self.segment] + self.offset
        hashes, whole = tokens.grams(gram)
        self.gram_hash = np.where(whole, hashes, np.uint64(2**64 - 1))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens at which an anchor stands, and for each window the number of its leftmost anchor."""
        least = sliding_min(self.gram_hash, self.window - self.gram + 1)[self.start]
        low = np.full(len(self.first) - 1, 2**64 - 1, np.uint64)
        np.minimum.at(low, self.segment, least)
        at = np.flatnonzero(self.gram_hash == np.repeat(low, np.diff(self.first)))
        return at, np.searchsorted(at, self.start)


def earliest(keys: tuple[np.ndarray, ...], rank: np.ndarray) -> np.ndarray:
    """The least rank among the rows with the same keys."""
    order = np.lexsort((rank, *keys))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = rank[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _segments(tokens: Tokens, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """First token, number of windows, anchor and text of each segment, and whether its anchor may stand in it twice."""
    hashes, whole = tokens.grams(gram)
    least = sliding_min(np.where(whole, hashes, np.uint64(2**64 - 1)), window - gram + 1)
    text = tokens.text_of()
    at = np.arange(len(text))
    valid = at + window <= tokens.first[1:][text] if len(text) else np.zeros(0, bool)
    reach = window - gram + 1
    # A token is an anchor if it is the least of some window that covers it.
    most = sliding_min(~np.where(valid, least, np.uint64(0))[::-1], reach)[::-1]
    anchors = np.flatnonzero(hashes == ~most)
    at, least, text = at[valid], least[valid], text[valid]
    if not len(at):
        return at, at, least.view(np.int64), text, at
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    inside = np.arange(len(at)) - begin[np.cumsum(new) - 1]
    begin = np.flatnonzero(inside % RUN == 0)
    start, count = at[begin], np.diff(np.append(begin, len(at)))
    same = np.zeros(len(anchors) + 1, np.int64)
    same[2:] = np.cumsum(hashes[anchors][1:] == hashes[anchors][:-1])
    left, right = np.searchsorted(anchors, start), np.searchsorted(anchors, start + count + reach - 1)
    twice = same[right] > same[np.minimum(left + 1, right)]
    return start, count, least[begin].view(np.int64), text[begin], twice


def _order(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
    """Rank of each row by (id, hash), null ids first; equal rows share a rank."""
    missing = np.asarray(ids.is_null())
    a, b = np.asarray(ids.fill_null(0), np.int64), np.asarray(hashes, np.int64)
    order = np.lexsort((b, a, ~missing))
    new = np.zeros(len(order), np.int64)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]) | (missing[order][1:] != missing[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _runs(mask: np.ndarray, segment: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true windows within a segment: segment, first window, number of windows."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (segment[at][1:] != segment[at][:-1])
    begin = np.flatnonzero(new)
    return segment[at[begin]], offset[at[begin]], np.diff(np.append(begin, len(at)))


def removed_spans(docs: DataFrame, window: int, gram: int, matcher: Matcher, lines: bool = False,
                  id_column: str = "doc_id", text_column: str = "text", whole_rows: bool = False) -> DataFrame:
    """``_id``, ``_text`` and ``_ranges`` of every row of ``docs``; with ``whole_rows`` the row itself too, as ``_row``.

    The rows are shuffled once, for segments and result alike. ``_ranges`` has the repeated windows of the row as numbers ``start << 32 | count`` (count
    windows from token ``start`` on), in no order, and is null where there are none.
    """
    def emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                _, _, anchor, text, twice = _segments(Tokens(part.column("_text"), lines), window, gram)
                number = np.arange(len(text)) - np.searchsorted(text, text)
                anchor, text, number = (np.repeat(x, 1 + twice) for x in (anchor, text, number))
                yield pa.record_batch({"anchor": pa.array(anchor), "_id": part.column("_id").take(pa.array(text)),
                                       "_hash": part.column("_hash").take(pa.array(text)),
                                       "number": pa.array(number.astype(np.int32))})

    def emit_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                yield _carried(part, lines, window, gram)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            yield _matched(shard, lines, window, gram, matcher)

    bound_batches(docs.sparkSession)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select(
        "_row", F.col(f"_row.`{id_column}`").cast("long").alias("_id"), F.col(f"_row.`{text_column}`").alias("_text"),
        F.xxhash64(F.col(f"_row.`{text_column}`")).alias("_hash"))
    texts = keyed.select("_id", "_text", "_hash")
    anchors = texts.mapInArrow(emit_anchors, "anchor long, _id long, _hash long, number int")
    common = anchors.groupBy("anchor").count().where("count > 1").select("anchor", (F.col("count") > HOT).alias("hot"))
    # Written, so that the join with it is one of two plain shuffles, whose hot anchors can be split.
    common = materialize(common, "repeat-anchors")
    kept = anchors.join(common.hint("merge"), "anchor").groupBy("_id", "_hash").agg(
        F.collect_set((F.col("number").cast("long") * 2 + F.col("hot").cast("long"))).alias("_numbers"))
    kept = materialize(kept, "repeat-segments")
    # Both joins of the rows have one shuffle in common; a broadcast at small sizes would only hide it.
    rows = keyed.select("_row", "_id", "_hash") if whole_rows else texts
    text = F.col(f"_row.`{text_column}`").alias("_text") if whole_rows else F.col("_text")
    met = rows.alias("a").join(kept.hint("merge").alias("b"), _same_row())
    carried = met.select(*["_row"][:whole_rows], "a._id", text, "a._hash", "_numbers").mapInArrow(
        emit_segments, "shard long, content_hash long, _id long, _hash long, start int, n int, content binary")
    ranges = carried.repartition("shard").sortWithinPartitions("shard").mapInArrow(match, "_id long, _hash long, range long")
    gathered = ranges.groupBy("_id", "_hash").agg(F.collect_set("range").alias("_ranges"))
    met = rows.alias("a").join(gathered.hint("merge").alias("b"), _same_row(), "left")
    return met.select(*["_row"][:whole_rows], "a._id", text, "_ranges")


def _same_row() -> Column:
    return F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._hash") == F.col("b._hash"))


def _carried(part: pa.RecordBatch, lines: bool, window: int, gram: int) -> pa.RecordBatch:
    """The segments of a slice that go to shards; those that repeat an earlier one of the slice go without text."""
    tokens = Tokens(part.column("_text"), lines)
    start, n, anchor, text, _ = _segments(tokens, window, gram)
    numbers = part.column("_numbers")
    flags = np.asarray(numbers.flatten(), np.int64)
    owner = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(numbers).fill_null(0)))
    first = np.searchsorted(text, np.arange(part.num_rows))
    keep, hot = np.zeros(len(start), bool), np.zeros(len(start), bool)
    keep[first[owner] + flags // 2] = True
    hot[first[owner] + flags // 2] = flags % 2 == 1
    start, n, anchor, text, hot = start[keep], n[keep], anchor[keep], text[keep], hot[keep]
    pieces = np.where(hot, n, 1)  # each window of a hot anchor stands alone
    which = np.repeat(np.arange(len(start)), pieces)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = start[which] + inside
    n = np.where(hot[which], 1, n[which])
    end = begin + n + window - 1
    content_hash = range_hash(tokens.hashes, begin, end)
    shard = np.where(hot[which], (content_hash * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), anchor[which])
    text = text[which]
    local = (begin - tokens.first[text]).astype(np.int64)
    rank = (_order(part.column("_id"), part.column("_hash"))[text] << 32) | local
    least = earliest((content_hash, shard), rank)
    lead = rank == least
    order = np.flatnonzero(lead)
    _, once = np.unique(rank[order], return_index=True)  # a row that is there twice
    order = np.concatenate([order[once], np.flatnonzero(~lead)])
    carried = lead[order]
    data = tokens.data.tobytes()
    content = [data[b:e] if c else None for b, e, c in zip(
        tokens.begin[begin[order]].tolist(), tokens.end[end[order] - 1].tolist(), carried.tolist())]
    rows = pa.array(text[order])
    shard = np.where(carried, shard[order], (content_hash[order] ^ rank[order].astype(np.uint64)).view(np.int64))
    return pa.record_batch({
        "shard": pa.array(shard), "content_hash": pa.array(content_hash[order].view(np.int64)),
        "_id": part.column("_id").take(rows), "_hash": part.column("_hash").take(rows),
        "start": pa.array(local[order].astype(np.int32)), "n": pa.array(n[order].astype(np.int32)),
        "content": pa.array(content, pa.binary())})


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of whole shard keys with ``SHARD_BYTES`` of text or little more, from rows sorted by key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch, "content", SHARD_BYTES // 4):
            key = np.asarray(part.column("shard"))
            cut = int(np.searchsorted(key, key[-1]))
            whole = cut > 0 or held and np.asarray(held[-1].column("shard"))[-1] != key[0]
            if size >= SHARD_BYTES and whole:
                yield _together([*held, part.slice(0, cut)])
                held, size, part = [], 0, part.slice(cut)
            held.append(part)
            size += part.column("content").nbytes + 64 * part.num_rows
    if held:
        yield _together(held)


def _together(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _matched(rows: pa.RecordBatch, lines: bool, window: int, gram: int, matcher: Matcher) -> pa.RecordBatch:
    """The repeated windows among the rows of a shard, as ranges."""
    n, start = np.asarray(rows.column("n"), np.int64), np.asarray(rows.column("start"), np.int64)
    rank = (_order(rows.column("_id"), rows.column("_hash")) << 32) | start
    carried = np.asarray(rows.column("content").is_valid())
    at = np.flatnonzero(carried)
    key = np.asarray(rows.column("shard"))[at], np.asarray(rows.column("content_hash"))[at]
    least = earliest(key, rank[at])
    copy = np.ones(len(n), bool)
    copy[at] = rank[at] > least
    lead = at[rank[at] == least]
    _, once = np.unique(np.stack([np.asarray(rows.column("content_hash"))[lead], rank[lead]]), axis=1, return_index=True)
    lead = lead[once]
    copies = np.flatnonzero(copy)
    picked = [copies]
    begin, count = [start[copies]], [n[copies]]
    if len(lead):
        shard = Shard(Tokens(rows.column("content").take(pa.array(lead)), lines), rank[lead], window, gram)
        segment, offset, length = _runs(matcher(shard) < shard.rank, shard.segment, shard.offset)
        picked.append(lead[segment])
        begin.append(start[lead[segment]] + offset)
        count.append(length)
    taken = pa.array(np.concatenate(picked))
    return pa.record_batch({"_id": rows.column("_id").take(taken), "_hash": rows.column("_hash").take(taken),
                            "range": pa.array(np.concatenate(begin) << 32 | np.concatenate(count))})


def covered(ranges: list[int] | None, size: int, window: int) -> np.ndarray:
    """Which of ``size`` tokens lie in a repeated window."""
    steps = np.zeros(size + 1, np.int32)
    if ranges is not None and len(ranges):
        packed = np.asarray(ranges, np.int64)
        np.add.at(steps, packed >> 32, 1)
        np.add.at(steps, (packed >> 32) + (packed & 0xFFFFFFFF) + window - 1, -1)
    return np.cumsum(steps[:-1]) > 0
