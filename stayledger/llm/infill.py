"""Fill-in-middle by displacement scatter.

A text is cut into a prefix, a middle and a suffix, and the parts change places behind marks: ``<P>`` prefix ``<S>`` suffix
``<M>`` middle (psm), or ``<S>`` suffix ``<P>`` prefix ``<M>`` middle (spm). The texts of a batch lie in one row of bytes. Each part
moves by a fixed distance, so a difference array holds the change of that distance at the first byte of each part; its
cumulative sum gives every byte its shift, and one scatter writes all outputs. Restoring finds the marks in the output,
builds the same array from their places alone, and gathers the bytes back.

Units of a text are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, matched from the left: words with the white space
before them, and white space at the end. Cuts fall between units. Four numbers h1 to h4 come from the SHA-256 of
``<seed>:<doc_id>``; the prefix ends after the smaller of h1 and h2 modulo the number of units plus one, the middle after the larger. A text stays
``plain`` if it is empty, holds a mark, or if h3 modulo 100 is ``rate`` or more; else it is spm if h4 modulo 100 is below ``spm``, or psm.

Null texts count as empty and restore to empty ones. A null doc_id is hashed as ``<seed>:``. Rows that repeat give equal
outputs. Texts may be of any length: the bytes of a batch are moved a window at a time. Rows keep all their columns in ``_row``, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from stayledger.llm.batches import bound_batches
from stayledger.llm.tokens import WHITE, slices

SEED, RATE, SPM = 42, 50, 80
#: Fixed by the output format; all of one length.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
SLICE_BYTES = 4 << 20
#: Bytes that are shifted at once.
WINDOW = 1 << 20
PLAIN, PSM, SPM_FORM = 0, 1, 2
FORMS = ("plain", "psm", "spm")
_BLANK = np.isin(np.arange(256), [ord(c) for c in WHITE])


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text starts (one entry more than texts)."""
    texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    start = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[start[0]:start[-1]] if raw is not None and start[-1] > start[0] else np.zeros(0, np.uint8)
    return data, start - start[0]


def marks(data: np.ndarray) -> np.ndarray:
    """At each byte, the letter of the mark that starts there, else 0."""
    out = np.zeros(len(data), np.uint8)
    at = np.flatnonzero(data[:-2] == PREFIX[0]) if len(data) >= MARK else np.zeros(0, np.int64)
    at = at[data[at + 2] == PREFIX[2]]
    letter = data[at + 1]
    known = (letter == PREFIX[1]) | (letter == SUFFIX[1]) | (letter == MIDDLE[1])
    out[at[known]] = letter[known]
    return out


def moved(data: np.ndarray, at: np.ndarray, shift: np.ndarray, size: int, gather: bool = False) -> np.ndarray:
    """``size`` bytes to which the parts of ``data`` move that start at ``at`` (ascending, the first at 0), each by its ``shift``.

    With ``gather``, the inverse: ``at`` and ``shift`` are those of the result, and byte ``i`` of it is taken from ``i + shift``.
    """
    out = np.zeros(size, np.uint8)
    span = size if gather else len(data)
    # Parts may be empty: of several at one place the last holds, and the sum of their differences is its shift.
    step = np.diff(shift, prepend=0)
    carry, first = 0, 0
    for lo in range(0, span, WINDOW):
        hi = min(lo + WINDOW, span)
        last = int(np.searchsorted(at, hi))
        change = np.zeros(hi - lo, np.int64)
        np.add.at(change, at[first:last] - lo, step[first:last])
        change[0] += carry
        place = np.cumsum(change)
        carry, first = int(place[-1]), last
        place += np.arange(lo, hi)
        if gather:
            out[lo:hi] = data[place]
        else:
            out[place] = data[lo:hi]
    return out


def _column(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Texts that end at ``at[1:]``."""
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


class Cut:
    """Where the parts of each text of a slice begin and end, and its form."""

    def __init__(self, ids: list[int | None], texts: pa.Array, seed: int, rate: int, spm: int) -> None:
        self.data, self.start = joined(texts)
        begin, end = self.start[:-1], self.start[1:]
        inside = ~_BLANK[self.data]
        closed = np.ones(len(inside), bool)
        closed[:-1] = ~inside[1:]
        closed[end[end > begin] - 1] = True
        ends = np.flatnonzero(inside & closed) + 1
        before = np.searchsorted(ends, self.start, side="right")
        words = np.diff(before)
        ends = np.append(ends, 0)
        self.units = words + ((end > begin) & ((words == 0) | (ends[np.maximum(before[1:] - 1, 0)] < end)))
        hashes = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest() for i in ids]
        h = np.frombuffer(b"".join(hashes), ">u4").reshape(-1, 8)[:, :4].astype(np.int64)
        cuts = np.sort(h[:, :2] % (self.units + 1)[:, None], axis=1)

        def place(unit: np.ndarray) -> np.ndarray:
            """The byte at which so many units have ended."""
            word = ends[np.minimum(before[:-1] + np.maximum(unit, 1) - 1, len(ends) - 1)]
            return np.where(unit == 0, begin, np.where(unit > words, end, word))

        self.first, self.second = place(cuts[:, 0]), place(cuts[:, 1])
        # A mark counts if it lies in one text.
        found = np.flatnonzero(marks(self.data))
        owner = np.searchsorted(self.start, found, side="right") - 1
        marked = np.zeros(len(ids), bool)
        marked[owner[found + MARK <= self.start[owner + 1]]] = True
        plain = (end == begin) | marked | (h[:, 2] % 100 >= rate)
        self.form = np.where(plain, PLAIN, np.where(h[:, 3] % 100 < spm, SPM_FORM, PSM))

    def chars(self, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        """Code points between two bytes; null for plain texts."""
        leads = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=leads[1:])
        return pa.array(leads[end] - leads[begin], mask=self.form == PLAIN)

    def outputs(self) -> pa.Array:
        begin, end = self.start[:-1], self.start[1:]
        first, second, spm = self.first, self.second, self.form == SPM_FORM
        extra = np.where(self.form == PLAIN, 0, 3 * MARK)
        out_start = np.append(0, np.cumsum(end - begin + extra))
        out = out_start[:-1]
        prefix, middle, suffix = first - begin, second - first, end - second
        # Where each part goes: behind its mark, and behind the other outer part if that comes first.
        to_prefix = out + np.where(spm, 2 * MARK + suffix, MARK)
        to_suffix = out + np.where(spm, MARK, 2 * MARK + prefix)
        to_middle = out + 3 * MARK + prefix + suffix
        changed = self.form != PLAIN
        at = np.stack([begin, first, second], axis=1)
        target = np.stack([np.where(changed, to_prefix, out), np.where(changed, to_middle, out + prefix), np.where(changed, to_suffix, out + prefix + middle)], axis=1)
        data = moved(self.data, at.ravel(), (target - at).ravel(), int(out_start[-1]))
        for mark, to in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
            for k, code in enumerate(mark):
                data[to[changed] - MARK + k] = code
        return _column(data, out_start)


def restored_texts(outputs: pa.Array, changed: np.ndarray) -> pa.Array:
    """The texts that the outputs were made from; ``changed`` says which are not plain."""
    data, start = joined(outputs)
    begin, end = start[:-1], start[1:]
    letter = marks(data)
    owner = np.repeat(np.arange(len(changed)), end - begin)
    place = {}
    for mark in (PREFIX, SUFFIX, MIDDLE):
        at = np.flatnonzero(letter == mark[1])
        at = at[changed[owner[at]] & (at + MARK <= end[owner[at]])]
        place[mark] = begin.copy()
        place[mark][owner[at]] = at
    p, s, m = place[PREFIX], place[SUFFIX], place[MIDDLE]
    text_start = np.append(0, np.cumsum(end - begin - np.where(changed, 3 * MARK, 0)))
    out = text_start[:-1]
    # A part ends where the next mark begins, or with the output.
    prefix = np.where(changed, np.where(p < s, s, m) - p - MARK, 0)
    middle = np.where(changed, end - m - MARK, 0)
    at = np.stack([out, out + prefix, out + prefix + middle], axis=1)
    source = np.stack([np.where(changed, p + MARK, begin), np.where(changed, m + MARK, begin), np.where(changed, s + MARK, begin)], axis=1)
    return _column(moved(data, at.ravel(), (source - at).ravel(), int(text_start[-1]), gather=True), text_start)


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """The rows of ``docs`` as ``_row``, with n (units), form, prefix_chars, middle_chars and output."""
    bound_batches(docs.sparkSession)
    kind = T.StructType([T.StructField("_row", docs.schema), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                         T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.append_column("_text", batch.column("_row").field("text")), "_text", SLICE_BYTES):
                one = Cut(part.column("_row").field("doc_id").to_pylist(), part.column("_text"), seed, rate, spm)
                yield pa.record_batch({
                    "_row": part.column("_row"), "n": pa.array(one.units), "form": pa.array([FORMS[x] for x in one.form.tolist()], pa.string()),
                    "prefix_chars": one.chars(one.start[:-1], one.first), "middle_chars": one.chars(one.first, one.second),
                    "output": one.outputs()})

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.mapInArrow(cut, kind)


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` with the column ``restored``, made from ``output`` and ``form`` alone."""
    bound_batches(outputs.sparkSession)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "output", SLICE_BYTES):
                changed = np.array([x != FORMS[PLAIN] for x in part.column("form").to_pylist()], bool)
                yield part.append_column("restored", restored_texts(part.column("output"), changed))

    return outputs.mapInArrow(back, T.StructType([*outputs.schema.fields, T.StructField("restored", T.StringType())]))
