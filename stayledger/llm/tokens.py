"""Words and lines of Arrow text columns as flat numpy arrays, with 64-bit hashes.

White space is ``[\\x20\\x09-\\x0D]`` throughout. Everything here works on one bounded slice
of a batch at a time and knows nothing of Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = " \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 19
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in WHITE]] = True
_BREAK = np.zeros(256, bool)
_BREAK[ord("\n")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xC2B2AE3D27D4EB4F | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, kept as long as needed."""

    def __init__(self, base: int) -> None:
        self.base = (base, pow(base, -1, 1 << 64))
        self.tables = [np.ones(1, np.uint64)] * 2

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            size = max(n, 1 << 16)
            self.tables = []
            for b in self.base:
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                self.tables.append(np.cumprod(steps, dtype=np.uint64))
        return self.tables


_BYTE_POWERS, _GRAM_POWERS = _Powers(_BASE), _Powers(_GRAM)


def range_hash(values: np.ndarray, begin: np.ndarray, end: np.ndarray, powers: _Powers = _GRAM_POWERS) -> np.ndarray:
    """One hash for each range ``[begin, end)`` of ``values`` (uint64), by differences of prefix sums."""
    ahead, back = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * ahead[:len(values)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64) * np.uint64(_BASE))


class Tokens:
    """The words or lines of a slice of texts.

    ``begin`` and ``end`` are byte positions in ``data``; ``first[i]`` is the number of the
    first token of text ``i`` (one entry more than texts); ``hashes`` is one uint64 a token.
    """

    def __init__(self, texts: pa.Array, lines: bool = False, lower: bool = False) -> None:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1] \
            if len(texts) else np.zeros(1, np.int32)
        raw = texts.buffers()[2] if len(texts) else None
        self.data = np.frombuffer(raw, np.uint8)[at[0]:at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        at = (at - at[0]).astype(np.int64)
        n = len(self.data)
        inside = ~(_BREAK if lines else _BLANK)[self.data]
        opens = np.zeros(n + 1, bool)
        opens[at] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:] = ~inside[:-1]
        after[:-1] = ~inside[1:]
        self.begin = np.flatnonzero(inside & (before | opens[:-1]))
        self.end = np.flatnonzero(inside & (after | opens[1:])) + 1
        if lines and len(self.begin):
            solid = np.append(np.flatnonzero(~_BLANK[self.data]), n)
            lead = solid[np.searchsorted(solid, self.begin)]
            some = lead < self.end
            last = solid[np.maximum(np.searchsorted(solid, self.end) - 1, 0)] + 1
            self.begin, self.end = lead[some], last[some]
        self.first = np.searchsorted(self.begin, at)
        data = _LOWER[self.data] if lower else self.data
        self.hashes = range_hash(data.astype(np.uint64) + np.uint64(1), self.begin, self.end, _BYTE_POWERS)

    def text_of(self) -> np.ndarray:
        """The text each token belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` tokens from each token on, and whether they lie in one text."""
        n = len(self.hashes)
        begin = np.arange(n)
        whole = begin + size <= np.repeat(self.first[1:], np.diff(self.first))
        return range_hash(self.hashes, begin, np.minimum(begin + size, n)), whole


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``values[i:i + width]``; past the end, of what is there."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:len(out) - step] = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with at most ``most`` bytes of text, one row at least."""
    sizes = batch.column(column).nbytes if batch.num_rows < 2 else None
    if sizes is not None:
        yield from [batch] if batch.num_rows else []
        return
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    total, start = np.cumsum(lengths, dtype=np.int64), 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
