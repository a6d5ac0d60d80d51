"""Substring dedup with a compressed FM-index per shard.

Each word covered by a window of ``WINDOW`` words that also starts earlier in the corpus is removed. A shard
(see ``repeats``) indexes its distinct segments: the Burrows-Wheeler transform of the words is kept as a
wavelet matrix of packed bits with rank counts. All windows are then matched against it from
their last word to their first; the interval of a window narrows with each word, and a window whose
interval holds a single row occurs once and is left early. Intervals that survive the whole window
have a matching statistic at the threshold or above; the earliest of their rows is reported.

Suffixes are sorted by their first 2**k >= ``WINDOW`` words, which is as deep as any pattern looks.
Null or empty texts, and texts with fewer words than a window, keep all words.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stayledger.llm.repeats import Shard, covered, removed_spans
from stayledger.llm.tokens import Tokens, slices

WINDOW, GRAM = 20, 8


class WaveletMatrix:
    """Counts of symbols before a position, over levels of packed bits with a count per 64-bit word."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.words, self.counts, self.zeros = bits, [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.frombuffer(np.pad(packed, (0, 8 + -len(packed) % 8)).tobytes(), np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]]))
            ones = bit.astype(bool)
            self.zeros.append(int(len(bit) - ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def follow(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Where the rows before ``position`` that hold ``symbol`` end in the last level's order."""
        for i in range(self.bits):
            word = position >> 6
            mask = (np.uint64(1) << (position & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[i][word] + np.bitwise_count(self.words[i][word] & mask)
            up = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            position = np.where(up, self.zeros[i] + ones, position - ones)
        return position


class FMIndex:
    """Index of a sequence of symbols from 0 on; answers patterns of up to ``depth`` symbols."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        rank, step = symbols.astype(np.int64), 1
        while step < depth:
            after = np.zeros(len(rank), np.int64)
            after[:-step] = rank[step:] + 1 if step < len(rank) else after[:-step]
            rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)[1].astype(np.int64)
            step *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        most = int(symbols.max(initial=0))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=most + 1))])
        self.tree = WaveletMatrix(symbols[self.suffixes - 1], max(1, most.bit_length()))
        every = np.arange(most + 1)
        self.shift = self.before[:-1] - self.tree.follow(every, np.zeros(most + 1, np.int64))

    def repeated(self, symbols: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The patterns ``symbols[start:start + size]`` that occur twice or more: number, interval of suffixes."""
        last = symbols[start + size - 1]
        number, low, high = np.arange(len(start)), self.before[last], self.before[last + 1]
        for back in range(size - 2, -1, -1):
            live = high - low > 1
            number, low, high = number[live], low[live], high[live]
            symbol = symbols[start[number] + back]
            low, high = (self.tree.follow(symbol, x) + self.shift[symbol] for x in (low, high))
        live = high - low > 1
        return number[live], low[live], high[live]


def fm_matches(shard: Shard) -> np.ndarray:
    """Earliest rank of each window of the shard."""
    lengths = np.diff(shard.first)
    gap = np.repeat(np.arange(len(lengths)), lengths)  # a separator follows each segment
    symbols = np.zeros(len(shard.ids) + len(lengths), np.int64)
    symbols[np.arange(len(shard.ids)) + gap] = shard.ids
    start = shard.start + shard.segment
    index = FMIndex(symbols, shard.window)
    number, low, high = index.repeated(symbols, start, shard.window)
    out = shard.rank.copy()
    if len(number):
        rank_at = np.full(len(symbols) + 1, np.iinfo(np.int64).max)
        rank_at[start] = shard.rank
        by_suffix = np.append(rank_at[index.suffixes], np.iinfo(np.int64).max)
        interval, of = np.unique(low * (len(symbols) + 1) + high, return_inverse=True)
        pairs = np.stack([interval // (len(symbols) + 1), interval % (len(symbols) + 1)], axis=1).ravel()
        out[number] = np.minimum.reduceat(by_suffix, pairs)[::2][of]
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (the words kept, joined by one space), kept_sha256."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                tokens = Tokens(part.column("_text"))
                data = tokens.data.tobytes()
                begin, end = tokens.begin.tolist(), tokens.end.tolist()
                texts, removed = [], []
                for i, ranges in enumerate(part.column("_ranges").to_pylist()):
                    first, last = int(tokens.first[i]), int(tokens.first[i + 1])
                    gone = covered(ranges, last - first, window) if ranges else np.zeros(last - first, bool)
                    stay = (np.flatnonzero(~gone) + first).tolist()
                    texts.append(b" ".join([data[begin[j]:end[j]] for j in stay]))
                    removed.append(last - first - len(stay))
                yield pa.record_batch({
                    "doc_id": part.column("_id"), "n_words": pa.array(np.diff(tokens.first).astype(np.int64)),
                    "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
                    "kept_sha256": pa.array([sha256(t).hexdigest() for t in texts], pa.string())})

    found = removed_spans(docs, window, gram, fm_matches).select("_id", "_text", "_ranges")
    return found.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
