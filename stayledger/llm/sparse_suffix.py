"""Suffix-array dedup: sparse suffix arrays over suffixes kept at minimiser positions.

Passages of ``MIN_WORDS`` words or more that occur earlier in the corpus are found and can be cut
out. In each shard (see ``repeats``) only the suffixes that start at a minimiser are kept. They
are sorted, and neighbours are compared to get their common prefixes; the same is done for the texts
to the left, read backwards. A window with its minimiser at distance ``d`` from its start occurs
again exactly where the match reaches ``d`` words to the left and the rest of the window to the right,
and both are intervals of neighbours in the two sorted arrays.

Null or empty texts, and texts of fewer than ``MIN_WORDS`` words, have no such passage. Other columns are
carried through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stayledger.llm.repeats import Shard, covered, earliest, removed_spans
from stayledger.llm.tokens import Tokens, slices

MIN_WORDS, GRAM = 50, 12
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sorted_suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts fixed-width rows of token numbers: place of each row, common prefix with the row before."""
    count, width = rows.shape
    order = np.argsort(np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * width}").ravel(), kind="stable")
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    ranked = rows[order]
    equal = ranked[1:] == ranked[:-1]
    common = np.zeros(count, np.int64)
    common[1:] = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
    return place, common


def suffix_matches(shard: Shard) -> np.ndarray:
    """Earliest rank of each window of the shard."""
    at, anchor = shard.anchors()
    reach = shard.window - shard.gram + 1
    segment = np.searchsorted(shard.first, at, side="right") - 1
    low, high = shard.first[segment], shard.first[segment + 1]
    ids = np.append(shard.ids, 0)
    ahead = at[:, None] + np.arange(shard.window)
    back = at[:, None] - 1 - np.arange(reach)
    right, common_right = _sorted_suffixes(np.where(ahead < high[:, None], ids[np.minimum(ahead, len(ids) - 1)], 0))
    left, common_left = _sorted_suffixes(np.where(back >= low[:, None], ids[back], 0))
    distance = at[anchor] - shard.start
    out = np.empty(len(shard.start), np.int64)
    by_distance = np.argsort(distance, kind="stable")
    borders = np.searchsorted(distance[by_distance], np.arange(reach + 1))
    for d in range(reach):
        windows = by_distance[borders[d]:borders[d + 1]]
        if len(windows):
            to_right = np.cumsum(common_right < shard.window - d)[right[anchor[windows]]]
            to_left = np.cumsum(common_left < d)[left[anchor[windows]]]
            out[windows] = earliest((to_left, to_right), shard.rank[windows])
    return out


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """The passages that occur earlier: doc_id, start_word (from 0), n_words, passage (text as it stands).

    A passage is a longest run of words each covered by a repeated window of ``min_words`` words.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                tokens = Tokens(part.column("_text"))
                data = tokens.data.tobytes()
                rows, starts, sizes, texts = [], [], [], []
                for i, ranges in enumerate(part.column("_ranges").to_pylist()):
                    first = int(tokens.first[i])
                    mask = covered(ranges, int(tokens.first[i + 1]) - first, min_words)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                        rows.append(i)
                        starts.append(a)
                        sizes.append(b - a)
                        texts.append(data[tokens.begin[first + a]:tokens.end[first + b - 1]])
                yield pa.record_batch({"doc_id": part.column("_id").take(pa.array(rows, pa.int64())), "start_word": pa.array(starts, pa.int64()),
                                       "n_words": pa.array(sizes, pa.int64()), "passage": pa.array(texts, pa.binary()).cast(pa.string())})

    found = removed_spans(docs, min_words, gram, suffix_matches).where("_ranges is not null")
    return found.select("_id", "_text", "_ranges").mapInArrow(cut, "doc_id long, start_word long, n_words long, passage string")


def without_passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; a text with cuts has its words joined by one space."""
    @F.pandas_udf("string")
    def cut(text, ranges):
        def one(t, r):
            if r is None:
                return t
            words = _WORD.findall(t)
            gone = covered(r, len(words), min_words)
            return " ".join(w for w, g in zip(words, gone) if not g)
        return text.combine(ranges, one)

    found = removed_spans(docs, min_words, gram, suffix_matches, whole_rows=True)
    return found.withColumn("_text", cut("_text", "_ranges")).select(
        *[(F.col("_text") if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
