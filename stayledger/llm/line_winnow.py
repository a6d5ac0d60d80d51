"""Line dedup by winnowing over line hashes.

Runs of ``MIN_LINES`` lines or more that occur earlier in the corpus are deleted; the first occurrence
stays. A line is what stands between line feeds, without white space at both ends; blank lines take no
part and stay where they are. The fingerprint of a window of lines is the least line hash in it, so that
equal runs are sure to share one. Positions are joined by fingerprint, and each match is extended
line by line to the right and to the left; windows that match side by side form the run.

Null texts stay null and empty ones empty; a text with fewer lines than a window stays as it is. A text of any length is
cut by its task as a whole. Equal rows share a verdict, and a null id comes first.
All columns are kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from stayledger.llm.repeats import Shard, covered, earliest, removed_spans
from stayledger.llm.tokens import WHITE

MIN_LINES = 3


def _extended(anchor: np.ndarray, steps: int, line_at) -> list[np.ndarray]:
    """Groups of positions that agree on the fingerprint and on 0, 1, .. ``steps`` more lines."""
    groups = [anchor]
    for step in range(1, steps + 1):
        line = line_at(step)
        pair = groups[-1] * (int(line.max(initial=0)) + 1) + line
        groups.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
    return groups


def winnowing_matches(shard: Shard) -> np.ndarray:
    """Earliest rank of each window of the shard."""
    at, anchor = shard.anchors()
    segment = np.searchsorted(shard.first, at, side="right") - 1
    low, high = shard.first[segment], shard.first[segment + 1]

    def line(position: np.ndarray) -> np.ndarray:
        inside = (position >= low) & (position < high)
        return np.where(inside, shard.ids[np.clip(position, 0, len(shard.ids) - 1)], 0)

    right = _extended(shard.ids[at], shard.window - 1, lambda step: line(at + step))
    left = _extended(shard.ids[at], shard.window - shard.gram, lambda step: line(at - step))
    distance = at[anchor] - shard.start
    out = np.empty(len(shard.start), np.int64)
    for d in range(shard.window - shard.gram + 1):
        windows = np.flatnonzero(distance == d)
        match = anchor[windows]
        out[windows] = earliest((left[d][match], right[shard.window - 1 - d][match]), shard.rank[windows])
    return out


def without_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text``, and ``_n_lines``, ``_n_removed`` (long) besides.

    ``n_chars``, where there is such a column, follows a text that changed. A column of ``docs`` that is itself called
    ``_n_lines`` or ``_n_removed`` is kept in place of the count.
    """
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, removed = [], [], []
            for text, ranges in zip(batch.column("_text").to_pylist(), batch.column("_ranges").to_pylist()):
                lines = (text or "").split("\n")
                solid = [i for i, x in enumerate(lines) if x.strip(WHITE)]
                gone = {solid[i] for i in np.flatnonzero(covered(ranges, len(solid), min_lines)).tolist()}
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
                totals.append(len(solid))
                removed.append(len(gone))
            yield pa.record_batch({"_row": batch.column("_row"), "_new": pa.array(texts, pa.string()),
                                   "_n_lines": pa.array(totals, pa.int64()), "_n_removed": pa.array(removed, pa.int64())})

    found = removed_spans(docs, min_lines, 1, winnowing_matches, lines=True, whole_rows=True).select("_row", "_text", "_ranges")
    schema = T.StructType([found.schema["_row"], T.StructField("_new", T.StringType()),
                           T.StructField("_n_lines", T.LongType()), T.StructField("_n_removed", T.LongType())])
    built = found.mapInArrow(rebuild, schema)

    def column(c: str):
        if c == "text":
            return F.col("_new").alias(c)
        if c == "n_chars":
            return F.when(F.col("_n_removed") > 0, F.length("_new").cast(docs.schema[c].dataType)).otherwise(F.col("_row.n_chars")).alias(c)
        return F.col(f"_row.`{c}`").alias(c)

    counts = [c for c in ("_n_lines", "_n_removed") if c not in docs.columns]
    return built.select(*[column(c) for c in docs.columns], *counts)
