"""Packing by concatenate and cut: documents in stored order become one stream of token ids, cut every ``LENGTH`` ids.

Pass 1 tokenizes each document once and writes the ids with the number of ids before it in its run, a run
being rows that one task reads in a row. Prefix sums over the runs' totals then give each run its
place in the stream, and pass 2 cuts every document at the borders it crosses. A piece is the boundary record
of its cut: sequence, offset there, and its place in its document. No sequence has padding but the last, and that
none where its fill is a power of two.

Ids are those of a tokenizers file as its library gives them: an added token in the text is that token.

A null text counts as empty; every document, empty ones too, ends in ``END_ID`` and so has a piece. Rows that
repeat, or that lack an id, are packed like any other, and so are those of a file that is read twice. Texts may be of any length;
one is held by its task as a whole. Columns other than doc_id and text are not read, so their names do not matter. An empty
table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from stayledger.functions.sizing import small
from stayledger.llm.batches import bound_batches
from stayledger.llm.tokens import slices
from stayledger.session import fresh_path

LENGTH, END_ID = 1024, 0
VOCABULARY = "byte_bpe_50k.json"
#: Rows that may be missing within a run (filtered out); a larger gap starts a new one.
GAP = 1024
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Token ids of texts, as little-endian bytes: two to an id where the vocabulary allows.

    Where the file is a byte-level BPE whose ids follow the order of its merges, tiktoken does the merging, which
    gives the same ids in less time; other files go to their own library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.ranked = _ranked(path)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per worker process."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.ranked is not None:
            # The few texts with an added token in them are left to the library.
            found = (self.tokenizer.encode(x, add_special_tokens=False).ids if any(a in x for a in self.added) else self.ranked.encode_ordinary(x)
                     for x in texts)
        else:
            found = (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))
        return [np.array(x, self.kind).tobytes() for x in found]


def _ranked(path: str) -> tiktoken.Encoding | None:
    """The tokenizer file as ranks, if it is a plain byte-level BPE with ids in the order of its merges."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel" \
        and before.get("use_regex") and not before.get("add_prefix_space") \
        and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain:
        return None
    vocabulary = model["vocab"]
    merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    # Byte-level files write each byte as one printable character: itself, or one from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _stored(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of each row: file and row for a scan of files, else partition and row."""
    try:
        return docs.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")})
    except AnalysisException:
        return docs.withColumns({"_file": F.lit(""), "_at": F.monotonically_increasing_id()})


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``length`` ids.

    doc_id, start (ids of its document before it), length, ids_crc32 (of little-endian unsigned 32-bit ids),
    doc_tokens, sequence_id, offset, sequence_length (padding included); with ``with_ids`` the ids.
    """
    bound_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path(VOCABULARY)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        end = np.array([end_id], encoder.kind).tobytes()
        # A run is known by its task and its number there: a file that is read twice has the same rows in several.
        task, run, first, before, last = TaskContext.get().partitionId(), -1, 0, 0, None
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [x + end for x in encoder.ids(part.column("text").fill_null("").to_pylist())]
                runs, firsts, starts = [], [], []
                for file, at, x in zip(part.column("_file").to_pylist(), part.column("_at").to_pylist(), ids):
                    if last is None or file != last[0] or not 0 < at - last[1] <= GAP:
                        run, first, before = run + 1, at, 0
                    last = file, at
                    runs.append(run)
                    firsts.append(first)
                    starts.append(before)
                    before += len(x) // encoder.width
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "file": part.column("_file"), "first": pa.array(firsts, pa.int64()),
                    "task": pa.array([task] * len(runs), pa.int64()), "run": pa.array(runs, pa.int64()),
                    "before": pa.array(starts, pa.int64()), "n": pa.array([len(x) // encoder.width for x in ids], pa.int64()),
                    "ids": pa.array(ids, pa.binary())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                n, place = np.asarray(part.column("n")), np.asarray(part.column("place"))
                first, last = place // length, (place + n - 1) // length
                count = last - first + 1
                row = np.repeat(np.arange(len(n)), count)
                sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                begin = np.maximum(sequence * length, place[row])
                stop = np.minimum((sequence + 1) * length, (place + n)[row])
                raw = part.column("ids").to_pylist()
                width = len(raw[0]) // int(n[0])
                wide = [np.frombuffer(x, f"<u{width}").astype("<u4") for x in raw]
                taken = [wide[r][a:b] for r, a, b in zip(row.tolist(), (begin - place[row]).tolist(), (stop - place[row]).tolist())]
                out = {"doc_id": part.column("doc_id").take(pa.array(row)), "start": pa.array(begin - place[row]),
                       "length": pa.array(stop - begin), "ids_crc32": pa.array([zlib.crc32(x) for x in taken], pa.int64()),
                       "doc_tokens": pa.array(n[row]), "sequence_id": pa.array(sequence), "offset": pa.array(begin - sequence * length)}
                if with_ids:
                    out["ids"] = pa.array([x.astype(np.int32) for x in taken], pa.list_(pa.int32()))
                yield pa.record_batch(out)

    rows = _stored(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_file", "_at")
    encoded = rows.mapInArrow(encode, "doc_id long, file string, first long, task long, run long, before long, n long, ids binary")
    place = fresh_path(docs.sparkSession, "packing-ids")
    encoded.write.option("compression", "zstd").parquet(place)
    ids = docs.sparkSession.read.schema(encoded.schema).parquet(place)
    totals = ids.groupBy("task", "run").agg(F.min("file").alias("file"), F.min("first").alias("first"), F.sum("n").alias("total"))
    # As many rows as tasks and files, not as documents: one task adds them up.
    order = Window.orderBy("file", "first", "task", "run").rowsBetween(Window.unboundedPreceding, -1)
    runs = totals.select("task", "run", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("_runs_before"))
    all_ids = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    placed = ids.join(small(runs), ["task", "run"]).select("doc_id", "n", "ids", (F.col("_runs_before") + F.col("before")).alias("place"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    found = placed.mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))
    rest = all_ids % length
    last_length = rest if rest and rest & (rest - 1) == 0 else length
    return found.withColumn("sequence_length", F.when(F.col("sequence_id") == all_ids // length, F.lit(last_length))
                            .otherwise(F.lit(length)).cast("long"))


def sequences(docs: DataFrame, length: int = LENGTH, pad_id: int = 0, **options) -> DataFrame:
    """The packed sequences: sequence_id, ids (padded), doc_ids in order. A sequence gathers at most ``length`` pieces."""
    parts = pieces(docs, length, with_ids=True, **options)
    gathered = parts.groupBy("sequence_id", "sequence_length").agg(
        F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    ids = F.flatten(F.col("parts.ids"))
    padding = F.array_repeat(F.lit(pad_id), (F.col("sequence_length") - F.size(ids)).cast("int"))
    return gathered.select("sequence_id", F.concat(ids, padding).alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
