"""MinHash near-dedup with HyperMinHash sketches.

A document's set is its distinct shingles of ``WORDS`` words, A-Z lowered (all its words, if fewer). Each bucket keeps the
least of its hash over the set, as the number of leading zeros and the ``MANTISSA`` bits after the leading one: 16 bits. ``ROWS``
buckets make a band, and the threshold gives the number of bands. Documents with equal sets form a class, and only classes go on.

1. Bands of registers are keys of buckets. Each class is paired with the smallest one it shares a bucket with. Pairs whose
   estimate of the Jaccard similarity, corrected for registers that agree by chance, lies far below the threshold go; the others
   are confirmed on their full sets. Confirmed pairs give components.
2. Where the smallest class of a bucket is in another component than a member, that pair is tried likewise.
3. A bucket whose other members are not all in one component by then is searched in blocks: pairs that cross components, and these
   alone, are estimated and confirmed inside the block. So every pair that shares a band is tried or already connected,
   members of one component are never paired up, and no row per pair is formed.

Two sets at the threshold t share none of b bands with probability (1 - t**8)**b, under ``MISSED``: 36 bands for 0.85, 63 for 0.8.

A null or empty text has an empty set and is linked with nothing. A null doc_id has no component and stays. Rows that share
an id are one node: what either text links to, both are linked to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stayledger.llm.batches import bound_batches
from stayledger.llm.graph import components
from stayledger.llm.tokens import Tokens, mix, range_hash, slices
from stayledger.sources.tables import materialize

WORDS, PERCENT = 5, 85
ROWS, MANTISSA = 8, 10
#: The most that banding may miss of pairs at the threshold.
MISSED = 1.1e-5
#: Estimates this far under the threshold are left out before confirmation: over seven standard errors.
MARGIN = 0.15
BLOCK = 512


def bands_for(percent: int) -> int:
    """The bands that find a pair at the threshold but for a share of ``MISSED``."""
    found = (percent / 100) ** ROWS
    return 1 if found >= 1 else math.ceil(math.log(MISSED) / math.log1p(-found))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, ordered by text: text numbers and hashes."""
    tokens = Tokens(texts, lower=True)
    hashes, whole = tokens.grams(WORDS)
    owner = tokens.text_of()[whole]
    size = np.diff(tokens.first)
    short = np.flatnonzero((size > 0) & (size < WORDS))
    owner = np.concatenate([owner, short])
    hashes = np.concatenate([hashes[whole], range_hash(tokens.hashes, tokens.first[short], tokens.first[short + 1])])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


def registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of bucket minima, in 16 bits."""
    top = np.frexp(least.astype(np.float64))[1].astype(np.int64) - 1
    top = np.clip(top, 0, 63)
    top -= (least >> top.astype(np.uint64)) == 0  # rounded up to the next power
    top = np.maximum(top, 0).astype(np.uint64)
    below = (least << (np.uint64(63) - top)) << np.uint64(1)
    return (((np.uint64(63) - top) << np.uint64(MANTISSA)) | (below >> np.uint64(64 - MANTISSA))).astype(np.uint16)


def sketches(owner: np.ndarray, hashes: np.ndarray, bands: int = bands_for(PERCENT)) -> np.ndarray:
    """Registers of each text that has a shingle, one row a text."""
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    factors = mix(np.arange(1, bands * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.empty((len(start), len(factors)), np.uint16)
    if len(start):
        product = np.empty_like(hashes)
        for bucket, factor in enumerate(factors):
            np.multiply(hashes, factor, out=product)
            out[:, bucket] = registers(np.minimum.reduceat(product, start))
    return out


def _bands(sketch: np.ndarray) -> np.ndarray:
    """The registers by row and band, four to a 64-bit number."""
    return np.ascontiguousarray(sketch).view(np.uint64).reshape(len(sketch), sketch.shape[1] // ROWS, ROWS // 4)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, from its eight registers and its number."""
    halves = _bands(sketch)
    keys = np.broadcast_to(np.arange(1, halves.shape[1] + 1, dtype=np.uint64), halves.shape[:2])
    for i in range(halves.shape[2]):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + halves[:, :, i])
    return keys


def estimated(matches: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the share of equal registers, less the collisions expected between unrelated sets."""
    ratio = size_a / size_b
    chance = 0.1699 * 2.0 ** -MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (matches - chance) / (1 - chance)


def _ints(column: pa.Array) -> np.ndarray:
    return np.asarray(column, np.int64)


def _sketch_rows(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.empty((0, ROWS), np.uint16)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def features(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128-bit hash of the set), sketch; the last three null for an empty set."""
    bands = bands_for(percent)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                owner, hashes = shingle_sets(part.column("text"))
                n = np.bincount(owner, minlength=part.num_rows)
                full = np.flatnonzero(n)
                start = np.flatnonzero(np.diff(owner, prepend=-1))
                sums = []
                for salt in (1, 2):
                    mixed = mix(hashes ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 2**64 - 1))
                    values = np.zeros(part.num_rows, np.uint64)
                    if len(full):
                        values[full] = np.add.reduceat(mixed, start)
                    sums.append(pa.array(values.view(np.int64), mask=n == 0))
                sketch: list[bytes | None] = [None] * part.num_rows
                for row, x in zip(full.tolist(), sketches(owner, hashes, bands)):
                    sketch[row] = x.tobytes()
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_shingles": pa.array(n.astype(np.int64)),
                                       "set_a": sums[0], "set_b": sums[1], "sketch": pa.array(sketch, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        build, "doc_id long, n_shingles long, set_a long, set_b long, sketch binary")


def band_table(classes: DataFrame) -> DataFrame:
    """key, node: one row per class and band."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                keys = band_keys(_sketch_rows(part.column("sketch")))
                yield pa.record_batch({"key": pa.array(keys.ravel().view(np.int64)),
                                       "node": pa.array(np.repeat(_ints(part.column("node")), keys.shape[1]))})

    return classes.select("node", "sketch").mapInArrow(explode, "key long, node long")


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate does not rule the link out."""
    least = percent / 100 - MARGIN

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                match = (_sketch_rows(part.column("sketch_a")) == _sketch_rows(part.column("sketch_b"))).mean(axis=1)
                near = estimated(match, _ints(part.column("n_a")), _ints(part.column("n_b"))) >= least
                yield part.select(["a", "b"]).filter(pa.array(near))

    side = lambda x: classes.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(keep, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of documents whose full sets reach the threshold."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in slices(batch, "text_a", 1 << 20):
                for part in slices(half, "text_b", 1 << 20):
                    n = part.num_rows
                    sets = [shingle_sets(part.column(c)) for c in ("text_a", "text_b")]
                    size = sum(np.bincount(o, minlength=n) for o, _ in sets)
                    owner, hashes = (np.concatenate(x) for x in zip(*sets))
                    order = np.lexsort((hashes, owner))
                    owner, hashes = owner[order], hashes[order]
                    twice = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
                    both = np.bincount(owner[1:][twice], minlength=n)
                    yield part.select(["a", "b"]).filter(pa.array((100 * both >= percent * (size - both)) & (both > 0)))

    pairs = materialize(pairs, "near-pairs")
    asked = materialize(pairs.select("a").union(pairs.select("b")).distinct(), "near-asked")
    texts = docs.select(F.col("doc_id").cast("long").alias("a"), "text").join(asked, "a", "left_semi")
    side = lambda x: texts.select(F.col("a").alias(x), F.col("text").alias(f"text_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return met.mapInArrow(check, "a long, b long")


def crossing_links(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) of classes of one bucket in different components, from (key, size, node, label, sketch, n_shingles, text).

    A bucket is cut into blocks of about ``BLOCK`` members, and each pair of blocks is a group of its own. Pairs are estimated
    and confirmed in the group, so that no row per pair is formed; a pair that shares several bands is taken in the first.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            place = np.stack([_ints(batch.column(c)) for c in ("key", "low", "high")])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(a, b - a)
                if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in ("key", "low", "high")):
                    yield group(held)
                    held = []
                held.append(part)
        if held:
            yield group(held)

    def group(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        node, label, block, n = (_ints(rows.column(c)) for c in ("node", "label", "block", "n_shingles"))
        low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        sketch = _sketch_rows(rows.column("sketch"))
        bands = _bands(sketch)
        here = int(np.flatnonzero(band_keys(sketch[:1])[0].view(np.int64) == rows.column("key")[0].as_py())[0])
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        sets: dict[int, np.ndarray] = {}

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_sets(rows.column("text").slice(i, 1))[1]
            return sets[i]

        found = []
        for i in left.tolist():
            others = right[label[right] != label[i]]
            if low == high:
                others = others[node[others] > node[i]]
            match = (sketch[others] == sketch[i]).mean(axis=1)
            others = others[estimated(match, n[others], n[i]) >= percent / 100 - MARGIN]
            earlier = (bands[others, :here] == bands[i, :here]).all(axis=2).any(axis=1)
            for j in others[~earlier].tolist():
                both = np.sort(np.concatenate([shingles(i), shingles(j)]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    found.append((node[i], node[j]))
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    cut = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "label", "block",
        "sketch", "n_shingles", "text")
    return spread.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high") \
        .mapInArrow(search, "a long, b long")


def _members(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, sketch, n_shingles and text of the given classes; a node whose id has several texts comes with each of them."""
    nodes = materialize(nodes, "near-asked")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")
    return texts.join(classes.select("node", "sketch", "n_shingles"), "node")


def _labelled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The bucket members with their component and that of their center."""
    of = lambda x, name: labels.select(F.col("node").alias(x), F.col("label").alias(name))
    met = shared.join(of("node", "label"), "node", "left").join(of("center", "center_label"), "center", "left")
    return met.withColumns({"label": F.coalesce("label", "node"), "center_label": F.coalesce("center_label", "center")})


def _joined_up(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components that more links make of known ones."""
    if links.isEmpty():
        return labels
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links))


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    bound_batches(docs.sparkSession)
    rows = materialize(features(docs, percent), "near-features")
    named = rows.where("doc_id is not null and n_shingles > 0")
    classes = materialize(named.groupBy("n_shingles", "set_a", "set_b").agg(
        F.min("doc_id").alias("node"), F.max("sketch").alias("sketch")), "near-classes")
    bands = band_table(classes)
    centers = bands.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("size")).where("size > 1")
    centers = materialize(centers, "near-centers")
    shared = materialize(bands.join(centers.hint("merge"), "key"), "near-buckets")
    texts = docs.where("doc_id is not null")

    def linked(pairs: DataFrame) -> DataFrame:
        return materialize(confirmed(_close(materialize(pairs, "near-pairs"), classes, percent), texts, percent), "near-links")

    first = shared.where("node != center").groupBy(F.col("node").alias("b")).agg(F.min("center").alias("a"))
    first = materialize(first.select("a", "b"), "near-pairs")
    labels = components(linked(first))
    apart = _labelled(shared, labels).where("label != center_label").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    labels = _joined_up(labels, linked(apart.join(first, ["a", "b"], "left_anti")))

    rest = _labelled(shared, labels)
    open_keys = rest.where("size > 2 and node != center").groupBy("key").agg(
        F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("key")
    open_keys = materialize(open_keys, "near-open")
    open_rows = materialize(rest.join(open_keys, "key").select("key", "size", "node", "label"), "near-open")
    members = _members(open_rows.select("node").distinct(), classes, texts)
    extra = materialize(crossing_links(open_rows.join(members, "node"), percent), "near-links")
    member = named.select("doc_id", "n_shingles", "set_a", "set_b").join(
        classes.select("n_shingles", "set_a", "set_b", "node"), ["n_shingles", "set_a", "set_b"]).select("doc_id", "node").distinct()
    member = materialize(member, "near-members")
    # Rows that share an id are one node, so their classes are linked too.
    lowest = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a != most")
    renamed = member.join(lowest, "doc_id").where("a != node").select("a", F.col("node").alias("b"))
    labels = _joined_up(labels, materialize(extra.unionByName(renamed), "near-links"))
    found = member.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label")).distinct()
    joined = rows.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: one document per group, rows without an id, and all without words."""
    gone = near_groups(docs, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return mine.join(gone, F.col("_row.doc_id") == F.col("_gone"), "left_anti").select("_row.*")
