"""Exact top-k by inner product with a dual-tree search over cover trees.

Vectors become whole numbers, floor(``SCALE`` * x). A bounded sample of vectors serves as pivots; each vector joins the
group of its nearest pivot, and groups are cut into blocks of about ``BLOCK`` vectors. The queries of a
group are cut into blocks as well.

1. Each query is scored against its own block, which gives a first worst kth score per query.
2. A query block visits only groups whose pivot and covering radius allow a score as high as the worst kth of one of its queries.
3. Where a query block meets a data block, both have a cover tree: nested centers with halving radii. Pairs of nodes are
   pruned, level by level, when ``cq.cx + |cq| rx + |cx| rq + rq rx`` is below the worst kth score of the query node; what is left is
   scored exactly.

Ties go to the smaller vec_id. Rows whose vector is null, or holds null or non-finite components, and rows without an id
take no part. Vectors of different lengths do not meet. Rows that share an id count once, with their best score, and
never answer a query of that id. Scores are exact for components of any size; one that does not fit 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from stayledger.sources.tables import materialize

K, SCALE, EVERY = 20, 64, 20
PIVOTS, BLOCK, QUERIES = 64, 256, 64
LEVELS = 4
_EXACT = 2.0 ** 53


class CoverTree:
    """Nested levels of centers over a few vectors; a level halves the radius of the one before."""

    def __init__(self, points: np.ndarray, levels: int = LEVELS) -> None:
        squares = (points * points).sum(axis=1)
        gaps = distances(points, points)
        self.points, self.norms = points, np.sqrt(squares)
        centers = [0]
        nearest, owner = gaps[0].copy(), np.zeros(len(points), np.int64)
        reach = nearest.max()
        #: For each level: center rows, each point's center, covering radius of each center.
        self.levels = [(np.array([0]), owner.copy(), np.array([reach]))]
        for _ in range(levels):
            reach /= 2
            while len(centers) < len(points) and nearest.max() > reach:
                new = int(nearest.argmax())
                closer = gaps[new] < nearest
                owner[closer] = len(centers)
                nearest = np.where(closer, gaps[new], nearest)
                centers.append(new)
            radius = np.zeros(len(centers))
            np.maximum.at(radius, owner, nearest)
            self.levels.append((np.array(centers), owner.copy(), radius))
            if reach == 0 or len(centers) == len(points):
                break

    def nodes(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.levels[min(level, len(self.levels) - 1)]


def dual_search(queries: CoverTree, data: CoverTree, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, data row and score of all pairs that reach the worst kth score of their query."""
    alive = np.ones((len(queries.points), len(data.points)), bool)
    for level in range(max(len(queries.levels), len(data.levels))):
        (cq, of_q, rq), (cx, of_x, rx) = queries.nodes(level), data.nodes(level)
        need = np.full(len(cq), np.inf)
        np.minimum.at(need, of_q, worst)
        bound = queries.points[cq] @ data.points[cx].T + np.outer(queries.norms[cq], rx) + np.outer(rq, data.norms[cx]) + np.outer(rq, rx)
        # Products of large numbers are rounded; the bound is raised by more than that.
        reach_q, reach_x = queries.norms[cq] + rq, data.norms[cx] + rx
        near = bound + 1e-9 * np.outer(reach_q, reach_x) + 1e-6 >= need[:, None]
        if not near.all():
            alive &= near[of_q[:, None], of_x]
            if not alive.any():
                none = np.zeros(0, np.int64)
                return none, none, none
    scores = inner(queries.points, data.points)
    # As doubles on both sides: rounding keeps the order.
    q, x = np.nonzero(alive & (scores.astype(np.float64) >= worst[:, None]))
    return q, x, _longs(scores[q, x])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all pairs, never too small: where squares are rounded, by the rounding's share of the lengths more."""
    one, two = (a * a).sum(axis=1), (b * b).sum(axis=1)
    gaps = np.sqrt(np.maximum(one[:, None] + two - 2 * a @ b.T, 0))
    largest = max(one.max(initial=0), two.max(initial=0))
    return gaps if 4 * largest < _EXACT else gaps + 1e-6 * np.sqrt(largest)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles while they are whole there, then in 64-bit integers, then in Python's."""
    most_a, most_b = np.abs(a).max(initial=0), np.abs(b).max(initial=0)
    if a.shape[1] * most_a * most_b < _EXACT:
        return a @ b.T
    if max(a.shape[1] * most_a * most_b, most_a, most_b) < 2.0 ** 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole_a, whole_b = (np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (a, b))
    return whole_a @ whole_b.T


def _longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and any(abs(s) >= 1 << 63 for s in scores):
        raise OverflowError("an inner product does not fit 64 bits")
    return scores.astype(np.int64)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, dim and the vector as packed doubles that are whole, of the rows that take part."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            sizes = np.asarray(pc.list_value_length(column).fill_null(0), np.int64)
            flat = column.flatten()
            values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
            values = np.floor(scale * values)
            bad = np.append(np.cumsum(~np.isfinite(np.asarray(flat.cast(pa.float64()).fill_null(np.nan)))), 0)
            ends = np.cumsum(sizes)
            wrong = bad[ends - 1] - np.where(ends > sizes, bad[ends - sizes - 1], 0) if len(flat) else np.zeros(len(sizes))
            keep = np.flatnonzero((sizes > 0) & (wrong == 0) & np.asarray(batch.column("vec_id").is_valid()))
            whole = values + 0.0
            packed = [whole[e - s:e].tobytes() for s, e in zip(sizes[keep].tolist(), ends[keep].tolist())]
            yield pa.record_batch({"vec_id": batch.column("vec_id").take(pa.array(keep)),
                                   "dim": pa.array(sizes[keep]), "vector": pa.array(packed, pa.binary())})

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) \
        .mapInArrow(pack, "vec_id long, dim long, vector binary")


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of each key, from rows sorted by key; in pieces of ``most`` rows, if given."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            for start in range(0, rows.num_rows, most or rows.num_rows):
                yield rows.slice(start, most or rows.num_rows)

    for batch in batches:
        place = np.stack([np.asarray(batch.column(k)) for k in keys])
        cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(k)[0] != part.column(k)[0] for k in keys):
                yield from flush()
                held = []
            if b > a:
                held.append(part)
    yield from flush()


def _packed(column: pa.Array) -> bytes:
    return b"".join(column.to_pylist())


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of each query, which are the rows with vec_id divisible by ``every``."""
    vectors = materialize(whole_vectors(embeddings, scale), "topk-vectors")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(pivots).collect()
    centers: dict[int, np.ndarray] = {}
    for row in sample:
        centers.setdefault(row.dim, []).append(np.frombuffer(row.vector, np.float64))
    centers = {dim: np.array(x) for dim, x in centers.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            group, gap = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                points = _vectors(batch.column("vector").take(pa.array(rows)))
                # A length that no pivot has is a group of its own around the origin.
                c = centers.get(dim, np.zeros((1, dim)))
                gaps = distances(points, c)
                group[rows], gap[rows] = gaps.argmin(axis=1), gaps.min(axis=1)
            yield pa.record_batch([*batch.columns, pa.array(group), pa.array(gap)], [*batch.schema.names, "group", "gap"])

    assigned = materialize(vectors.mapInArrow(assign, "vec_id long, dim long, vector binary, group long, gap double"), "topk-groups")
    shapes = assigned.groupBy("dim", "group").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect()
    blocks = {(r["dim"], r["group"]): (r["radius"], max(1, -(-r["n"] // block))) for r in shapes}
    # As many rows as pivots (and vector lengths): bounded by a parameter.
    table = embeddings.sparkSession.createDataFrame([(d, g, n) for (d, g), (_, n) in blocks.items()] or [(-1, -1, 1)], "dim long, group long, blocks long")
    cut = assigned.join(F.broadcast(table), ["dim", "group"]).select(
        "dim", "group", F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).alias("salt"), "vec_id", "vector")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ["dim", "group", "salt"]):
            ids, points = np.asarray(rows.column("vec_id")), _vectors(rows.column("vector"))
            asked = np.flatnonzero(ids % every == 0)
            worst = np.full(len(asked), -np.inf)
            if len(asked):
                scores = inner(points[asked], points).astype(np.float64)
                scores[ids[asked][:, None] == ids[None, :]] = -np.inf
                distinct = np.unique(ids, return_index=True)[1]  # a lower bound needs k different ids
                if len(distinct) > k:
                    worst = np.partition(scores[:, distinct], len(distinct) - k, axis=1)[:, len(distinct) - k]
            place = [rows.column(c)[0].as_py() for c in ("dim", "group", "salt")]
            kind = np.concatenate([[0], np.ones(len(asked), np.int32)])
            yield pa.record_batch({
                **{c: pa.array(np.full(len(kind), v)) for c, v in zip(("dim", "group", "salt"), place)},
                "kind": pa.array(kind.astype(np.int32)),
                "ids": pa.array([ids.tobytes(), *[ids[i].tobytes() for i in asked]], pa.binary()),
                "vectors": pa.array([_packed(rows.column("vector")), *[rows.column("vector")[i].as_py() for i in asked.tolist()]], pa.binary()),
                "worst": pa.array([None, *[x.tobytes() for x in worst]], pa.binary())})

    shape = "dim long, group long, salt long, kind int, ids binary, vectors binary, worst binary"
    packed = materialize(cut.repartition("dim", "group", "salt").sortWithinPartitions("dim", "group", "salt").mapInArrow(pack, shape), "topk-blocks")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ["dim", "group", "salt"], QUERIES):
            dim = rows.column("dim")[0].as_py()
            points = _vectors(rows.column("vectors"))
            worst = np.frombuffer(_packed(rows.column("worst")), np.float64)
            norms = np.sqrt((points * points).sum(axis=1))
            c = centers.get(dim, np.zeros((1, dim)))
            targets = []
            for g in range(len(c)):
                radius, count = blocks.get((dim, g), (0.0, 0))
                bound = points @ c[g] + norms * radius + 1e-9 * norms * (np.sqrt(c[g] @ c[g]) + radius) + 1e-6
                if count and (bound >= worst).any():
                    targets += [(g, s) for s in range(count)]
            payload = _packed(rows.column("ids")), _packed(rows.column("vectors")), worst.tobytes()
            for start in range(0, len(targets), 256):
                some = targets[start:start + 256]
                yield pa.record_batch({
                    "dim": pa.array([dim] * len(some), pa.int64()), "group": pa.array([g for g, _ in some], pa.int64()),
                    "salt": pa.array([s for _, s in some], pa.int64()), "kind": pa.array([1] * len(some), pa.int32()),
                    **{n: pa.array([v] * len(some), pa.binary()) for n, v in zip(("ids", "vectors", "worst"), payload)}})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tree, data_ids, known = None, None, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                here = tuple(batch.column(c)[i].as_py() for c in ("dim", "group", "salt"))
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                raw = batch.column("vectors")[i].as_py()
                if batch.column("kind")[i].as_py() == 0:
                    place, data_ids = here, ids
                    tree = CoverTree(np.frombuffer(raw, np.float64).reshape(len(ids), -1))
                    continue
                assert here == place, "a data block comes before its queries"
                if (asked := known.get(batch.column("ids")[i].as_py())) is None:
                    if len(known) > 500:
                        known.clear()
                    asked = known[batch.column("ids")[i].as_py()] = CoverTree(np.frombuffer(raw, np.float64).reshape(len(ids), -1))
                q, x, score = dual_search(asked, tree, np.frombuffer(batch.column("worst")[i].as_py(), np.float64))
                other = ids[q] != data_ids[x]
                q, x, score = q[other], x[other], score[other]
                order = np.lexsort((data_ids[x], -score, q))
                q, x, score = q[order], x[order], score[order]
                # Of one block at most k rows per query can matter; rows that share an id are counted later.
                first = np.arange(len(q)) - np.searchsorted(q, q) < (k if len(np.unique(data_ids)) == len(data_ids) else len(q))
                yield pa.record_batch({"query_id": pa.array(ids[q[first]]), "vec_id": pa.array(data_ids[x[first]]), "score": pa.array(score[first])})

    asked = packed.where("kind = 1").join(F.broadcast(table), ["dim", "group"]).withColumn(
        "salt", F.pmod(F.xxhash64("ids", "vectors"), F.ceil(F.col("blocks") * block / (every * QUERIES)).cast("long"))).drop("blocks")
    routed = asked.repartition("dim", "group", "salt").sortWithinPartitions("dim", "group", "salt").mapInArrow(route, shape)
    met = packed.where("kind = 0").unionByName(routed).repartition("dim", "group", "salt") \
        .sortWithinPartitions("dim", "group", "salt", "kind")
    hits = met.mapInArrow(search, "query_id long, vec_id long, score long")
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
