"""Exact top-k, mixing and the classifier."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayledger.llm import cover_tree, pfair, quality
from stayledger.llm.queries import op5_quality_classifier

VECTORS = "vec_id long, embedding array<float>"


def brute_top(rows, k, every, scale=64):
    whole = [(i, [math.floor(scale * np.float64(np.float32(x))) for x in v]) for i, v in rows
             if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in whole if i % every == 0}):
        best = {}
        for j, v in whole:
            for i, w in whole:
                if i == q and j != q and len(v) == len(w):
                    best[j] = max(best.get(j, -10**18), sum(a * b for a, b in zip(v, w)))
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, r, j, s) for r, (j, s) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("pivots,block", [(4, 16), (64, 256)])
def test_top_k(spark, pivots, block):
    rnd = np.random.default_rng(pivots)
    centers = rnd.normal(size=(6, 8)) * 3
    rows = [(int(i), (centers[rnd.integers(6)] + rnd.normal(size=8) * 0.2).astype(np.float32).tolist()) for i in rnd.permutation(260)]
    rows += [(300 + i, [0.5] * 8) for i in range(60)] + [(400, [0.0] * 8), (401, [1e6] * 8), (402, [-1e6] * 8)]
    rows += [(420, None), (440, []), (460, [1.0, None] * 4), (480, [float("nan")] * 8), (500, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(520, [1.0, 2.0]), (521, [3.0, 4.0]), (7, [0.1] * 8), (20, [0.2] * 8), (20, [0.2] * 8)]
    docs = spark.createDataFrame(rows, VECTORS).withColumns({"group": F.lit("g"), "salt": F.lit(1)}).repartition(3)
    got = cover_tree.top_k(docs, k=5, every=20, pivots=pivots, block=block)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 5, 20)
    assert cover_tree.top_k(docs.limit(0)).count() == 0


def test_top_k_of_large_numbers(spark):
    """Components of any size count in full; a score beyond 64 bits is an error."""
    rnd = random.Random(8)
    rows = [(20, [1.0, 0.0]), (1, [1e8, 0.0]), (2, [1e8 + 1, 0.0]), (3, [1e15, 1.0]), (4, [-1e15, 3.0]), (40, [1.0, -0.5])]
    rows += [(1001 + 20 * i, [rnd.choice([1, 1e3, 1e7, 1e9, 1e12]) * rnd.uniform(-1, 1) for _ in range(2)]) for i in range(80)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    want = []
    for q in sorted(i for i in whole if i % 20 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q))[:4]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    got = sorted(tuple(r) for r in cover_tree.top_k(docs, k=4, pivots=4, block=16).collect())
    assert got == want and (20, 1, 3, 4096 * 10**15) in got
    with pytest.raises(Exception, match="64 bits"):
        cover_tree.top_k(spark.createDataFrame([(20, [1e10, 1.0]), (1, [1e9, 1.0])], "vec_id long, embedding array<double>")).collect()


def test_dual_search_prunes_nothing_needed():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        q, x = (np.floor(rnd.normal(size=(n, 6)) * rnd.choice([3, 300])) for n in (rnd.integers(1, 30), rnd.integers(1, 200)))
        scores = q @ x.T
        worst = np.partition(scores, -min(3, len(x)), axis=1)[:, -min(3, len(x))]
        a, b, s = cover_tree.dual_search(cover_tree.CoverTree(q), cover_tree.CoverTree(x), worst)
        assert set(zip(a.tolist(), b.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(scores >= worst[:, None]))))
        assert (scores[a, b] == s).all()


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.98, "b": 0.019, "c": 0.001}, {s: 1.0 for s in "abcdefg"}])
def test_schedule_stays_within_a_block(weights):
    parts = pfair.parts_of(weights, 1000)
    assert sum(parts.values()) == 1000 and min(parts.values()) >= 1
    done = Counter()
    for t, (s, i, slot) in enumerate(pfair.schedule(parts), 1):
        assert slot == t - 1 and i == done[s]
        done[s] += 1
        assert all(abs(done[x] - t * parts[x] / 1000) < 1 for x in parts)
    assert done == parts


def test_mix(spark):
    rnd = random.Random(4)
    sources = ["hot"] * 700 + ["b"] * 200 + ["c"] * 90 + [None] * 40 + [""] * 30
    rows = [(i, f"t{i}", s) for i, s in enumerate(sources)] + [(5, "t5", "hot"), (None, None, "b")]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"_piece": F.lit(1), "_slot": F.lit("s"), "n": F.lit(2)})
    mix = pfair.mixed(docs.repartition(3), block=4).collect()
    assert Counter((r._row.doc_id, r._row.text) for r in mix) == Counter((i, t) for i, t, _ in rows)
    ranks = defaultdict(list)
    for r in mix:
        ranks[r._row.source].append((r._slot, r._place, r._source_rank))
    for s, found in ranks.items():
        found.sort()
        assert [r for _, _, r in found] == list(range(len(found)))
        assert all(place == rank % 4 for _, place, rank in found)
    slots = Counter((r._slot, r._row.source) for r in mix)
    assert len({s for s, _ in slots}) == len(slots) and max(slots.values()) <= 4
    parts = pfair.parts_of(pfair.tempered({pfair_key(s): n for s, n in Counter(r[2] for r in rows).items()}), pfair.PERIOD)
    balanced = sorted({(r._slot, r._row.source) for r in mix if r._balanced})
    assert [t for t, _ in balanced] == list(range(len(balanced))) and len(balanced) > 20
    done = Counter()
    for t, (_, s) in enumerate(balanced, 1):
        done[pfair_key(s)] += 1
        assert all(abs(done[x] - t * p / pfair.PERIOD) < 1 for x, p in parts.items())
    order = [(r.doc_id, r.text) for r in pfair.interleaved(docs, block=4).collect()]
    assert [source_of(rows, x) for x in order[:8]] == [r._row.source for r in sorted(mix, key=lambda r: (r._slot, r._place))][:8]
    assert pfair.interleaved(docs).columns == docs.columns
    assert pfair.mixed(docs.limit(0)).count() == 0 and pfair.interleaved(docs.limit(0)).count() == 0


def pfair_key(source):
    return "" if source is None else "=" + source


def source_of(rows, key):
    return next(s for i, t, s in rows if (i, t) == key)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = op5_quality_classifier(spark, folder).collect()
    assert len({r.doc_id for r in got}) == len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, y in held if y == v] for v in (1, 0))
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in bad] for a in good])
    assert auc > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.98 and np.mean([s >= 0.3 for s in bad]) < 0.2
    assert abs(np.mean([s for s, _ in held]) - np.mean([y for _, y in held])) < 0.03


def test_classifier_edge_rows(spark):
    rows = [(i, f"good words here number {i % 7}" if i % 2 else "JUNK!! JUNK!! ###", "x") for i in range(80)] + [(None, "text", None), (90, None, None), (91, "", "y"), (1, "again", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string").withColumn("_score", F.lit(3))
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (3, None), (999, 1), (5, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    again = quality.train(docs.repartition(5), labels.repartition(3))
    assert np.allclose(model.first, again.first)
    scores = quality.scored(docs, model).collect()
    assert len(scores) == len(rows) and all(0 <= r._score <= 1 for r in scores)
    by_id = {r._row.doc_id: r._score for r in scores}
    assert np.mean([by_id[i] for i in range(7, 80, 2)]) > np.mean([by_id[i] for i in range(6, 80, 2)]) + 0.5
    assert quality.good_documents(docs, labels).columns == docs.columns
    assert quality.train(docs, labels.limit(0)) == 0.5
    only = quality.train(docs, labels.where("quality = 1"))
    assert isinstance(only, float) and only > 0.9
    assert quality.good_documents(docs.limit(0), labels).count() == 0


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    rows = [(i, f"text {i} of some words") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, int(i % 3 > 0)) for i, _ in rows]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    assert turned != labels
    a, b = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, turned))
    assert np.array_equal(a.first, b.first) and a.temperature == b.temperature
