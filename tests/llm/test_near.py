"""HyperMinHash near-dedup against all pairs on small corpora, and its parts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brute import words
from stayledger.llm import graph, hyperminhash as hmh


def shingles(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), i == find(i)) for i, s in sets)


def corpus(seed):
    """Chains of texts each changed a little from the one before, so that the ends of a chain are not linked directly."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(12):
        text = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 5, 14, 60, 200, 700]))]
        for _ in range(rnd.randrange(1, 14)):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(rnd.randrange(3)):
                text[rnd.randrange(len(text))] = f"v{rnd.randrange(10**6)}"
    rows += [None, "", "  \n", "One two", "one  TWO", "ÀB c", "àb c"]
    rnd.shuffle(rows)
    return [(7 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [128, 2])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(hmh, "BLOCK", block)
    rows = corpus(seed)
    got = hmh.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_lower_threshold(spark):
    assert [hmh.bands_for(p) for p in (100, 85, 80)] == [1, 36, 63]
    rows = corpus(4)
    got = hmh.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 80).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 80)


def test_one_large_group(spark):
    """Hundreds of variants of one text, at the threshold from each other, and many copies of one of them."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(240):
        t = list(base)
        for _ in range(rnd.randrange(1, 6)):
            t[rnd.randrange(300)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, rows[17][1]) for i in range(200)]
    got = hmh.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_edge_rows(spark):
    """Null ids stay; rows that share an id are one node; clashing names; an empty table."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(None, a), (None, None), (1, a), (2, b), (3, a), (3, b), (3, b), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "label": F.lit("x"), "_row": F.lit(2), "a": F.lit(3)})
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in hmh.near_groups(docs).collect()}
    assert got[None, 36] == (None, True) and got[None, 0] == (None, True) and got[4, 0] == (4, True)
    assert got[1, 36] == (1, True) and got[2, 36] == (1, False) and got[3, 36] == (1, False)
    kept = hmh.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.where("text is not null").collect()) == [("1", a), ("None", a)] and kept.count() == 4
    assert hmh.near_groups(docs.limit(0)).count() == 0


def test_registers():
    values = np.array([0, 1, 2, 3, 2**53 - 1, 2**53 + 1, 2**63 - 1, 2**63, 2**64 - 1, 2**64 - 2**11, 0x00F0000000000000], np.uint64)
    for v, got in zip(values.tolist(), hmh.registers(values).tolist()):
        top = max(v.bit_length() - 1, 0)
        below = v - (1 << top) if v else 0
        mantissa = below >> (top - 10) if top >= 10 else below << (10 - top)
        assert got == (63 - top) << 10 | mantissa, v


def test_estimate():
    """The estimate follows the Jaccard similarity within a few standard errors."""
    rnd = np.random.default_rng(0)
    for share in (0.0, 0.3, 0.7, 0.85, 0.95):
        n = 4000
        common = int(2 * n * share / (1 + share))
        texts = [" ".join(map(str, x)) for x in (rnd.integers(0, 2**60, n), rnd.integers(0, 2**60, n))]
        a, b = (t.split() for t in texts)
        b[:common] = a[:common]
        owner, hashes = hmh.shingle_sets(pa.array([" ".join(a), " ".join(b)]))
        x, y = (set(hashes[owner == i].tolist()) for i in (0, 1))
        real = len(x & y) / len(x | y)
        sketch = hmh.sketches(owner, hashes)
        got = hmh.estimated((sketch[0] == sketch[1]).mean(), np.float64(len(x)), np.float64(len(y)))
        assert abs(got - real) < 0.12


def test_components(spark):
    rnd = random.Random(9)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 400), (400, 450), (7, 7)] \
        + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)]
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x != r}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
