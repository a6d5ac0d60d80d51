"""The three repeat finders against a plain version, on small corpora with planted repeats."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from brute import repeated, runs, solid_lines, words
from stayledger.llm import fm_index, line_winnow, repeats, sparse_suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed, piece, count=60, vocabulary=40):
    """Texts made of own words and of a few shared passages, some cut short, some inside a monotonous text."""
    rnd = random.Random(seed)
    own = lambda n: [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]
    shared = [own(rnd.randrange(piece, 3 * piece)) for _ in range(5)]
    texts = []
    for _ in range(count):
        parts = []
        for _ in range(rnd.randrange(4)):
            parts += own(rnd.randrange(2 * piece))
            s = rnd.choice(shared)
            cut = rnd.randrange(len(s) // 2)
            parts += s[cut:] if rnd.random() < 0.5 else s
        texts.append(parts)
    texts += [["a"] * (4 * piece), ["b"] + ["a"] * (3 * piece), ["x", "y"] * (2 * piece), shared[0], shared[0], own(piece - 1)]
    rnd.shuffle(texts)
    return texts


def frame(spark, texts, parts=5):
    rows = [(i * 3, t, "en", "s", None) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.mark.parametrize("hot", [1000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_fm_index(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = [" \t".join(t) for t in corpus(seed, 20)] + [None, "", " \n "]
    got = {r.doc_id: r for r in fm_index.without_repeats(frame(spark, texts)).collect()}
    lists = [words(t) for t in texts]
    for i, (tokens, gone) in enumerate(zip(lists, repeated(lists, 20))):
        kept = " ".join(w for w, g in zip(tokens, gone) if not g)
        r = got[3 * i]
        assert (r.n_words, r.n_removed, r.kept_text) == (len(tokens), sum(gone), kept)
        assert r.kept_sha256 == sha256(kept.encode()).hexdigest()
    assert sum(r.n_removed for r in got.values()) > 500


@pytest.mark.parametrize("hot", [1000, 3])
@pytest.mark.parametrize("seed", [3, 4])
def test_sparse_suffix(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = [" ".join(t) for t in corpus(seed, 50, vocabulary=300)] + [None, "", "   "]
    docs = frame(spark, texts)
    lists = [words(t) for t in texts]
    masks = repeated(lists, 50)
    want = {(3 * i, a, n, " ".join(lists[i][a:a + n])) for i, m in enumerate(masks) for a, n in runs(m)}
    assert {tuple(r) for r in sparse_suffix.repeated_passages(docs).collect()} == want and len(want) > 20
    cut = {r.doc_id: r.text for r in sparse_suffix.without_passages(docs).collect()}
    for i, t in enumerate(texts):
        assert cut[3 * i] == (" ".join(w for w, g in zip(lists[i], masks[i]) if not g) if any(masks[i]) else t)


@pytest.mark.parametrize("hot", [1000, 2])
@pytest.mark.parametrize("seed", [5, 6])
def test_line_winnow(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rnd = random.Random(seed)
    texts = ["\n".join(rnd.choice([x, f"  {x}\r"]) + rnd.choice(["", "", "\n \t"]) for x in t)
             for t in corpus(seed, 4, vocabulary=30)] + [None, "", "\n\n"]
    docs = frame(spark, texts)
    lists = [solid_lines(t) for t in texts]
    got = {r.doc_id: r for r in line_winnow.without_repeated_lines(docs).collect()}
    for i, (tokens, gone) in enumerate(zip(lists, repeated(lists, 3))):
        r = got[3 * i]
        assert (r._n_lines, r._n_removed) == (len(tokens), sum(gone))
        assert solid_lines(r.text) == [x for x, g in zip(tokens, gone) if not g]
        if not any(gone):
            assert r.text == texts[i]
        else:
            assert r.n_chars == len(r.text)
    assert sum(r._n_removed for r in got.values()) > 100


def test_edge_rows(spark):
    """Null ids, repeated rows, equal ids with different texts, clashing column names, an empty table."""
    long = " ".join(f"w{i}" for i in range(70))
    rows = [(None, long), (None, None), (1, long), (1, long), (1, long + " x"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"anchor": F.lit(1), "shard": F.lit("s"), "_row": F.lit(2.0), "_ranges": F.lit(0), "range": F.lit(None).cast("string"),
         "_id": F.lit(3), "n": F.lit(4), "content": F.lit("c")})
    out = sorted(((r.doc_id, r.n_words, r.n_removed) for r in fm_index.without_repeats(docs).collect()),
                 key=lambda r: (r[0] is not None, r))
    assert out[:2] == [(None, 0, 0), (None, 70, 0)]
    # Rows that repeat both columns share a verdict; the null id comes first, so all later copies go.
    assert out[2:4] == [(1, 70, 70)] * 2 and out[4] == (1, 71, 70) and out[5] == (2, 0, 0)
    assert sparse_suffix.repeated_passages(docs).count() == 3
    lined = docs.withColumn("text", F.regexp_replace("text", " ", "\n"))
    kept = line_winnow.without_repeated_lines(lined)
    assert kept.columns[:-2] == docs.columns
    assert sorted(r._n_removed for r in kept.collect()) == [0, 0, 0, 70, 70, 70]
    empty = docs.limit(0)
    assert fm_index.without_repeats(empty).count() == 0
    assert sparse_suffix.repeated_passages(empty).count() == 0
    assert line_winnow.without_repeated_lines(empty).count() == 0


def test_line_dedup_with_columns_of_its_own_names(spark):
    """Columns called like the counts are kept as they are; a very long text is cut like any other."""
    run = "one\ntwo\nthree"
    filler = "\n".join(f"line {i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, run, "x", 7), (2, f"{filler}\n{run}", "y", 8), (3, None, None, None)], "doc_id long, text string, _n_lines string, _n_removed int")
    got = line_winnow.without_repeated_lines(docs)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} == {(1, run, "x", 7), (2, filler, "y", 8), (3, None, None, None)}


def test_very_long_text(spark):
    """A text beyond a slice and a shard, with a passage of another text in its middle."""
    rnd = random.Random(0)
    filler = [f"{rnd.getrandbits(40):x}" for _ in range(400_000)]
    passage = [f"p{i}" for i in range(120)]
    docs = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(filler[:200_000] + passage + filler[200_000:]))], "doc_id long, text string")
    assert {(r.doc_id, r.start_word, r.n_words) for r in sparse_suffix.repeated_passages(docs).collect()} == {(2, 200_000, 120)}
    assert {r.doc_id: r.n_removed for r in fm_index.without_repeats(docs).collect()} == {1: 0, 2: 120}
