"""The registered queries against their SQL, the pipeline against its operators, and the guard around the subpackage."""


from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from brute import repeated, solid_lines
from stayledger.llm import hyperminhash, packing, pfair, quality, queries, warc
from test_exact_pack import check_pieces
from test_near import brute

from compare import connect, differences  # noqa: E402


@pytest.fixture(scope="module")
def con(small_folder):
    return connect(small_folder)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_against_sql(spark, con, small_folder, name):
    assert differences(queries.queries()[name](spark, small_folder), con, queries.SQL[name]) is None


def test_registered():
    names = __spark_entry__.queries()
    assert all(sum(x.startswith(f"op{n}_") for x in names) == 1 for n in range(1, 14))
    assert "pipeline" in names and set(queries.SQL) <= set(__spark_entry__.oracle_sql())


def stage_by_stage(spark, docs, folder):
    """Each stage's rows checked against a plain version on the stage's own input."""
    kept = corpus_pipeline.keep_quality(spark, docs, folder)
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = quality.scored(docs, model)
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(r._row) for r in scores.collect() if r._score >= 0.3)
    rows = kept.orderBy("doc_id").collect()
    lined = corpus_pipeline.drop_lines(spark, kept, folder)
    lists = [solid_lines(r.text) for r in rows]
    got = {r.doc_id: r for r in lined.collect()}
    for r, lines, gone in zip(rows, lists, repeated(lists, 3)):
        assert solid_lines(got[r.doc_id].text) == [x for x, g in zip(lines, gone) if not g]
        assert (got[r.doc_id].lang, got[r.doc_id].source) == (r.lang, r.source)
    single = corpus_pipeline.drop_near_copies(spark, lined, folder)
    want = {i for i, _, _, stays in brute([(r.doc_id, r.text) for r in got.values()], corpus_pipeline.NEAR_PERCENT) if stays}
    assert {r.doc_id for r in single.collect()} == want and single.count() == len(want)
    mixed = corpus_pipeline.mix_sources(spark, single, folder)
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter(want)
    return mixed


def test_pipeline(spark, small_folder, tmp_path):
    docs = spark.read.parquet(f"{small_folder}/documents.parquet")
    mixed = stage_by_stage(spark, docs, small_folder)
    mixed.write.parquet(str(tmp_path / "mixed"))
    stored = spark.read.parquet(str(tmp_path / "mixed"))
    rows = [(r.doc_id, r.text) for r in stored.collect()]
    pieces = corpus_pipeline.pack(spark, stored, small_folder).collect()
    check_pieces(rows, pieces, 1024)
    # The stream follows the mix.
    order = [r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    mix = pfair.mixed(corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_lines(
        spark, corpus_pipeline.keep_quality(spark, docs, small_folder), small_folder), small_folder)).collect()
    assert order == [r._row.doc_id for r in sorted(mix, key=lambda r: (r._slot, r._place))]
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, small_folder).collect()) == Counter(r.doc_id for r in pieces)


def test_pipeline_edge_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, extra columns and an empty table go through every stage."""
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, label int"
    rows = [(None, None, None, None, None, None, None), (1, "a b c\nd\ne\nf", "en", "s", 5, "r", 1), (1, "a b c\nd\ne\nf", "en", "s", 5, "r", 1),
            (2, "", "en", None, 0, "r", 1), (3, "x\ny\nz\nw " * 3000, "en", "s", 9, None, None), (4, "a b c\nd\ne\nf", "en", "t", 5, "r", 1)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = stage(spark, docs, folder)
            path = f"{folder}/{name}-{table.count()}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
            assert name == "packing" or docs.columns == before
        assert (docs.count() > 0) == (table.count() > 0)
