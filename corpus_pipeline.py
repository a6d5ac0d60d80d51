"""From raw documents to packed sequences: five stages, each an operator of ``stayledger.llm``.

A stage takes (spark, docs, folder) and gives the documents it keeps, with the columns of ``documents``; the last one
gives the pieces of the packed sequences. Each result is written as Parquet and read again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stayledger.llm import hyperminhash, line_winnow, packing, pfair, quality
from stayledger.sources.tables import materialize


#: Similarity in percent from which documents are near copies.
NEAR_PERCENT = 80


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of the documents at hand."""
    return quality.good_documents(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without runs of lines that occur earlier; a text may become empty."""
    return line_winnow.without_repeated_lines(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies, from a similarity of 0.8."""
    return hyperminhash.without_near_copies(docs, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents in the order of the mix, which the files keep and packing follows."""
    return pfair.interleaved(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of the sequences, with their ids."""
    return packing.pieces(docs, with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("packing", pack),
]

#: The classifier and the tokenizer cannot be stated in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, folder), "stage-" + name.replace(" ", "-"))
    return docs
