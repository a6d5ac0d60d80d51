"""Connected components of a graph given as pairs of whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stayledger.sources.tables import materialize


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first())


def components(pairs: DataFrame) -> DataFrame:
    """(node, label) for each node of ``pairs`` (a, b) that is not the smallest of its component, which is the label.

    Alternates two star operations until the edges stay the same: each node's larger neighbours move to its
    smallest neighbour, then its smaller neighbours do. Every round is written, so lineage does not
    grow; hubs meet their smallest neighbour through a reduced join that splits skewed keys.
    """
    edges = materialize(_edges(pairs), "components")
    state = _state(edges)
    while True:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(
            edges.select(F.col("v").alias("n"), F.col("u").alias("x")))
        least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("x > n").join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "components")
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
