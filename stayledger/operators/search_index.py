"""Stored search indexes over members: postings by word, and postings by three-letter piece.

Postings are rows of a stored table (``sources.merge``), sorted by word or piece, so its manifest says which files hold a word;
a search opens those alone. When members change, the postings that went and came are merged in, and files without any of
them stay. The indexes hold ids and weights only; what is shown of a member is joined to the few that are found.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stayledger.functions.sizing import tasks
from stayledger.operators.search import FIELD_WEIGHTS, WEIGHT_SCORES, member_search, member_search_terms, trigrams
from stayledger.sources import merge
from stayledger.sources.tables import materialize

#: Postings in a file; a search reads about one file per word.
FILE_ROWS = 500_000
#: Members whose postings one task forms, some twenty or thirty each, and members that are worth a task while cores are idle.
TASK_MEMBERS, LEAST_MEMBERS = 30_000, 3_000
_LAST = "\U0010ffff"


# --- words ------------------------------------------------------------------------

def _spread(members: DataFrame) -> DataFrame:
    """Members dealt out by their number: a file of a few megabytes, which one task reads, holds a million of them."""
    return members.repartition(tasks(members.sparkSession, members.count(), TASK_MEMBERS, LEAST_MEMBERS), *members.columns)


def _postings(members: DataFrame) -> DataFrame:
    used = members.select("id", "chain_group_id", *[c for c in FIELD_WEIGHTS if c in members.columns])
    return member_search_terms(_spread(used)).select("lexeme", "member_id", "chain_group_id", "weight")


def build_word_index(members: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    merge.create(_postings(members), path, ["lexeme", "member_id", "weight"], file_rows)


def update_word_index(before: DataFrame, after: DataFrame, path: str, file_rows: int = FILE_ROWS) -> merge.Merged:
    """Bring the index up to changed members: ``before`` and ``after`` hold the old and new rows of those alone."""
    return _replace(_postings(before), _postings(after), path, ["lexeme", "member_id", "weight"], file_rows)


def _replace(old: DataFrame, new: DataFrame, path: str, keys: list[str], file_rows: int) -> merge.Merged:
    """Delete the postings that only ``old`` has, write those that only ``new`` has."""
    sides = old.withColumn("_side", F.lit(-1)).unionByName(new.withColumn("_side", F.lit(1)))
    # Formed once, then dealt out by the number of rows, read twice in a task: postings are far larger in memory than in files.
    sides = materialize(sides, "postings")
    dealt = sides.repartition(tasks(sides.sparkSession, 2 * sides.count()), *keys)
    gone = dealt.groupBy(*keys).agg(F.max("_side").alias("_last")).where("_last < 0").select(*keys, F.lit(True).alias("_gone"))
    more = dealt.groupBy(*new.columns).agg(F.sum("_side").alias("_more")).where("_more > 0")
    came = more.select(*new.columns, F.explode(F.array_repeat(F.lit(False), F.col("_more").cast("int"))).alias("_gone"))
    return merge.merge(gone.unionByName(came, allowMissingColumns=True), path, keys, delete=F.col("_gone"), file_rows=file_rows)


def indexed_search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """As ``search.member_search``, from the files that hold the words of ``query``."""
    words = sorted({w for w in query.lower().split() if w})
    if not words:
        raise ValueError("the query has no words")
    return member_search(merge.read_ranges(spark, path, "lexeme", [(w, w) for w in words]), query)


def prefix_search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Members that hold a word for every word of ``query`` that begins with it: member_id, chain_group_id, score.

    A prefix counts by the best weight among the words it meets.
    """
    prefixes = sorted({w for w in query.lower().split() if w})
    if not prefixes:
        raise ValueError("the query has no words")
    rows = merge.read_ranges(spark, path, "lexeme", [(p, p + _LAST) for p in prefixes])
    score = reduce(lambda found, w: F.when(F.col("weight") == w, F.lit(WEIGHT_SCORES[w])).otherwise(found), WEIGHT_SCORES, F.lit(0.0))
    best: list[Column] = [F.max(F.when(F.col("lexeme").startswith(p), score)) for p in prefixes]
    return rows.groupBy("member_id", "chain_group_id").agg(F.round(sum(best[1:], best[0]), 4).alias("score")).where(F.col("score").isNotNull())


# --- pieces of three letters ------------------------------------------------------

#: The fields that are compared by their pieces.
FIELDS = ("email", "full_name")


def _pieces(members: DataFrame) -> DataFrame:
    """One row per piece of a field: gram, member_id, field, and the number of pieces of that field."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), trigrams(f).alias("grams")) for f in FIELDS]))
    rows = _spread(members.select("id", "chain_group_id", *FIELDS)).select(F.col("id").alias("member_id"), "chain_group_id", fields.alias("f"))
    return rows.select(F.explode("f.grams").alias("gram"), "member_id", "chain_group_id", F.col("f.field").alias("field"), F.size("f.grams").alias("n"))


def build_gram_index(members: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    merge.create(_pieces(members), path, ["gram", "member_id", "field"], file_rows)


def update_gram_index(before: DataFrame, after: DataFrame, path: str, file_rows: int = FILE_ROWS) -> merge.Merged:
    return _replace(_pieces(before), _pieces(after), path, ["gram", "member_id", "field"], file_rows)


def _least_shared(n: Column, other: Column, min_sim: float) -> Column:
    """Shared pieces that two fields of these sizes need for a similarity of ``min_sim``."""
    return F.ceil(F.lit(min_sim) * (n + other) / F.lit(1 + min_sim) - F.lit(1e-9))


def indexed_fuzzy(members: DataFrame, path: str, query: str, min_sim: float = 0.3) -> DataFrame:
    """As ``search.fuzzy_members``, from the postings of the query's pieces.

    A field that shares too few pieces, or has too many or too few of its own, is dropped by counting; the similarity of those
    that are left follows from the counts, and only these members are read.
    """
    spark = members.sparkSession
    grams = [g for g in spark.range(1).select(trigrams(F.lit(query)).alias("g")).first().g]
    asked = len(grams)
    if not grams:
        raise ValueError("the query has no letters")
    rows = merge.read_ranges(spark, path, "gram", [(g, g) for g in grams])
    near = rows.where((F.col("n") >= math.ceil(min_sim * asked - 1e-9)) & (F.col("n") <= math.floor(asked / min_sim + 1e-9)))
    shared = near.groupBy("member_id", "field", "n").agg(F.count("*").alias("shared"))
    kept = shared.where(F.col("shared") >= _least_shared(F.col("n"), F.lit(asked), min_sim))
    similarity = F.max(F.col("shared") / (F.col("n") + F.lit(asked) - F.col("shared")))
    found = kept.groupBy("member_id").agg(F.round(similarity, 6).alias("similarity")).where(F.col("similarity") >= min_sim)
    shown = members.select(F.col("id").alias("member_id"), "chain_group_id", "full_name", "email")
    return shown.join(found, "member_id")


def fuzzy_pairs(members: DataFrame, field: str = "full_name", min_sim: float = 0.8) -> DataFrame:
    """Pairs of distinct texts of a field that are similar, without comparing all pairs: text, other, similarity.

    Equal texts are one. Each text shows its rarest pieces only, as many as it must have one of in common with any similar text;
    two texts that share such a piece and whose sizes allow it are compared in full. Members are joined to the texts by
    the caller.
    """
    texts = members.select(F.col(field).alias("text")).where(F.col(field).isNotNull()).distinct() \
        .select("text", trigrams("text").alias("grams")).where(F.size("grams") > 0).withColumn("n", F.size("grams"))
    rows = texts.select("text", "n", F.explode("grams").alias("gram"))
    counts = rows.groupBy("gram").agg(F.count("*").alias("texts"))
    ranked = rows.join(counts, "gram").groupBy("text", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "gram"))).alias("by_rarity"))
    length = (F.col("n") - F.ceil(F.lit(min_sim) * F.col("n") - F.lit(1e-9)) + 1).cast("int")
    shown = ranked.select("text", "n", F.explode(F.slice(F.col("by_rarity.gram"), F.lit(1), length)).alias("gram"))
    other = shown.select(F.col("text").alias("other"), F.col("n").alias("m"), F.col("gram").alias("other_gram"))
    sizes = (F.col("n") >= F.lit(min_sim) * F.col("m") - 1e-9) & (F.col("m") >= F.lit(min_sim) * F.col("n") - 1e-9)
    pairs = shown.join(other, (F.col("gram") == F.col("other_gram")) & (F.col("text") < F.col("other")) & sizes).select("text", "other").distinct()
    first, second = trigrams("text"), trigrams("other")
    compared = pairs.select("text", "other", F.size(F.array_intersect(first, second)).alias("shared"), (F.size(first) + F.size(second)).alias("both"))
    return compared.select("text", "other", F.round(F.col("shared") / (F.col("both") - F.col("shared")), 6).alias("similarity")) \
        .where(F.col("similarity") >= min_sim)
