"""Member search: a weighted inverted index and trigram similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stayledger.functions.scalars import col

# The weight class of each searchable field.
FIELD_WEIGHTS = {"first_name": "A", "last_name": "A", "email": "B", "phone_e164": "B", "member_number": "B", "city": "C"}
WEIGHT_SCORES = {"A": 1.0, "B": 0.4, "C": 0.2}

# Fields whose value is one token; the others split at everything but letters and digits.
_WHOLE_FIELDS = ("email", "phone_e164")


def _lexemes(field: str, text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    if field in _WHOLE_FIELDS:
        return F.filter(F.array(F.trim(lowered)), lambda t: t != "")
    parts = F.filter(F.split(lowered, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    # A hyphenated word counts as a whole besides its parts.
    compounds = F.regexp_extract_all(lowered, F.lit(r"\p{L}[\p{L}\p{N}]*(?:-\p{L}[\p{L}\p{N}]*)+"), F.lit(0))
    return F.concat(parts, compounds)


def search_vector(members: DataFrame) -> Column:
    """The weighted lexemes of a member as an array of (lexeme, weight), without duplicates."""
    def weighted(field: str, weight: str) -> Column:
        return F.transform(_lexemes(field, F.col(field)),
                           lambda t: F.struct(t.alias("lexeme"), F.lit(weight).alias("weight")))

    return F.array_distinct(F.concat(*[weighted(f, w) for f, w in FIELD_WEIGHTS.items() if f in members.columns]))


def member_search_terms(members: DataFrame) -> DataFrame:
    """The inverted table: one row per member, lexeme and weight."""
    return members.select(F.col("id").alias("member_id"), "chain_group_id", F.inline(search_vector(members)))


def member_search(terms: DataFrame, query: str) -> DataFrame:
    """Members that hold every word of ``query``, with the summed weight of the words found.

    The words of the query become a filter on the inverted table, so a table stored by
    lexeme is read only where they occur.
    """
    words = sorted({w for w in query.lower().split() if w})
    if not words:
        raise ValueError("the query has no words")
    score = F.lit(0.0)
    for weight, value in WEIGHT_SCORES.items():
        score = F.when(F.col("weight") == weight, F.lit(value)).otherwise(score)
    # The best score per word in one aggregation; a member that lacks a word has no sum.
    best = [F.max(F.when(F.col("lexeme") == w, score)) for w in words]
    return terms.where(F.col("lexeme").isin(words)).groupBy("member_id", "chain_group_id") \
        .agg(F.round(sum(best[1:], best[0]), 4).alias("score")).where(F.col("score").isNotNull()) \
        .select("member_id", "chain_group_id", F.lit(len(words)).alias("words_found"), "score")


def trigrams(text: Column | str) -> Column:
    """Distinct three-letter pieces per word, each word padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pieces = F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) + 1),
        lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def fuzzy_members(members: DataFrame, query: str, min_sim: float = 0.3) -> DataFrame:
    """Members whose e-mail or full name is similar to ``query``; a scan without a shuffle.

    Similarity is the number of shared trigrams over the number of all trigrams of both
    texts. The trigrams of a field are formed once per row, in a step of their own.
    """
    asked = trigrams(F.lit(query))
    grams = members.select(F.col("id").alias("member_id"), "chain_group_id", "full_name", "email",
                           trigrams("email").alias("_email"), trigrams("full_name").alias("_name"))
    counted = grams.select("*", *[F.size(F.array_intersect(c, asked)).alias(f"{c}_shared") for c in ("_email", "_name")])

    def similar(c: str) -> Column:
        together = F.size(c) + F.size(asked) - F.col(f"{c}_shared")
        return F.when(together > 0, F.col(f"{c}_shared") / together).otherwise(F.lit(0.0))

    best = F.greatest(similar("_email"), similar("_name"))
    return counted.select("member_id", "chain_group_id", "full_name", "email", F.round(best, 6).alias("similarity")) \
        .where(F.col("similarity") >= min_sim)
