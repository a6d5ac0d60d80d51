"""Earning rules as an index of bitmaps.

The active rules of a program stand in order of precedence and are numbered. Every value that a rule asks of a field has a
bitmap of the rules that accept it, those open to any value included; all other values share the bitmap of the open rules.
A bitmap is kept as rows of 64 bits, empty words left out. The rules of a booking are then the AND of one bitmap per field,
and the first of them in force on its day applies.

Bookings take few combinations of program, hotel, segment, rate group and channel. The AND is formed once per combination,
by joins on (program, field, value) whose number does not depend on the number of rules; a booking looks its combination up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stayledger.functions.sizing import small

#: The fields a rule may ask for, hotel first.
FIELDS = ("hotel_id", "market_segment_code", "rate_group_code", "channel")


def _coded(field: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(field).cast("string")), F.lit("none"))


def ordered(rules: DataFrame) -> DataFrame:
    """Active rules with their place in the precedence of their program, from 0.

    Hotel rules come first, then those with a segment, then the higher priority and the lower id.
    """
    best = Window.partitionBy("program_id").orderBy(F.col("hotel_id").isNull(), F.col("market_segment_code").isNull(), F.desc("priority"), "id")
    return rules.where("is_active").withColumn("place", F.row_number().over(best).cast("long") - 1)


def bitmaps(placed: DataFrame) -> DataFrame:
    """program_id, field, value, word, bits: the rules that accept a value; ``value`` is "other" for all that no rule names."""
    bit = placed.withColumn("word", F.expr("place div 64")).withColumn("bit", F.expr("shiftleft(1L, cast(place % 64 as int))"))
    asked = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), _coded(f).alias("value")) for f in FIELDS]))
    rows = bit.select("program_id", "word", "bit", asked)
    own = rows.where("value <> 'none'").groupBy("program_id", "field", "value", "word").agg(F.bit_or("bit").alias("bits"))
    free = rows.where("value = 'none'").groupBy("program_id", "field", "word").agg(F.bit_or("bit").alias("bits"))
    named = own.select("program_id", "field", "value").distinct()
    open_too = named.join(free, ["program_id", "field"])
    per_value = own.unionByName(open_too).groupBy("program_id", "field", "value", "word").agg(F.bit_or("bits").alias("bits"))
    return per_value.unionByName(free.withColumn("value", F.lit("other")))


def candidates(combinations: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules that accept each combination, as the array ``_rules`` in order of precedence."""
    placed = ordered(rules)
    index = bitmaps(placed)
    named = index.where("value <> 'other'").select("program_id", "field", "value").distinct().withColumn("named", F.lit(True))
    asked = combinations.select("*", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("value")) for f in FIELDS])))
    known = asked.join(named, ["program_id", "field", "value"], "left") \
        .withColumn("value", F.when(F.col("named"), F.col("value")).otherwise("other")).drop("named")
    keys = ["program_id", *[f"_{f}" for f in FIELDS]]
    met = known.join(index, ["program_id", "field", "value"]).groupBy(*keys, "word") \
        .agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n")).where((F.col("n") == len(FIELDS)) & (F.col("bits") != 0))
    places = met.select(*keys, F.explode(F.expr("filter(sequence(0, 63), i -> (bits & shiftleft(1L, i)) <> 0)")).alias("bit"), "word") \
        .select(*keys, (F.col("word") * 64 + F.col("bit")).alias("place"))
    entry = F.struct("place", "id", "valid_from", "valid_to", "percent_of_payment", F.map_entries("tier_multiplier_override").alias("overrides"))
    found = places.join(placed.select("program_id", "place", entry.alias("entry")), ["program_id", "place"])
    return found.groupBy(*keys).agg(F.sort_array(F.collect_list("entry")).alias("_rules"))


def rule_by_index(bookings: DataFrame, rules: DataFrame, on_date: str) -> DataFrame:
    """``bookings`` with the rule that applies to each as the struct ``_rule``, null where none does."""
    keys = {f"_{f}": _coded(f) for f in FIELDS}
    coded = bookings.withColumns(keys)
    combinations = coded.select("program_id", *keys).where(F.col("program_id").isNotNull()).distinct()
    lists = small(candidates(combinations, rules))
    on = F.col(on_date)
    in_force = F.filter("_rules", lambda r: (r["valid_from"] <= on) & (r["valid_to"].isNull() | (on <= r["valid_to"])))
    return coded.join(lists, ["program_id", *keys], "left").withColumn("_rule", F.get(in_force, F.lit(0)))
