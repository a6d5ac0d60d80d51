"""Raw payloads kept whole as VARIANT: which fields arrive, and any of them as a column later on.

``normalize_payloads`` reads the fields it knows and leaves the rest behind. Landed as VARIANT, a payload is parsed once and keeps
every field, so a field that turns out to matter can be taken from what was landed before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stayledger.operators.pms import PAYLOAD_SCHEMA

#: The fields that normalization reads.
KNOWN_FIELDS = tuple(f.split()[0] for f in PAYLOAD_SCHEMA.replace("decimal(14,2)", "decimal").split(","))


def landed(raw: DataFrame) -> DataFrame:
    """``raw`` with its payload as VARIANT in ``document``; null where it is no JSON."""
    return raw.withColumn("document", F.try_parse_json("payload"))


def payload_fields(documents: DataFrame) -> DataFrame:
    """One row per system, field and kind of value: pms_code, field, kind, known, payloads, first_id.

    ``kind`` is object, array, string, number, boolean or null. A payload that is no object counts under the field null with its own
    kind, one that is no JSON with the kind invalid. Fields are taken apart in the row and counted with map-side sums.
    """
    spark = documents.sparkSession
    fields = documents.select("id", "pms_code", "document").lateralJoin(spark.tvf.variant_explode_outer(F.col("document").outer()), how="left")
    outer = F.schema_of_variant("document")
    is_object = outer.startswith("OBJECT")
    shape = F.when(is_object, F.schema_of_variant("value")).otherwise(outer)
    kind = F.when(shape.isNull(), F.when(is_object, "empty").otherwise("invalid")).when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array") \
        .when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").otherwise("number")
    rows = fields.select("id", "pms_code", F.when(is_object, F.col("key")).alias("field"), kind.alias("kind"))
    return rows.groupBy("pms_code", "field", "kind").agg(F.count_distinct("id").alias("payloads"), F.min("id").alias("first_id")) \
        .withColumn("known", F.coalesce(F.col("field").isin(*KNOWN_FIELDS), F.lit(False)))


def shredded(documents: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """``documents`` with columns taken from the document: name to (path, type); null where absent or of another type."""
    return documents.withColumns({name: F.try_variant_get("document", path, kind) for name, (path, kind) in columns.items()})
