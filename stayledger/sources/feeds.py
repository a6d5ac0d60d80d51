"""Intake of property-system exports into the raw payload landing shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from stayledger.sources.tables import materialize

_BROKEN = "_broken_line"

#: Numbers of pieces of a JSON array file that are scanned in one go.
_STRETCH = 250_000


def _landed(rows: DataFrame, payload: Column, source: Column, raw_row: Column, import_id: str, pms_code: str) -> DataFrame:
    return rows.select(F.lit(import_id).alias("import_id"), F.lit(pms_code).alias("pms_code"),
                       source.cast("string").alias("source_id"), payload.alias("payload"),
                       F.sha2(payload, 256).alias("payload_hash"), raw_row.alias("raw_row"), "_source_file")


def read_csv_feed(spark: SparkSession, path: str, schema: str, import_id: str, pms_code: str,
                  source_id: str | None = None, sep: str = ";") -> DataFrame:
    """A delimited export with a header; spreadsheets arrive converted to this form.

    The payload holds every field of the file, those of ``schema`` in its types and the others as text. ``raw_row`` is
    NULL but for a line that has too few or too many fields (the line) or a value that is not of its type (all fields as text).
    """
    options = {"sep": sep, "header": True, "encoding": "UTF-8"}
    names = spark.read.options(**options).csv(path).columns
    types = {f.name: f.dataType for f in T.DataType.fromDDL(schema).fields}
    if absent := sorted(set(types) - set(names)):
        raise ValueError(f"columns {absent} are not in the header")
    texts = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BROKEN]])
    rows = spark.read.schema(texts).options(**options, enforceSchema=False, columnNameOfCorruptRecord=_BROKEN).csv(path) \
        .withColumn("_source_file", F.input_file_name())
    text = {n: F.col(f"`{n}`") for n in names}
    typed = {n: c.try_cast(types[n]) if n in types else c for n, c in text.items()}
    unfit = F.lit(False)
    for n in types:
        unfit = unfit | (text[n].isNotNull() & typed[n].isNull())
    raw_row = F.coalesce(F.col(_BROKEN), F.when(unfit, F.to_json(F.struct(*text.values()))))
    payload = F.to_json(F.struct(*[c.alias(n) for n, c in typed.items()]))
    return _landed(rows, payload, text[source_id] if source_id else F.lit(None), raw_row, import_id, pms_code)


def read_json_feed(spark: SparkSession, path: str, schema: str, import_id: str, pms_code: str,
                   source_id: str | None = None, multi_line: bool = False) -> DataFrame:
    """A JSON export, one object per line or one array per file.

    The payload is the object with all its fields, on lines exactly as it came. ``raw_row`` is NULL but for text that is no
    object or does not fit ``schema``; a file that should be an array and is none is one such row.
    """
    rows = spark.read.text(path, wholetext=multi_line).select("value", F.input_file_name().alias("_source_file"))
    if multi_line:
        listed = F.coalesce(F.from_json("value", "array<string>"), F.array("value"))
        rows = rows.select(F.explode(listed).alias("value"), "_source_file")
    return _parsed_rows(rows.where(F.trim("value") != ""), schema, import_id, pms_code, source_id)


def read_json_array(spark: SparkSession, path: str, schema: str, import_id: str, pms_code: str, source_id: str | None = None) -> DataFrame:
    """JSON array files of any size, each read by several tasks and cut at the borders of its objects.

    The text is read in pieces that end at a closing brace, split over tasks like any text. Whether a piece starts inside a
    string, and how deep, depends on all before it; so every stretch of a block of a file is scanned for both cases, and the
    stretches' totals, three numbers each, settle which holds. An object ends where the depth comes back to nothing.

    Columns as in ``read_json_feed``. Text that is no object, or does not fit ``schema``, has its text in ``raw_row``. Where a brace too
    many closes an object, the next one starts anew; one that lacks a brace or a quote takes what follows with it until braces are
    even again, and comes in pieces, all of them bad rows, if it spreads over more than two blocks.
    """
    meta = {c: F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start", "file_size")}
    code = F.regexp_replace("value", r"(?s)\\.", "")

    def opened(text: Column) -> Column:
        """Opening braces outside strings."""
        bare = F.regexp_replace(text, r'"[^"]*("|$)', "")
        return F.length(bare) - F.length(F.replace(bare, F.lit("{")))

    read = spark.read.option("lineSep", "}").text(path).select(
        "value", meta["file_path"].alias("_source_file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"),
        F.monotonically_increasing_id().alias("at"))
    # Written once: the pieces keep their numbers, and the later steps read them without cutting or searching again.
    pieces = materialize(read.select(
        "*", F.expr(f"at div {_STRETCH}").alias("stretch"), (F.length(code) - F.length(F.replace(code, F.lit('"')))).alias("quotes"),
        opened(code).alias("opens_0"), opened(F.concat(F.lit('"'), code)).alias("opens_1")), "json-pieces")

    # Stretches of a block, in their order; only the numbers of pieces travel until each piece has its object.
    place = ["_source_file", "block", "stretch"]
    last = pieces.groupBy("_source_file", "block").agg(F.max("at").alias("at"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"))
    ends = last.groupBy("_source_file").agg(F.max(F.struct("block", "at")).alias("last"), (F.sum("bytes") > F.max("size")).alias("open"))
    tail = ends.where("open").select("_source_file", F.col("last.block").alias("block"), F.col("last.at").alias("at"), F.lit(0).alias("closes"))
    tail = materialize(tail, "json-tails")

    so_far = Window.partitionBy(*place).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def scan(*columns: str) -> DataFrame:
        """Pieces with their ends, and the depth after them, for a stretch that begins outside (0) and inside (1) of a string."""
        scanned = pieces.join(F.broadcast(tail), ["_source_file", "block", "at"], "left").select(
            *place, "at", *columns, F.coalesce("closes", F.lit(1)).alias("closes"), "quotes", "opens_0", "opens_1") \
            .withColumn("before", F.sum("quotes").over(so_far) - F.col("quotes"))
        for h in (0, 1):
            inside = (F.col("before") + h) % 2
            opens = F.when(inside == 0, F.col("opens_0")).otherwise(F.col("opens_1"))
            closes = F.when((inside + F.col("quotes")) % 2 == 0, F.col("closes")).otherwise(0)
            scanned = scanned.withColumns({f"ends_{h}": closes, f"change_{h}": opens - closes})
        scanned = scanned.withColumns({f"depth_{h}": F.sum(f"change_{h}").over(so_far) for h in (0, 1)})
        return scanned.withColumns({f"low_{h}": F.min(f"depth_{h}").over(so_far) for h in (0, 1)})

    totals = scan().groupBy(*place).agg(F.sum("quotes").alias("quotes"), *[F.sum(f"change_{h}").alias(f"change_{h}") for h in (0, 1)],
                                        *[F.min(f"depth_{h}").alias(f"low_{h}") for h in (0, 1)])
    starts, file, inside, depth = [], None, 0, 0
    # One row per stretch of a file, some tens of megabytes each.
    for r in sorted(totals.collect(), key=lambda r: (r._source_file, r.block, r.stretch)):
        if r._source_file != file:
            file, inside, depth = r._source_file, 0, 0
        starts.append((file, r.block, r.stretch, inside, depth))
        depth += r[f"change_{inside}"] - min(0, depth + r[f"low_{inside}"])
        inside = (inside + r.quotes) % 2
    begun = F.broadcast(spark.createDataFrame(starts, "_source_file string, block long, stretch long, inside int, start int"))

    def known(name: str) -> Column:
        return F.when(F.col("inside") == 0, F.col(f"{name}_0")).otherwise(F.col(f"{name}_1"))

    settled = scan("value").join(begun, place).withColumn("depth", F.col("start") + known("depth") - F.least(F.lit(0), F.col("start") + known("low")))
    ended = settled.select(*place, "at", F.concat("value", F.repeat(F.lit("}"), F.col("closes"))).alias("text"),
                           F.when((known("ends") == 1) & (F.col("depth") == 0), 1).otherwise(0).alias("ends"))
    # The pieces of an object by its number in the stretch, counted from nothing; an object that others of the stretch enclose is whole.
    numbered = ended.withColumn("object", F.sum("ends").over(so_far) - F.col("ends"))
    parts = materialize(numbered.groupBy(*place, "object").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("at", "text")))["text"], "").alias("text"), F.sum("ends").alias("ends")), "json-objects")
    before = Window.partitionBy("_source_file").orderBy("block", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    per_stretch = parts.groupBy(*place).agg(F.sum("ends").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = parts.join(F.broadcast(per_stretch), place)
    inner = (F.col("object") > 0) & (F.col("object") < F.col("n"))
    # Only the first and the last object of a stretch may go on in another one.
    edges = placed.where(~inner).withColumn("object", F.col("earlier") + F.col("object"))
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("order", "text")))["text"], "").alias("text")
    in_block = edges.withColumn("order", F.col("stretch")).groupBy("_source_file", "object", "block").agg(joined)
    spread = in_block.groupBy("_source_file", "object").agg(F.count("*").alias("n"))
    whole = in_block.join(spread, ["_source_file", "object"]).withColumn("piece", F.when(F.col("n") > 2, F.col("block")).otherwise(-1)) \
        .withColumn("order", F.col("block")).groupBy("_source_file", "object", "piece").agg(joined)
    texts = placed.where(inner).select("text", "_source_file").unionByName(whole.select("text", "_source_file"))
    rows = texts.select(F.regexp_replace("text", r"^[\s,\[]+|[\s,\]]+$", "").alias("value"), "_source_file").where("value <> ''")
    return _parsed_rows(rows, schema, import_id, pms_code, source_id)


def _parsed_rows(rows: DataFrame, schema: str, import_id: str, pms_code: str, source_id: str | None) -> DataFrame:
    parsed = F.from_json("value", f"{schema}, {_BROKEN} string", {"columnNameOfCorruptRecord": _BROKEN})
    rows = rows.withColumn("_parsed", parsed)
    source = F.col("_parsed")[source_id] if source_id else F.lit(None)
    return _landed(rows, F.col("value"), source, F.col("_parsed")[_BROKEN], import_id, pms_code)


def feed_errors(landed: DataFrame) -> DataFrame:
    """One error row for each landed row that did not fit the feed."""
    return landed.where(F.col("raw_row").isNotNull()).select(
        "import_id", "pms_code", "source_id", F.lit("BAD_ROW").alias("error_code"), "raw_row", "_source_file")
