"""Data-quality checks: constraints as batch reports that list or count the offending rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from stayledger import schemas
from stayledger.functions.scalars import col
from stayledger.sources import tables


def check_unique(df: DataFrame, keys: list[str | Column], where: Column | None = None) -> DataFrame:
    """Key values that occur more than once, with their count. NULL keys never collide."""
    named = [col(k).alias(k if isinstance(k, str) else f"key_{i}") for i, k in enumerate(keys)]
    rows = df if where is None else df.where(where)
    keyed = rows.select(*named)
    for c in keyed.columns:
        keyed = keyed.where(F.col(c).isNotNull())
    return keyed.groupBy(*keyed.columns).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def check_predicate(df: DataFrame, holds: Column) -> DataFrame:
    """Rows for which ``holds`` is false. An unknown result passes, as in a table constraint."""
    return df.where(~F.coalesce(holds, F.lit(True)))


def check_enum(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values outside the allowed set, with their count."""
    return df.where(~F.col(column).isin(allowed)).groupBy(F.col(column).alias("value")) \
        .agg(F.count("*").alias("occurrences")) \
        .select(F.lit(column).alias("column_name"), "value", "occurrences")


def check_fk(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Child rows that point to no parent. The child is reduced to its distinct references first."""
    used = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("missing_key")) \
        .agg(F.count("*").alias("references"))
    return used.join(parent.select(F.col(key).alias("missing_key")), "missing_key", "left_anti") \
        .select(F.lit(column).alias("column_name"), "missing_key", "references")


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs per required column, counted in one pass; columns without NULLs are absent."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])
    return counted.select(F.inline(pairs)).where(F.col("nulls") > 0)


def check_same_tenant(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Child rows whose chain differs from the chain of the parent they point to, per pair of chains."""
    refs = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_ref"), "chain_group_id") \
        .agg(F.count("*").alias("n"))
    owners = parent.select(F.col(key).alias("_ref"), F.col("chain_group_id").alias("parent_chain_id"))
    return refs.join(owners, "_ref").where(F.col("chain_group_id") != F.col("parent_chain_id")) \
        .groupBy("chain_group_id", "parent_chain_id").agg(F.sum("n").alias("occurrences"))


def table_report(frames: dict[str, DataFrame]) -> DataFrame:
    """Row count per named frame."""
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
              for name, df in frames.items()]
    return reduce(DataFrame.unionByName, counts)


def transaction_summary(transactions: DataFrame) -> DataFrame:
    """Posting counts and average posted charge for members and for other guests, in one pass."""
    member = F.col("member_id").isNotNull()
    charge = (F.col("status") == "posted") & (F.col("transaction_type") == "charge")

    def average(rows: Column) -> Column:
        return F.round(F.avg(F.when(rows & charge, F.col("posted_amount"))), 0).cast("bigint")

    return transactions.agg(
        F.count("*").alias("transactions"), F.count_if(member).alias("member_transactions"),
        F.count_if(~member).alias("guest_transactions"),
        average(member).alias("avg_member_charge"), average(~member).alias("avg_guest_charge"))


def clean_placeholders(df: DataFrame, rules: dict[str, list]) -> DataFrame:
    """Replace stand-in values by NULL, e.g. ``{"birth_date": [date(1800, 1, 1)]}``."""
    cleaned = {}
    for column, stand_ins in rules.items():
        stand_in = reduce(lambda a, b: a | b, [F.col(column) == F.lit(v) for v in stand_ins])
        cleaned[column] = F.when(F.coalesce(stand_in, F.lit(False)), F.lit(None)).otherwise(F.col(column))
    return df.withColumns(cleaned)


def valid_transitions(history: DataFrame, allowed: list[tuple[str | None, str]]) -> DataFrame:
    """Status changes outside the allowed pairs, with their count."""
    ok = reduce(lambda a, b: a | b,
                [F.col("from_status").eqNullSafe(F.lit(a)) & (F.col("to_status") == b) for a, b in allowed])
    return history.where(~ok).groupBy("from_status", "to_status").agg(F.count("*").alias("occurrences"))


def _row_rules(df: DataFrame, table: str) -> tuple[dict[str, Column], list[str]]:
    """The rules of the model that a row fulfils or breaks by itself, and those on columns that the frame lacks."""
    present = set(df.columns)
    passes: dict[str, Column] = {}
    skipped: list[str] = []
    for c in schemas.columns_of(table):
        if not c.nullable and c.name in present:
            passes[f"not null: {c.name}"] = F.col(c.name).isNotNull()
        elif not c.nullable:
            skipped.append(f"not null: {c.name}")
    for condition in schemas.CHECKS.get(table, []):
        passes[f"check: {condition}"] = F.coalesce(F.expr(condition), F.lit(True))
    for (t, column), allowed in schemas.ENUMS.items():
        if t == table and column in present:
            passes[f"values: {column}"] = F.coalesce(F.col(column).isin(allowed), F.lit(True))
        elif t == table:
            skipped.append(f"values: {column}")
    return passes, skipped


def broken_keys(df: DataFrame, table: str) -> tuple[DataFrame | None, list[str]]:
    """Rows that share a key of the model which must be unique, per rule; all keys in one aggregation."""
    present, tests, skipped = set(df.columns), [], []
    for key, where in [(schemas.PRIMARY_KEYS.get(table, ["id"]), None)] + [(k, w) for t, k, w in schemas.UNIQUE_KEYS if t == table]:
        rule = f"unique: {', '.join(key)}"
        if not all(k in present or "(" in k for k in key):
            skipped.append(rule)
            continue
        values = [F.expr(k) for k in key]
        applies = reduce(lambda a, b: a & b, [v.isNotNull() for v in values], F.lit(True) if where is None else F.expr(where))
        text = F.to_json(F.struct(*[v.alias(f"k{i}") for i, v in enumerate(values)]))
        tests.append(F.when(applies, F.struct(F.lit(rule).alias("rule"), text.alias("key"))))
    if not tests:
        return None, skipped
    keys = df.select(F.inline(F.array_compact(F.array(*tests))))
    copies = keys.groupBy("rule", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return copies.groupBy("rule").agg(F.sum("n").alias("offending_rows")), skipped


def broken_references(df: DataFrame, table: str, frames: dict[str, DataFrame]) -> tuple[DataFrame | None, list[str]]:
    """Rows that point to no parent, per reference of the model; all references in one aggregation and one join."""
    tests, skipped, parents = [], [], {}
    for column, parent, key in schemas.references_of(table):
        rule = f"reference: {column}"
        if column not in df.columns or parent not in frames:
            skipped.append(rule)
            continue
        target = F.struct(F.lit(rule).alias("rule"), F.lit(f"{parent}.{key}").alias("parent"), F.col(column).cast("string").alias("key"))
        tests.append(F.when(F.col(column).isNotNull(), target))
        parents[f"{parent}.{key}"] = frames[parent].select(F.lit(f"{parent}.{key}").alias("parent"), F.col(key).cast("string").alias("key"))
    if not tests:
        return None, skipped
    used = df.select(F.inline(F.array_compact(F.array(*tests)))).groupBy("rule", "parent", "key").agg(F.count("*").alias("n"))
    known = reduce(DataFrame.unionByName, parents.values())
    return used.join(known, ["parent", "key"], "left_anti").groupBy("rule").agg(F.sum("n").alias("offending_rows")), skipped


def _report(table: str, rows: DataFrame, parts: list[DataFrame | None]) -> DataFrame:
    found = reduce(DataFrame.unionByName, [p for p in parts if p is not None], rows)
    return found.where(F.col("offending_rows").isNull() | (F.col("offending_rows") > 0)) \
        .select(F.lit(table).alias("table_name"), "rule", F.col("offending_rows").cast("bigint"))


def check_model(table: str, frames: dict[str, DataFrame]) -> DataFrame:
    """Every rule of the data model for one table, as one row per broken rule with the rows it concerns.

    Required columns, row conditions and allowed values are counted in a single pass; all unique keys take one aggregation
    and all references one more, however many there are. A rule on a column that the frame lacks, or a reference
    whose parent is not among ``frames``, comes as ``not checked: ...`` without a number of rows.
    """
    df = frames[table]
    passes, skipped = _row_rules(df, table)
    keys, without_keys = broken_keys(df, table)
    references, without_parents = broken_references(df, table, frames)
    counted = df.agg(*[F.count_if(~ok).alias(f"c{i}") for i, ok in enumerate(passes.values())])
    pairs = [F.struct(F.lit(rule).alias("rule"), F.col(f"c{i}").alias("offending_rows")) for i, rule in enumerate(passes)]
    pairs += [F.struct(F.lit(f"not checked: {rule}").alias("rule"), F.lit(None).cast("bigint").alias("offending_rows"))
              for rule in skipped + without_keys + without_parents]
    return _report(table, counted.select(F.inline(F.array(*pairs))), [keys, references])


def write_checked(table: str, frames: dict[str, DataFrame], path: str, business_date: str | None = None) -> DataFrame:
    """Append a frame to a stored table and report as ``check_model`` does.

    The row rules are counted while the rows are written, so they cost no scan of their own; keys and references are
    checked on the written rows, new and old, since a new row can repeat an old key.
    """
    df, spark = frames[table], frames[table].sparkSession
    passes, skipped = _row_rules(df, table)
    seen = Observation()
    tables.append(df.observe(seen, *[F.count_if(~ok).alias(f"c{i}") for i, ok in enumerate(passes.values())]), path, business_date)
    counts = seen.get
    rows = [(rule, counts[f"c{i}"]) for i, rule in enumerate(passes)]
    written = spark.read.schema(df.schema).parquet(path)
    keys, without_keys = broken_keys(written, table)
    references, without_parents = broken_references(written, table, frames)
    rows += [(f"not checked: {rule}", None) for rule in skipped + without_keys + without_parents]
    return _report(table, spark.createDataFrame(rows, "rule string, offending_rows bigint"), [keys, references])
