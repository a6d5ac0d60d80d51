"""Collects the named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stayledger.plans.binding import Frames, duckdb_sql

Query = Callable[[Frames], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where the result can be stated in SQL."""
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = duckdb_sql(sql)
        return build
    return register


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and all whole numbers as bigint, for comparison across engines."""
    def cast(f: T.StructField):
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return F.col(f.name).cast("bigint")
        return F.col(f.name)
    return df.select(*[cast(f).alias(f.name) for f in df.schema.fields])


def runnable(build: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: plain(build(Frames.of(spark, folder)))


def fx_sql(source: str, amount: str, from_ccy: str, to_ccy: str, on_date: str, out: str) -> str:
    """DuckDB text that converts ``amount`` row by row with as-of joins to both directions."""
    return f"""SELECT s.*, CASE WHEN s.{from_ccy} = s.{to_ccy} THEN s.{amount}
    WHEN direct.rate IS NOT NULL THEN round(s.{amount} * direct.rate, 2)
    ELSE round(s.{amount} * CAST(CAST(1 AS DOUBLE) / CAST(opposite.rate AS DOUBLE) AS DECIMAL(23,15)), 2) END AS {out}
  FROM ({source}) s
  ASOF LEFT JOIN {{currency_rates}} direct ON s.{from_ccy} = direct.from_ccy AND s.{to_ccy} = direct.to_ccy
    AND s.{on_date} >= direct.rate_date
  ASOF LEFT JOIN {{currency_rates}} opposite ON s.{from_ccy} = opposite.to_ccy AND s.{to_ccy} = opposite.from_ccy
    AND s.{on_date} >= opposite.rate_date"""


def pct_sql(part: str, whole: str) -> str:
    """Percentage at two decimals by whole-number arithmetic, half up."""
    return f"CASE WHEN {whole} > 0 THEN ((20000 * CAST({part} AS BIGINT) + {whole}) // (2 * {whole})) / 100.0 END"
