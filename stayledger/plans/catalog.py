"""All named queries of the package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stayledger.plans import audiences, engagement, loyalty, model_checks, platform, reports, scopes, stays, upkeep  # noqa: F401  (register their queries)
from stayledger.plans.registry import ORACLES, QUERIES, runnable


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runnable(build) for name, build in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
