"""All queries by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import evidence, ingest, registry, text  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which conclusions claim more certainty than their weakest support."""
    return registry.QUERIES["check_rule_m"](spark, sf_dir)
