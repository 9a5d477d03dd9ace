"""All queries of the library's core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.plans import curation


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents the gate passes, and by which rules it stops the others."""
    return curation.g0_gate(spark, sf_dir).groupBy("passed", "blocks").count()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(curation.QUERIES)


def oracle_sql() -> dict[str, str]:
    return curation.SQL
