"""All queries of the library, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, curation, details

ALL = {**curation.QUERIES, **analytics.QUERIES, **details.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.caption_curation(spark, sf_dir)
