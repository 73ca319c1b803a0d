"""All queries of the engine outside training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog, contents, objects, porcelain, workflow  # noqa: F401 - registers its queries


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.QUERIES["merge_authors"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)
