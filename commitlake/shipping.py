"""Send the package to Python workers that cannot import it."""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the package's source to the session's workers, once; Spark's file server delivers it."""
    context = spark.sparkContext
    if getattr(context, "_commitlake_shipped", False):
        return
    home = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="commitlake-"))
    skip = shutil.ignore_patterns("__pycache__", "*.pyc")
    shutil.copytree(home, folder / "source" / home.name, ignore=skip)
    context.addPyFile(shutil.make_archive(str(folder / home.name), "zip", folder / "source"))
    shutil.rmtree(folder / "source")
    context._commitlake_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
