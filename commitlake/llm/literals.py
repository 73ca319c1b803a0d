"""Small fixed tables as literals of the plan."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few parameter rows, read by no Python worker."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


#: A-Z to a-z; other letters stay.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text):
    """``lower`` on plain ASCII, which it treats alike, and letter by letter elsewhere."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
