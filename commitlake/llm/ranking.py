"""Positions and running sums inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows that one task orders at a time, on average.
ROWS_PER_BUCKET = 20_000


def buckets_for(rows: int) -> int:
    return max(64, -(-rows // ROWS_PER_BUCKET))


def positions(df: DataFrame, group: list[str], bucket: Column, order: list[Column | str], weight: Column | None = None) -> DataFrame:
    """Adds ``position`` (0-based and gapless in ``group``) and, with a weight, ``before`` (weight of earlier rows).

    Rows are ordered by (bucket, order).  Only a bucket is ever ordered by one
    task; what lies before a bucket comes from one row of totals for each
    (group, bucket).  So a group may hold a third of all rows.  ``df`` is read
    twice: pass a table.  Null group values form a group.
    """
    weighed = weight if weight is not None else F.lit(0)
    df = df.withColumn("_bucket", bucket).withColumn("_weight", weighed.cast("long"))
    keys = [*group, "_bucket"]
    totals = df.groupBy(*keys).agg(F.count("*").alias("_rows"), F.sum("_weight").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows0"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    inside = Window.partitionBy(*keys).orderBy(*order)
    out = df.join(totals, same).drop(*[f"_k{i}" for i in range(len(keys))])
    out = out.withColumn("position", F.col("_rows0") + F.row_number().over(inside) - 1)
    if weight is not None:
        running = F.sum("_weight").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = out.withColumn("before", F.col("_sum0") + running - F.col("_weight"))
    return out.drop("_bucket", "_weight", "_rows0", "_sum0")
