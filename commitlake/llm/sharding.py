"""Shards of near equal bytes by longest-processing-time scheduling.

Rows of equal text form a group that stays together.  Groups, sorted by size
(ties by the text's MD5), go to the least loaded shard, which a heap holds on
top.  Groups of at least ``1 / (shards * EXACT)`` of all bytes, of which there
are at most ``shards * EXACT``, are scheduled one by one.  The smaller ones are
counted in size classes (the size's twelve leading bits, so sizes below 4096 are
exact and others within 1/2048; about 108,000 classes at most, however large the
table), and the groups of a class are dealt in one step that loads the shards as
single steps would; a group's rank by MD5 in its class then names its shard.  A
class's error is at most 1/2048 of groups that are each below 1/2048 of a shard.

A row's slot is its place by the MD5 of (doc_id, text's MD5) in its shard.

Edge cases: a null text has no bytes and groups with the empty text; repeated
rows have a slot each; a null ``doc_id`` is the empty string in the slot's key;
an empty table gives an empty result.  A group larger than a shard's equal part
stays whole, so bytes are as near to equal as the groups allow.  Only the id and
text are read; ``write_shards`` replaces a column named ``shard``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import buckets_for, positions
from .storage import materialize

LEADING_BITS = 12
#: Groups of at least this part of a shard are scheduled one by one.
EXACT = 2048


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` each shard gets if each goes to the least loaded (ties: the first)."""
    got = [0] * len(loads)
    if count > 4 * len(loads):
        # All single steps that start below a level; the level is the highest one that ``count`` steps fill.
        low, high = min(loads), max(loads) + size * count

        def below(level: int) -> list[int]:
            return [max(0, -(-(level - load) // size)) for load in loads]

        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
        got = below(low)
    heap = [(load + n * size, s) for s, (load, n) in enumerate(zip(loads, got))]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        load, s = heap[0]
        got[s] += 1
        heapq.heapreplace(heap, (load + size, s))
    return got


def schedule(large: list[tuple[bytes, int]], classes: list[tuple[int, int, int]], shards: int) -> tuple[list[tuple[bytes, int]], list[tuple[int, list[int]]]]:
    """The shard of each (group, bytes) of ``large``, and for each (class, groups, bytes) the rank at which each shard's run ends."""
    heap, placed = [(0, s) for s in range(shards)], []
    for group, size in sorted(large, key=lambda g: (-g[1], g[0])):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
        placed.append((group, s))
    loads, out = [load for load, _ in sorted(heap, key=lambda x: x[1])], []
    for key, count, total in sorted(classes, reverse=True):
        size = max(1, round(total / count))
        got = deal(loads, size, count)
        ends, at = [], 0
        for s, n in enumerate(got):
            loads[s] += n * size
            at += n
            ends.append(at)
        out.append((key, ends))
    return placed, out


def _bucket(digest: str, buckets: int) -> Column:
    """The part of 0 .. ``buckets`` - 1 in which a hexadecimal digest lies, in its order."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * buckets / 4294967296).cast("long")


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, group_id, shard and slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(text.cast("binary"))
    meta = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), digest.alias("group_id"),
        F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), digest).cast("binary")).alias("row_key"),
    )
    meta = materialize(meta, "shard-rows")
    rows, total = meta.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not rows:
        return meta.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).drop("row_key")
    groups = meta.groupBy("group_id").agg(F.sum("size").alias("bytes"))
    drop = f"greatest(0, length(bin(bytes)) - {LEADING_BITS})"
    groups = materialize(groups.withColumn("class", F.expr(f"shiftleft(shiftright(bytes, {drop}), {drop})")), "shard-groups")
    least = -(-total // (shards * EXACT))
    large = groups.filter(F.col("bytes") >= least).select("group_id", "bytes").collect()  # at most shards * EXACT
    small = groups.filter(F.col("bytes") < least)
    classes = small.groupBy("class").agg(F.count("*"), F.sum("bytes")).collect()  # bounded by the leading bits
    placed, plan = schedule([tuple(r) for r in large], [tuple(r) for r in classes], shards)
    plan = spark.createDataFrame(plan, "class long, ends array<long>")
    ranked = positions(small, ["class"], _bucket("group_id", buckets_for(rows)), ["group_id"])
    shard = F.size(F.filter("ends", lambda e: e <= F.col("position")))
    where = ranked.join(plan, "class").select("group_id", shard.alias("shard"))
    # A group of many rows is a large one, so hot groups never meet in a shuffle; at most shards * EXACT rows are broadcast.
    known = F.broadcast(spark.createDataFrame(placed, "group_id string, shard int"))
    rest = meta.join(known.select("group_id"), "group_id", "left_anti").join(where, "group_id")
    placed = materialize(meta.join(known, "group_id").unionByName(rest), "shard-placed")
    out = positions(placed, ["shard"], _bucket("row_key", buckets_for(rows)), ["row_key"])
    return out.withColumnRenamed("position", "slot").drop("row_key")


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet, one folder for each shard."""
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    placed = assign_shards(docs, shards, id_col, text_col).select(F.col("group_id").alias("__shard_of"), "shard").distinct()
    out = docs.drop("shard").withColumn("__shard_group", digest).join(placed, F.col("__shard_group") == F.col("__shard_of"))
    out.drop("__shard_group", "__shard_of").write.partitionBy("shard").parquet(path)
