"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.cut import materialize

#: Nodes that a task holds at once while it joins the edges it reads.
HELD = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars: one edge from each node to the smallest node that its edges lead to.

    A full task lets go of what the last batch has not touched, so that edges
    that come component by component leave no component in two stars.
    """
    above: dict = {}

    def top(node):
        while above[node] != node:
            above[node] = above[above[node]]
            node = above[node]
        return node

    def stars(schema: pa.Schema, touched: set) -> pa.RecordBatch:
        kept = {node: end for node in list(above) if (end := top(node)) in touched}
        if len(kept) > HELD // 2:
            kept = {}
        found = [(node, end) for node in above if node not in kept and (end := top(node)) != node]
        above.clear()
        above.update(kept)
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in found], field.type) for i, field in enumerate(schema)], schema=schema)

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            above.setdefault(u, u), above.setdefault(v, v)
            a, b = top(u), top(v)
            if a != b:
                above[max(a, b)] = min(a, b)
        schema = batch.schema
        if len(above) > HELD:
            yield stars(schema, {top(u) for u in batch.column("u").to_pylist()})
    if above:
        yield stars(schema, set())


def _shorter(pairs: DataFrame, name: str) -> DataFrame:
    """Edges (u, v), those of one partition joined to stars, as a written table; edges that come together are joined as they come."""
    return materialize(pairs.mapInArrow(_joined, pairs.schema), name)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the smallest node of its component, for every node of an edge between two nodes.

    Edges are undirected; loops and repeats have no effect, null ends are
    dropped, and an empty table gives an empty result.  Every step is two
    aggregations with map-side combining and a join that AQE may split; the
    edges stay on the executors and are written to the shared folder in each
    round, of which there are O(log n) in practice; each task joins the edges of
    its own partition before, so edges that fill one partition take no round.  The rounds end when all
    edges are stars: every node has one edge, to a node that has none itself.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").dropna()
    pairs = _shorter(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("end")
    while True:
        met = pairs.select(ends).groupBy("end.node").agg(F.sum("end.out").alias("outs"), F.min("end.out").alias("centre"))
        if met.filter("outs > 1 or outs = 1 and centre = 0").isEmpty():
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.filter("u <> v").distinct()
        least = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = lower.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        small = small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        pairs = _shorter(small.distinct(), "star-edges")
    labels = pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
