"""Similarity renames: span-hash scores of deleted and added files of one diff, paired greedily."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import spans
from ..plans.cut import materialize
from .pairing import in_blocks

#: Pairs of a diff beyond which, and bytes of a file beyond which, similarity is not looked for.
MOST_PAIRS, MOST_BYTES, THRESHOLD = 1000, 8 << 20, 50
_AT_ONCE, _PAIRS_AT_ONCE = 1 << 20, 200_000  # bytes hashed, and pairs scored, at once


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content_id, size, hashes, counts) of (content_id, data); many short contents are hashed at once."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            some, held = [], 0
            while at < batch.num_rows and (not some or held < _AT_ONCE):
                some.append(batch.column(1)[at].as_py())
                held, at = held + len(some[-1]), at + 1
            ends, hashes, counts = spans.span_counts_of(some)
            offsets = pa.array(np.append(0, ends), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (hashes, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at - len(some), len(some)), pa.array([len(x) for x in some], pa.int64()), *lists], ["content_id", "size", "hashes", "counts"])


def _sketches(ids: pa.Array, sizes: pa.Array, hashes: pa.Array, counts: pa.Array) -> spans.Sketches:
    order = np.argsort(ids.to_numpy(), kind="stable")
    ids, sizes, hashes, counts = (x.take(pa.array(order)) for x in (ids, sizes, hashes, counts))
    flat = [x.flatten().to_numpy().astype(np.int64) for x in (hashes, counts)]
    ends = hashes.offsets.to_numpy().astype(np.int64)
    return spans.Sketches(ids.to_numpy(), sizes.to_numpy(), ends[1:] - ends[0], *flat)


def scores(pairs: DataFrame, blobs: DataFrame, least: int = THRESHOLD) -> DataFrame:
    """(.., old_content, new_content, score) of ``pairs(.., old_content, new_content)`` with score >= ``least``; ``blobs(content_id, text)``.

    Every content is hashed once; pairs then meet with two arrays of span counts
    in blocks of contents, so that they carry ids only.
    """

    def scored(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        if not right.num_rows:
            return
        found = _sketches(*(right.column(c).combine_chunks() for c in ("content_id", "size", "hashes", "counts")))
        for batch in left.to_batches(_PAIRS_AT_ONCE):
            ends = [batch.column(c).to_numpy() for c in ("old_content", "new_content")]
            places = [np.minimum(np.searchsorted(found.ids, x), len(found.ids) - 1) for x in ends]
            known = np.flatnonzero((found.ids[places[0]] == ends[0]) & (found.ids[places[1]] == ends[1]))
            score = found.scores(places[0][known], places[1][known], least)
            kept = batch.take(pa.array(known[score >= least]))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in columns), pa.array(score[score >= least], pa.int64())], [*columns, "score"])

    kind = blobs.schema["content_id"].dataType
    columns = pairs.columns
    pairs = pairs.withColumns({c: F.col(c).cast(kind) for c in ("old_content", "new_content")}).dropna(subset=["old_content", "new_content"])
    pairs = materialize(pairs, "rename-pairs")
    texts = blobs.select("content_id", F.encode("text", "utf-8").alias("data")).dropna()
    fields = [T.StructField("content_id", kind), T.StructField("size", T.LongType()), *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("hashes", "counts")]]
    counted = texts.filter(F.octet_length("data") <= MOST_BYTES).mapInArrow(_hashed, T.StructType(fields))
    counted = materialize(counted.withColumn("held", F.size("hashes") * 8 + 16), "span-counts")
    schema = T.StructType([pairs.schema[c] for c in columns] + [T.StructField("score", T.LongType())])
    return in_blocks(pairs, counted, "held", scored, schema)


def text_scores(rows: DataFrame, least: int = THRESHOLD) -> DataFrame:
    """(content_id, score) of ``rows(content_id, old_text, new_text)`` with score >= ``least``: both texts at hand, no pair to meet."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some, held, first = [], 0, at
                while at < batch.num_rows and (not some or held < _AT_ONCE):
                    some += [batch.column(k)[at].as_py() for k in (1, 2)]
                    held, at = held + len(some[-2]) + len(some[-1]), at + 1
                sizes = np.array([len(x) for x in some], np.int64)
                sketches = spans.Sketches(np.arange(len(some)), sizes, *spans.span_counts_of(some))
                score = sketches.scores(np.arange(0, len(some), 2), np.arange(1, len(some), 2), least)
                whole = (sizes.reshape(-1, 2).max(axis=1) <= MOST_BYTES) & (score >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), pa.array(score)], ["content_id", "score"]).filter(pa.array(whole))

    data = [F.encode(c, "utf-8").alias(c) for c in ("old_text", "new_text")]
    schema = T.StructType([rows.schema["content_id"], T.StructField("score", T.LongType())])
    return rows.select("content_id", *data).dropna(subset=["old_text", "new_text"]).mapInArrow(scored, schema)


def _paired(diff: list[str]):
    """The best pairs first, each path of a diff once; the rows of a diff come together, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old, new = None, set(), set()
        for batch in batches:
            kept = []
            keys = zip(*(batch.column(c).to_pylist() for c in diff))
            for key, p, q in zip(keys, batch.column("old_path").to_pylist(), batch.column("new_path").to_pylist()):
                if key != now:
                    now, old, new = key, set(), set()
                kept.append(p not in old and q not in new)
                if kept[-1]:
                    old.add(p)
                    new.add(q)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return run


def similar_renames(changed: DataFrame, blobs: DataFrame, diff: list[str], least: int = THRESHOLD) -> DataFrame:
    """(diff.., old_path, new_path, score) of deleted and added files that are alike; ``changed`` as from ``trees.flat``.

    A diff of more than ``MOST_PAIRS`` pairs has none, so a task never holds more.
    """
    counts = changed.groupBy(*diff).agg((F.count_if(F.col("kind") == "deleted") * F.count_if(F.col("kind") == "added")).alias("pairs"))
    few = changed.join(counts.filter(F.col("pairs").between(1, MOST_PAIRS)), diff, "left_semi")
    gone = few.filter("kind = 'deleted'").select(*diff, F.col("path").alias("old_path"), "old_content")
    come = few.filter("kind = 'added'").select(*diff, F.col("path").alias("new_path"), "new_content")
    pairs = gone.select(*diff, "old_content").distinct().join(come.select(*diff, "new_content").distinct(), diff)
    alike = materialize(scores(pairs, blobs, least), "alike")
    scored = alike.join(gone, [*diff, "old_content"]).join(come, [*diff, "new_content"]).select(*diff, "old_path", "new_path", "score")
    other_name = F.substring_index("old_path", "/", -1) != F.substring_index("new_path", "/", -1)
    ranked = scored.repartition(*diff).sortWithinPartitions(*diff, F.desc("score"), other_name, "old_path", "new_path")
    return ranked.mapInArrow(_paired(diff), scored.schema)
