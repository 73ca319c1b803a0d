"""Pairs of contents met in blocks, so that no pair carries its contents through an exchange.

Both sides of all pairs are dealt to ``n`` bins; block (i, j) has the pairs of
bin i with bin j and the contents of both bins.  A bin is packed into one row:
its contents, and the pairs whose old content it has.  The rows of all bins are
crossed partition by partition, each of one row, so a block's task reads two
bins where they lie.  A content goes through three exchanges, however many
bins or pairs there are; what is read, not what is stored, grows with the bins.
A task holds two bins, the pairs of one, and a batch of results.

Runs of consecutive ids go to a bin together, and a block's pairs are taken in
order: where contents change into ones of near ids, as in repositories, results
with equal parts follow one another, which halves their files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.cut import materialize

#: Bytes of contents in a bin, pairs in a block and pairs in a bin that a task is to hold.
BIN_BYTES, BLOCK_PAIRS, BIN_PAIRS = 24 << 20, 1_000_000, 8_000_000
#: Runs of ids in a bin, if ids have no gaps, more runs else.
RUNS = 8


def _packed(table: pa.Table, codec: str | None) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _pack(first: str, second: str, codec: str | None):
    """One row of a bin that has rows of the first table: its key, and both tables without it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key = left.column("bin")[:1].cast(pa.int32()) if left.num_rows else pa.array([], pa.int32())
        both = [pa.array([_packed(t.drop_columns("bin") if "bin" in t.column_names else t, codec)] * len(key), pa.binary()) for t in (left, right)]
        return pa.table([key, *both], ["bin", first, second])

    return run


def _meet(run: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]]):
    """The rows of blocks, from rows (bin, pairs, contents, other, other_contents)."""

    def opened(value: pa.Scalar) -> pa.Table:
        return pa.ipc.open_stream(value.as_buffer()).read_all()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                i, pairs, own, j, others = (batch.column(c)[k] for c in ("bin", "pairs", "contents", "other", "other_contents"))
                block = opened(pairs)
                block = block.filter(pc.equal(block.column("other"), j)).drop_columns("other")
                if block.num_rows:
                    block = block.sort_by([("old_content", "ascending"), ("new_content", "ascending")])
                    bins = [opened(own), *([opened(others)] if i != j else [])]
                    yield from run(block, pa.concat_tables([b for b in bins if b.num_rows] or bins[:1]))

    return met


def in_blocks(pairs: DataFrame, contents: DataFrame, size: str, run: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: T.StructType,
              bins: int | None = None, most: int | None = None) -> DataFrame:
    """The rows that ``run(pairs of a block, contents of its bins)`` makes of ``pairs(.., old_content, new_content)``.

    ``contents(content_id, .., size)`` has each id once, with its bytes in the
    column ``size``; a content may lack.  Both tables should be written ones:
    they are counted to choose the number of bins, unless ``bins`` is given;
    ``most`` pairs are to be in a block.
    """
    held, known = contents.agg(F.coalesce(F.sum(F.col(size).cast("long")), F.lit(0)), F.count("*")).first()
    if bins is None:
        given = pairs.count()
        bins = max(1, ceil(held / BIN_BYTES), ceil(sqrt(given / (most or BLOCK_PAIRS))), ceil(given / BIN_PAIRS))
    whole = isinstance(contents.schema["content_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    run_of = (lambda c: F.expr(f"CAST({c} AS BIGINT) DIV {max(1, known // (RUNS * bins))}L")) if whole else F.col
    of = lambda c: F.pmod(F.xxhash64(run_of(c)), F.lit(bins)).cast("int")

    def packed(first: DataFrame, names: tuple[str, str], codec: str | None) -> DataFrame:
        sides = [t.repartitionById(bins, "bin").groupBy("bin") for t in (first, contents.withColumn("bin", of("content_id")))]
        return sides[0].cogroup(sides[1]).applyInArrow(_pack(*names, codec), f"bin int, {names[0]} binary, {names[1]} binary")

    every = pairs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    others = materialize(packed(every, ("key", "other_contents"), "zstd").select(F.col("bin").alias("other"), "other_contents"), "bins")
    own = packed(pairs.withColumns({"bin": of("old_content"), "other": of("new_content")}), ("pairs", "contents"), None)
    # Crossed, not broadcast: each task has one row of each side.
    blocks = own.crossJoin(others.repartitionById(bins, "other").hint("shuffle_replicate_nl"))
    return blocks.select("bin", "pairs", "contents", "other", "other_contents").mapInArrow(_meet(run), schema)
