"""Contents as whole payloads, line deltas or chunks, and commits and directories as objects."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import scalars as S, spans
from ..plans.cut import materialize
from ..sources import objects
from . import textdiff

#: Deltas on deltas, a delta's share of the content, and the size from which contents are chunked.
MOST_DEPTH, RATIO, CHUNKED = 8, 0.8, 4 << 20
_OUT, _BYTES = 20_000, 16 << 20  # rows of a batch, bytes in the last of its columns


def represented(contents: DataFrame) -> DataFrame:
    """(id, kind, base, depth, payload) of ``contents(id, text, base, base_text, base_depth)``: a line delta where it is worth it, else full."""
    delta = F.when(F.col("base_text").isNotNull() & (F.col("base_depth") < MOST_DEPTH), textdiff.encode_line_delta("base_text", "text"))
    rows = contents.withColumn("delta", delta)
    short = F.octet_length("delta") < RATIO * F.greatest(F.lit(1), F.octet_length("text"))
    worth = F.coalesce(short, F.lit(False))
    return rows.select(
        "id", F.when(worth, "line-delta").otherwise("full").alias("kind"), F.when(worth, F.col("base")).alias("base"),
        F.when(worth, F.col("base_depth") + 1).otherwise(0).alias("depth"), F.when(worth, F.col("delta")).otherwise(F.col("text")).alias("payload"),
    )


def decoded(stored: DataFrame) -> DataFrame:
    """(id, text) of ``represented`` contents: one join a level of deltas, of which there are at most ``MOST_DEPTH``."""
    stored = materialize(stored, "stored")
    known = level = stored.filter("kind = 'full'").select("id", F.col("payload").alias("text"))
    deltas = stored.filter("kind = 'line-delta'")
    left = deltas.count()
    for _ in range(MOST_DEPTH):
        if not left:
            break
        above = deltas.join(level.select(F.col("id").alias("base"), F.col("text").alias("base_text")), "base")
        level = materialize(above.select("id", textdiff.decode_line_delta("base_text", "payload").alias("text")), "contents")
        made = level.count()
        if not made:
            break
        left, known = left - made, known.unionByName(level)
    return known


def chunked(contents: DataFrame, sizes: tuple[int, int, int] = spans.SIZES) -> DataFrame:
    """(id, idx, off, size, chunk) of ``contents(id, data)``; ``chunk`` is the SHA-256 of the bytes."""
    kind = contents.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(n, T.LongType()) for n in ("idx", "off", "size")], T.StructField("part", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                found = spans.chunks(data, sizes) if data else []
                columns = [pa.array([batch.column(0)[i].as_py()] * len(found), batch.schema.field(0).type), pa.array(range(len(found)), pa.int64())]
                columns += [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)] + [pa.array([data[a : a + n] for a, n in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "idx", "off", "size", "part"])

    cut = contents.select("id", "data").mapInArrow(run, schema)
    return cut.select("id", "idx", "off", "size", F.sha2("part", 256).alias("chunk"))


def ingest(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """The ``incoming(id, ..)`` contents that are not in ``known(id)``, each once."""
    return incoming.join(known.select("id"), "id", "left_anti").dropDuplicates(["id"])


def commit_payload(tree: Column, parents: Column, author: Column, seconds: Column, message: Column) -> Column:
    """A commit object's bytes; ``parents`` is an array of ids in their order."""
    who = F.concat(author, F.lit(" "), seconds.cast("string"), F.lit(" +0000"))
    lines = F.concat(F.array(F.concat(F.lit("tree "), tree)), F.transform(parents, lambda p: F.concat(F.lit("parent "), p)), F.array(F.concat(F.lit("author "), who), F.concat(F.lit("committer "), who), F.lit(""), message))
    return F.encode(F.array_join(lines, "\n"), "utf-8")


def commit_fields(payload: Column) -> Column:
    """struct(tree, parents, author, seconds, message) of a commit object; headers that go on in further lines are passed over."""
    text = F.decode(payload, "utf-8")
    head = F.regexp_extract(text, r"(?s)\A(.*?)\n\n", 1)
    return F.struct(
        F.regexp_extract(head, r"(?m)\Atree ([0-9a-f]+)$", 1).alias("tree"), F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]+)$"), F.lit(1)).alias("parents"),
        F.regexp_extract(head, r"(?m)^author (.*) [0-9]+ [+-][0-9]{4}$", 1).alias("author"), F.regexp_extract(head, r"(?m)^author .* ([0-9]+) [+-][0-9]{4}$", 1).cast("long").alias("seconds"),
        F.regexp_extract(text, r"(?s)\A.*?\n\n(.*)\z", 1).alias("message"),
    )


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held), schema)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) == _OUT or size > _BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def project(files: DataFrame, key: str) -> DataFrame:
    """Directories (key, dir, oid, payload) of ``files(key, path, mode, oid)``; the root is the one without a ``dir``.

    A key's directories come in a row, the root last, as ``tree_files`` reads
    them.  A task holds the files of one key at a time; files that are dealt by
    the key are not dealt again.
    """
    files = files.filter(F.col("path").isNotNull() & F.col(key).isNotNull())
    # The number marks a key's first file, and has Spark bring a key's files together.
    files = files.select(key, "path", "mode", "oid", F.row_number().over(Window.partitionBy(key).orderBy(key)).alias("n"))
    text = T.StringType()
    schema = T.StructType([files.schema[key], T.StructField("dir", text), T.StructField("oid", text), T.StructField("payload", T.BinaryType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, now = [], None
        for batch in batches:
            for at, path, mode, oid, n in zip(*(c.to_pylist() for c in batch.columns)):
                if n == 1:
                    if held:
                        yield from ((now, *d) for d in objects.directories(held))
                    held, now = [], at
                held.append((path, mode, oid))
        if held:
            yield from ((now, *d) for d in objects.directories(held))

    arrow = to_arrow_schema(schema)
    return files.mapInArrow(lambda batches: _batches(rows(batches), arrow), schema)


def tree_files(directories: DataFrame, key: str) -> DataFrame:
    """(key, path, mode, oid) of the files that each key's root leads to, parsed from ``directories`` as ``project`` gives them.

    A task holds the directories of one key at a time.
    """
    text = T.StringType()
    schema = T.StructType([directories.schema[key], *[T.StructField(n, text) for n in ("path", "mode", "oid")]])

    def walk(payloads: dict, root: str) -> Iterator[tuple]:
        open_ = [("", root)]
        while open_:
            prefix, tree = open_.pop()
            for mode, name, oid in objects.parse_tree(payloads[tree]):
                if mode == "40000":
                    open_.append((f"{prefix}{name}/", oid))
                else:
                    yield prefix + name, mode, oid

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        payloads, now = {}, None
        for batch in batches:
            for at, dir_, oid, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if payloads and at != now:
                    raise ValueError(f"the directories of {now} do not end in a root")
                now = at
                payloads[oid] = payload
                if dir_ is None:
                    yield from ((now, *f) for f in walk(payloads, oid))
                    payloads = {}
        if payloads:
            raise ValueError(f"the directories of {now} do not end in a root")

    arrow = to_arrow_schema(schema)
    return directories.select(key, "dir", "oid", "payload").mapInArrow(lambda batches: _batches(rows(batches), arrow), schema)


def blob_id(text: Column) -> Column:
    return S.object_id("blob", F.encode(text, "utf-8"))
