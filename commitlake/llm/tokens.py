"""Token ids in patched frame-of-reference blocks.

File: ``CLT1``; the blocks; the document table (doc_id int64, null flag u8,
number of ids int64); the block starts (u64 offsets in the file); and a tail of
seven u64 (offsets of both tables, numbers of documents, blocks and ids, block
size, and 0) and ``CLT1`` again.  All numbers are little-endian.

Block: minimum u32, width u8, exceptions u16, then the low ``width`` bits of
(id - minimum) for every id, then the exceptions' positions (u16) and whole
differences (u32).  The width is the bit length that ``percentile`` of the
block's differences fit; what is wider is an exception.  The last block is
padded with its minimum.  Any id can be read by its block's start alone.

Edge cases: a null or empty text is the end id only; rows come in ascending
(doc_id, hash of the text) order, nulls first, so repeated rows stay apart and
have a place each; one document may span any number of blocks, and a file holds
whole documents; an empty table gives no files and an empty result.  Only the
id and text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .storage import materialize, open_file, read_file, shared_dir, write_file

MAGIC = b"CLT1"
HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<i8")])
TAIL = struct.Struct("<7Q4s")
BLOCK, PERCENTILE = 256, 0.95
#: A file is closed when it holds so many ids.
FILE_IDS = 2_000_000
_STEP = 2048  # blocks that are packed at a time


def _bits(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of ``ids`` (below 2**32)."""
    out: list[bytes] = []
    for at in range(0, len(ids), block * _STEP):
        part = np.asarray(ids[at : at + block * _STEP], np.uint32)
        whole = np.full((-(-len(part) // block), block), part[-(len(part) % block or block) :].min(), np.uint32)
        whole.reshape(-1)[: len(part)] = part
        least = whole.min(axis=1)
        rest = whole - least[:, None]
        bits = _bits(rest)
        rank = min(block - 1, int(np.ceil(percentile * block)) - 1)
        width = np.partition(bits, rank, axis=1)[:, rank]
        wide = bits > width[:, None]
        count = wide.sum(axis=1)
        packed: list[bytes] = [b""] * len(whole)
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            if w:
                lines, size = _pack(rest[rows], w).tobytes(), (block * w + 7) // 8
                for i, r in enumerate(rows.tolist()):
                    packed[r] = lines[i * size : (i + 1) * size]
        heads = np.zeros(len(whole), HEAD)
        heads["least"], heads["width"], heads["exceptions"] = least, width, count
        head, step = heads.tobytes(), HEAD.itemsize
        # Exceptions in turn: those of a block are a slice of all.
        where = np.nonzero(wide)
        places, values = where[1].astype("<u2").tobytes(), rest[where].astype("<u4").tobytes()
        upto = np.cumsum(count).tolist()
        for r, (a, b) in enumerate(zip([0, *upto], upto)):
            out.append(b"".join((head[r * step : (r + 1) * step], packed[r], places[2 * a : 2 * b], values[4 * a : 4 * b])))
    return out


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each row's values, as bytes; eight values make ``width`` bytes."""
    rows, block = values.shape
    cells = np.pad(values & np.uint32((1 << width) - 1), ((0, 0), (0, -block % 8))).reshape(-1, 8)
    column = np.ascontiguousarray(cells.T)
    out = np.empty((len(cells), width), np.uint8)
    for byte in range(width):
        low = 8 * byte
        parts = [column[j] << (j * width - low) if j * width >= low else column[j] >> (low - j * width) for j in range(low // width, (low + 7) // width + 1)]
        out[:, byte] = np.bitwise_or.reduce(parts) if len(parts) > 1 else parts[0]
    return out.reshape(rows, -1)[:, : (block * width + 7) // 8]


def _unpack(lines: np.ndarray, width: int, block: int) -> np.ndarray:
    """The values of rows of bytes."""
    rows, size = lines.shape
    cells = np.pad(lines, ((0, 0), (0, -(-block // 8) * width - size))).reshape(-1, width)
    column = np.ascontiguousarray(cells.T).astype(np.uint32 if width <= 25 else np.uint64)
    out = np.empty((len(cells), 8), np.uint32)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        value = column[first] >> shift
        for i in range(first + 1, (j * width + width - 1) // 8 + 1):
            value |= column[i] << (8 * (i - first) - shift)
        out[:, j] = value & ((1 << width) - 1)
    return out.reshape(rows, -1)[:, :block]


def _slices(data: memoryview, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    return b"".join([data[a:b] for a, b in zip(starts.tolist(), (starts + sizes).tolist())])


def decode_blocks(data: bytes, starts: np.ndarray, block: int) -> np.ndarray:
    """The ids of the blocks at ``starts``, padding included."""
    out = np.empty((len(starts), block), np.uint32)
    view = memoryview(data)
    for at in range(0, len(starts), _STEP):
        here = starts[at : at + _STEP].astype(np.int64)
        heads = np.frombuffer(_slices(view, here, np.full(len(here), HEAD.itemsize)), HEAD)
        part = np.zeros((len(here), block), np.uint32)
        sizes = (heads["width"].astype(np.int64) * block + 7) // 8
        for w in np.unique(heads["width"]).tolist():
            if w:
                rows = np.flatnonzero(heads["width"] == w)
                lines = np.frombuffer(_slices(view, here[rows] + HEAD.itemsize, sizes[rows]), np.uint8)
                part[rows] = _unpack(lines.reshape(len(rows), -1), w, block)
        rows = np.flatnonzero(heads["exceptions"])
        if len(rows):
            count, begin = heads["exceptions"][rows].astype(np.int64), here[rows] + HEAD.itemsize + sizes[rows]
            where = np.frombuffer(_slices(view, begin, 2 * count), "<u2")
            part[np.repeat(rows, count), where] = np.frombuffer(_slices(view, begin + 2 * count, 4 * count), "<u4")
        out[at : at + _STEP] = part + heads["least"][:, None]
    return out.reshape(-1)


def encode_file(docs: list[tuple[int | None, np.ndarray]], block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    ids = np.concatenate([x for _, x in docs]) if docs else np.empty(0, np.uint32)
    blocks = encode_blocks(ids, block, percentile)
    sizes = np.array([len(b) for b in blocks], np.uint64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype("<u8") + 4 if blocks else np.empty(0, "<u8")
    table = np.array([(d or 0, d is None, len(x)) for d, x in docs], DOC)
    docs_at = 4 + int(sizes.sum())
    tail = TAIL.pack(docs_at, docs_at + table.nbytes, len(docs), len(blocks), len(ids), block, 0, MAGIC)
    return b"".join([MAGIC, *blocks, table.tobytes(), starts.astype("<u8").tobytes(), tail])


def decode_file(data: bytes) -> list[tuple[int | None, np.ndarray]]:
    docs_at, starts_at, n_docs, n_blocks, n_ids, block, _, magic = TAIL.unpack(data[-TAIL.size :])
    if magic != MAGIC or data[:4] != MAGIC:
        raise ValueError("not a token file")
    table = np.frombuffer(data, DOC, n_docs, docs_at)
    ids = decode_blocks(data, np.frombuffer(data, "<u8", n_blocks, starts_at), block)[:n_ids]
    ends = np.cumsum(table["n"])
    return [(None if d["null"] else int(d["doc_id"]), ids[e - d["n"] : e]) for d, e in zip(table, ends.tolist())]


def read_span(path: str, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a file, reading only the blocks that hold them."""
    with open_file(path) as f:
        size = f.seek(0, 2)
        f.seek(size - TAIL.size)
        docs_at, starts_at, _, n_blocks, n_ids, block, _, _ = TAIL.unpack(f.read(TAIL.size))
        count = max(0, min(count, n_ids - start))
        if not count:
            return np.empty(0, np.uint32)
        first, last = start // block, (start + count - 1) // block
        f.seek(starts_at + 8 * first)
        starts = np.frombuffer(f.read(8 * min(last - first + 2, n_blocks - first)), "<u8")
        begin, end = int(starts[0]), int(starts[last - first + 1]) if last + 1 < n_blocks else docs_at
        f.seek(begin)
        ids = decode_blocks(f.read(end - begin), starts[: last - first + 1] - np.uint64(begin), block)
        return ids[start - first * block :][:count]


class Words:
    """Ids of whole texts, by way of their pieces between spaces and line ends.

    If the tokenizer's splitter never joins what white space parts (which is
    tried on a probe), the ids of a text are those of its pieces in turn, and
    pieces that come back need not be encoded again.  To have fewer of them,
    ASCII capitals, which such a tokenizer lowers itself, are lowered first, and
    symbols between a letter or digit and white space, which the splitter cuts
    off too, are a piece.  A piece of Latin-1 small letters alone goes straight
    to the tokenizer's model.  The memo's ids lie in one array, and a full memo
    keeps what was used last, up to half its limit.  Texts that
    name a special token, or have a combining mark (which composes with a small
    letter otherwise than with its capital), are encoded whole, as are all texts
    by any other tokenizer.
    """

    LIMIT, LONGEST = 400_000, 40
    #: Characters of text that are encoded at a time, but for longer documents.
    STEP = 2_000_000
    #: Symbols after a letter or digit, up to white space or the end (RE2).
    MARK = r"([a-z0-9\x{df}-\x{f6}\x{f8}-\x{ff}])([!-&(-/:-@\[-`{-~]+)([ \n]|\z)"
    #: Combining marks (RE2).
    JOINING = r"\p{M}"
    PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
    PROBE = ["The", "naïve", "straße,", "it's.", "x2***", "don't", "3.14;", "of"]

    def __init__(self, path: str | None = None, definition: str | None = None) -> None:
        """``definition``: the tokenizer's JSON, in place of a file of it."""
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition or read_file(path).decode("utf-8"))
        self.model = self.tokenizer.model
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.as_it_is = "(?i)" + "|".join([self.JOINING, *map(re.escape, special)])
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        small = [*range(0xDF, 0xF7), *range(0xF8, 0x100)]
        self.bytes = {chr(c): "".join(x for x, _ in level.pre_tokenize_str(chr(c))) for c in small}
        #: Pieces to their places: ``values`` from byte ``starts`` of a place up to that of the next.
        self.memo: dict[str, int] = {}
        self.values, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)
        #: The step that used a place last.
        self.used, self.steps = np.empty(0, np.int64), 0
        want = self._whole("\n".join(self.PROBE) + " " + " ".join(self.PROBE))
        self.parts = want == [i for p in self.PROBE * 2 for q in re.sub(r"(\w)([.,;*]+)$", r"\1 \2", p.lower()).split() for i in self._whole(q)]
        tried = ["of", "straße", "ñandú", "élève"]
        self.direct = self._direct(tried) == [self._whole(p) for p in tried]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _direct(self, pieces: list[str]) -> list[list[int]]:
        """The model's ids; pieces are put into its byte letters many at once."""
        joined = "\n".join(pieces)
        if not joined.isascii():
            for letter, written in self.bytes.items():
                joined = joined.replace(letter, written)
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(p)] for p in joined.split("\n")] if pieces else []

    def _encoded(self, pieces: list[str]) -> list[list[int]]:
        plain = [self.PLAIN(p) is not None for p in pieces] if self.direct else [False] * len(pieces)
        direct = iter(self._direct(list(compress(pieces, plain))))
        rest = iter(self.tokenizer.encode_batch_fast([p for p, x in zip(pieces, plain) if not x], add_special_tokens=False))
        return [next(direct) if x else next(rest).ids for x in plain]

    def _forget(self) -> np.ndarray:
        """Keep what was used last; the new place, or -1, of each old one, and -1 at the end."""
        over = len(self.memo) - self.LIMIT // 2
        kept = self.used > (np.partition(self.used, over - 1)[over - 1] if over > 0 else -1)
        sizes = np.diff(self.starts)
        self.memo = {p: i for i, p in enumerate(compress(self.memo, kept.tolist()))}
        self.values, self.used = self.values[np.repeat(kept, sizes // 4)], self.used[kept]
        self.starts = np.concatenate(([0], np.cumsum(sizes[kept])))
        return np.append(np.where(kept, np.cumsum(kept) - 1, -1), -1)

    def _ids(self, pieces: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``pieces[kinds]`` in turn, and where each begins (and the last ends); ``pieces`` are distinct."""
        self.steps += 1
        places = np.fromiter(map(self.memo.get, pieces, repeat(-1)), np.int64, len(pieces))
        self.used[places[places >= 0]] = self.steps
        if len(self.memo) + np.count_nonzero(places < 0) > self.LIMIT:
            places = self._forget()[places]
        # Long pieces come last, for this step only.
        new = sorted(np.flatnonzero(places < 0).tolist(), key=lambda i: len(pieces[i]) > self.LONGEST)
        found, size = self._encoded([pieces[i] for i in new]), len(self.memo)
        places[new] = np.arange(size, size + len(new))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        values = np.concatenate((self.values, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))))
        starts = np.concatenate((self.starts, self.starts[-1] + 4 * np.cumsum(sizes)))
        self.memo |= {pieces[i]: n for n, i in enumerate(new, size) if len(pieces[i]) <= self.LONGEST}
        size = len(self.memo)
        self.values, self.starts = values[: starts[size] // 4], starts[: size + 1]
        self.used = np.append(self.used, np.full(size - len(self.used), self.steps))
        stored = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(values)])
        taken = stored.take(pa.array(places[kinds]))
        begins = np.frombuffer(taken.buffers()[1], np.int64, len(kinds) + 1) // 4 if len(kinds) else np.zeros(1, np.int64)
        return np.frombuffer(taken.buffers()[2], np.uint32, begins[-1]) if begins[-1] else values[:0], begins

    def encode_all(self, texts: pa.Array, end_id: int | None) -> list[np.ndarray]:
        """The ids of each text, with the end id; null is an empty text."""
        return list(self.encode_each(texts, end_id))

    def encode_each(self, texts: pa.Array, end_id: int | None) -> Iterator[np.ndarray]:
        """As ``encode_all``, holding the ids of one step at a time."""
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)), 0
        while at < len(texts):
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.STEP, "right"))
            # A copy: Arrow's lower-casing mistakes the offsets of a slice.
            upto = max(at + 1, upto)
            step = texts.take(pa.array(np.arange(at, upto))).cast(pa.large_string())
            yield from self._step(pc.fill_null(step, ""), end_id)
            at = upto

    def _step(self, texts: pa.Array, end_id: int | None) -> list[np.ndarray]:
        tail = [] if end_id is None else [end_id]
        odd = pc.match_substring_regex(texts, self.as_it_is).to_numpy(zero_copy_only=False) if self.parts else np.ones(len(texts), bool)
        whole = {int(i): np.array(self._whole(texts[int(i)].as_py()) + tail, np.uint32) for i in np.flatnonzero(odd)}
        if not self.parts:
            return [whole[i] for i in range(len(texts))]
        texts = pc.ascii_lower(texts.take(pa.array(np.flatnonzero(~odd))))
        texts = pc.replace_substring(pc.replace_substring_regex(texts, self.MARK, r"\1 \2\3"), "\n", " ")
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        ids, begins = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy())
        cuts = begins[np.cumsum(pc.list_value_length(lists).to_numpy())]
        end = np.array(tail, np.uint32)
        part = (np.concatenate((ids[a:b], end)) for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()))
        return [whole[i] if i in whole else next(part) for i in range(len(odd))]

    def encode(self, text: str | None, end_id: int | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.large_string()), end_id)[0]


_WORDS: dict[int, Words] = {}


def _words(definition: str) -> Words:
    """One for each worker and tokenizer, so that its memo outlives a task."""
    key = hash(definition)
    if key not in _WORDS:
        _WORDS[key] = Words(definition=definition)
    return _WORDS[key]


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = 2, id_col: str = "doc_id",
                 text_col: str = "text", file_ids: int = FILE_IDS, block: int = BLOCK, percentile: float = PERCENTILE) -> DataFrame:
    """Encode and write; the manifest (part, file, path, n_docs, n_ids), a table in the shared folder.

    Files follow one another in (part, file) order.  The tokenizer's JSON, of
    some megabytes, is read by the driver and broadcast.
    """
    definition = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer_path).decode("utf-8"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part = _words(definition.value), TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        count = file = 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{file:05d}.clt"
            write_file(path, [encode_file(held, block, percentile)])
            return pa.RecordBatch.from_pydict({"part": [part], "file": [file], "path": [path], "n_docs": [len(held)], "n_ids": [count]}, MANIFEST)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode_each(batch.column(1), end_id)):
                held.append((doc_id, ids))
                count += len(ids)
                if count >= file_ids:
                    yield close()
                    held, count, file = [], 0, file + 1
        if held:
            yield close()

    return materialize(rows.mapInArrow(run, "part long, file long, path string, n_docs long, n_ids long"), "tokens-manifest")


MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids, from the files themselves."""
    # One row for each part: as many as the writing job had tasks.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    base, at = {}, 0
    for r in parts:
        base[r["part"]] = at
        at += r["n"]
    spark = manifest.sparkSession
    offsets = spark.createDataFrame(list(base.items()) or [(0, 0)], "part long, base long")
    from pyspark.sql import Window

    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("inside", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(offsets, "part")
    files = files.select("path", (F.col("base") + F.col("inside")).alias("start"))
    files = files.repartition(max(1, min(manifest.count(), 4096)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs = decode_file(read_file(path))
                sizes = [len(x) for _, x in docs]
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) + start
                out = {
                    "doc_id": pa.array([d for d, _ in docs], pa.int64()),
                    "start": pa.array(starts.tolist(), pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in docs], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([x.tolist() for _, x in docs], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def tokenized(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the files into a new shared folder and read them back."""
    folder = shared_dir(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer_path, folder, **options))
