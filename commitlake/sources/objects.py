"""Repository objects as bytes: trees, deltas and packs, and their relations.

A pack is one value, so the writer closes it at ``pack_bytes`` of contents (a
larger object has a pack of its own) and the reader holds one pack at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: The type numbers of pack entries.
TYPES = {"commit": 1, "tree": 2, "blob": 3, "tag": 4}
OFS_DELTA, REF_DELTA = 6, 7
_NAMES = {number: name for name, number in TYPES.items()}


def object_id(kind: str, payload: bytes) -> str:
    return hashlib.sha1(b"%s %d\0" % (kind.encode(), len(payload)) + payload).hexdigest()


# -- trees


def encode_trees(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., payload, oid) of the trees whose ``entries`` are (keys.., mode, name, oid); mode in octal digits.

    Entries are in byte order of their names, directories as if they ended in a
    slash.  A group is one directory.
    """
    as_sorted = F.when(F.col("mode") == "40000", F.concat("name", F.lit("/"))).otherwise(F.col("name"))
    line = F.concat(F.hex(F.concat_ws(" ", "mode", "name")), F.lit("00"), F.upper("oid"))
    lines = F.array_sort(F.collect_list(F.struct(as_sorted.alias("key"), line.alias("line"))))
    payload = F.unhex(F.array_join(F.transform(lines, lambda x: x["line"]), ""))
    trees = entries.groupBy(*keys).agg(payload.alias("payload"))
    header = F.encode(F.concat(F.lit("tree "), F.octet_length("payload")), "utf-8")
    return trees.withColumn("oid", F.sha1(F.concat(header, F.unhex(F.lit("00")), F.col("payload"))))


def directories(files: list[tuple[str, str, str | None]]) -> Iterator[tuple[str | None, str, bytes]]:
    """(dir, oid, payload) of every directory that the (path, mode, oid) need, the deepest first; the root, which has no path, last."""
    inside: dict[str | None, list] = {None: []}

    def parent_of(path: str) -> tuple[list, bytes]:
        above, slash, name = path.rpartition("/")
        above = above if slash else None
        entries = inside.get(above)
        if entries is None:
            parent_of(above)
            entries = inside[above] = []
        return entries, name.encode()

    for path, mode, oid in files:
        entries, name = parent_of(path)
        if oid is not None:
            entries.append((name + b"/" if mode == "40000" else name, mode.encode() + b" " + name + b"\0" + bytes.fromhex(oid)))
    for path in sorted(inside, key=lambda p: -1 if p is None else p.count("/"), reverse=True):
        payload = b"".join([line for _, line in sorted(inside[path])])
        oid = object_id("tree", payload)
        yield path, oid, payload
        if path is not None:
            entries, name = parent_of(path)
            entries.append((name + b"/", b"40000 " + name + b"\0" + bytes.fromhex(oid)))


def parse_tree(payload: bytes) -> list[tuple[str, str, str]]:
    """The (mode, name, oid) of a tree."""
    out, at = [], 0
    while at < len(payload):
        space, end = payload.index(b" ", at), payload.index(b"\0", at)
        if end + 21 > len(payload):
            raise ValueError("a tree entry is cut off")
        out.append((payload[at:space].decode(), payload[space + 1 : end].decode(), payload[end + 1 : end + 21].hex()))
        at = end + 21
    return out


def _entries(payload: bytes | None) -> list[tuple[str, str, str]] | None:
    return None if payload is None else parse_tree(bytes(payload))


def tree_entries(trees: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., mode, name, oid) of trees with a ``payload``."""
    parsed = F.udf(_entries, "array<struct<mode string, name string, oid string>>", useArrow=True)
    return trees.select(*keys, F.inline(parsed("payload")))


# -- deltas


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The result of copies from ``base`` and inserted bytes; both sizes are checked."""
    before, at = _varint(delta, 0)
    after, at = _varint(delta, at)
    if before != len(base):
        raise ValueError("the delta is of another base")
    out = bytearray()
    while at < len(delta):
        op, at = delta[at], at + 1
        if op & 0x80:
            numbers = [0] * 7
            for bit in range(7):
                if op >> bit & 1:
                    numbers[bit], at = delta[at], at + 1
            start, count = int.from_bytes(bytes(numbers[:4]), "little"), int.from_bytes(bytes(numbers[4:]), "little") or 0x10000
            if start + count > len(base):
                raise ValueError("a copy ends beyond the base")
            out += base[start : start + count]
        elif op:
            if at + op > len(delta):
                raise ValueError("an insertion is cut off")
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("a delta instruction is zero")
    if len(out) != after:
        raise ValueError("the delta gives another size")
    return bytes(out)


# -- packs


def encode_pack(objects: list[tuple[str, bytes]]) -> bytes:
    """A pack of whole (kind, payload) objects in order of their ids, each once."""
    found = {object_id(*o): o for o in objects}
    out = [b"PACK", struct.pack(">II", 2, len(found))]
    for _, (kind, payload) in sorted(found.items()):
        size, head = len(payload), bytearray()
        byte = TYPES[kind] << 4 | size & 15
        size >>= 4
        while size:
            head.append(byte | 0x80)
            byte, size = size & 0x7F, size >> 7
        head.append(byte)
        out += [bytes(head), zlib.compress(payload)]
    body = b"".join(out)
    return body + hashlib.sha1(body).digest()


def _inflate(data: bytes, at: int, size: int) -> tuple[bytes, int]:
    """The stream at ``at``, of ``size`` bytes, and where it ends; read in steps, so the rest of a pack is not copied."""
    stream, out, have = zlib.decompressobj(), [], 0
    while not stream.eof:
        chunk = data[at : min(at + 16384, len(data) - 20)]
        out.append(stream.decompress(chunk))
        have += len(out[-1])
        at += len(chunk) - len(stream.unused_data)
        if have > size or not chunk:
            break
    if have != size or not stream.eof:
        raise ValueError("an object has another size than stated")
    return b"".join(out), at


def scan_pack(data: bytes) -> list[tuple[int, str, bytes]]:
    """The (offset, kind, payload) of all objects of a pack, deltas applied; a base may come later, but from this pack."""
    if len(data) < 32 or data[:4] != b"PACK" or hashlib.sha1(data[:-20]).digest() != data[-20:]:
        raise ValueError("not a pack, or a damaged one")
    version, count = struct.unpack(">II", data[4:12])
    if version not in (2, 3):
        raise ValueError("unknown version of packs")
    done: dict[int, tuple[str, bytes]] = {}
    waiting: dict[object, list[tuple[int, bytes]]] = {}
    at = 12
    for _ in range(count):
        offset, byte, at = at, data[at], at + 1
        number, size, shift = byte >> 4 & 7, byte & 15, 4
        while byte & 0x80:
            byte, at = data[at], at + 1
            size |= (byte & 0x7F) << shift
            shift += 7
        base: object = None
        if number == OFS_DELTA:
            byte, at = data[at], at + 1
            back = byte & 0x7F
            while byte & 0x80:
                byte, at = data[at], at + 1
                back = (back + 1 << 7) | byte & 0x7F
            base = offset - back
        elif number == REF_DELTA:
            base, at = data[at : at + 20].hex(), at + 20
        payload, at = _inflate(data, at, size)
        if base is None:
            done[offset] = (_NAMES[number], payload)
        else:
            waiting.setdefault(base, []).append((offset, payload))
    ready = list(done)
    while ready:
        offset = ready.pop()
        kind, payload = done[offset]
        for child, delta in waiting.pop(offset, []) + waiting.pop(object_id(kind, payload), []):
            done[child] = (kind, apply_delta(payload, delta))
            ready.append(child)
    if waiting:
        raise ValueError("a delta's base is not in the pack")
    return [(offset, *done[offset]) for offset in sorted(done)]


def write_packs(objects: DataFrame, kind: str = "blob", pack_bytes: int = 16 << 20) -> DataFrame:
    """(pack) of the ``payload`` of all rows, without a shuffle; null payloads have no object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([encode_pack(held)], pa.binary())], ["pack"])
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                if payload is None:
                    continue
                if held and size + len(payload) > pack_bytes:
                    yield pack()
                    held, size = [], 0
                held.append((kind, payload))
                size += len(payload)
        if held:
            yield pack()

    return objects.select("payload").mapInArrow(run, "pack binary")


def read_packs(packs: DataFrame) -> DataFrame:
    """(oid, kind, size, offset, payload) of the objects of all packs; one that several packs have comes from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = [{"oid": object_id(k, p), "kind": k, "size": len(p), "offset": o, "payload": p} for o, k, p in scan_pack(data.as_py())]
                yield pa.RecordBatch.from_pylist(rows, ENTRIES)

    return packs.select("pack").filter("pack is not null").mapInArrow(run, "oid string, kind string, size long, offset long, payload binary")


ENTRIES = pa.schema([("oid", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("offset", pa.int64()), ("payload", pa.binary())])


def index_lookup(index: DataFrame, asked: Column | DataFrame) -> DataFrame:
    """The rows of ``index(oid, ..)`` for ids: a condition on ``oid``, or a table of them."""
    return index.filter(asked) if isinstance(asked, Column) else index.join(asked.select("oid").distinct(), "oid", "left_semi")
