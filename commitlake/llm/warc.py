"""WARC archives of Zstandard frames with a dictionary in front.

Writer: each archive starts with a skippable frame (magic 0x184D2A5D) that
holds the dictionary, itself a Zstandard frame; it is trained on the archive's
first ``TRAIN_RECORDS`` records or ``TRAIN_BYTES`` bytes, and left out if these
are too few to train on.  Then comes one frame for each record.  Of records
with equal payloads, that of the smallest page is the response and the others
are revisits of it without a body.

Reader: takes the dictionary from the leading skippable frame (raw or
compressed), passes over other skippable frames, finds every frame's end from
its block headers, decodes one frame at a time, and requires exactly one record
in it: version line, mandatory fields, a block as long as Content-Length, and
the closing empty lines.  Records of all types and with any id are read.  An
HTTP block is cut into its head and its payload, with chunks joined; where the
head states a length, or the record a digest (SHA-1 in base 32 or 16, SHA-256,
MD5), the payload must match it, unless the record is marked as truncated.
Anything else raises ``WarcError``.

Edge cases: null html is an empty payload; payloads below ``least`` bytes are
all responses; if several rows have the smallest page id, all are responses;
rows with a null page id are revisits if another row with that payload has an
id; a null url has no target field, and control characters in urls are
percent-encoded; an empty table gives an empty result.  Only page_id, url and
html are read, so extra columns cannot clash.  Records that are not pages of
this writer have a null page_id; a payload that is not UTF-8 has a null html.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .storage import materialize, open_file, shared_dir, write_file

DICTIONARY_MAGIC, SKIPPABLE_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 200, 1_000_000, 32_768
#: An archive is closed when its records have so many bytes before compression.
ARCHIVE_BYTES = 64_000_000
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive, frame or record that is not as the format demands."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(uri: str | None) -> int | None:
    """The page of a record id of this writer."""
    value = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


def build_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _uri(page)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    if revisit:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", _uri(refers_to)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> list[bytes]:
    """The parts of an archive of ``records``."""
    samples, size = [], 0
    for r in records[:TRAIN_RECORDS]:
        if size >= TRAIN_BYTES:
            break
        samples.append(r)
        size += len(r)
    parts, trained = [], None
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        pass  # too few samples: no dictionary
    if trained is not None:
        body = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes())
        parts.append(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
    packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)
    return parts + [packer.compress(r) for r in records]


def frame_size(f, at: int) -> int:
    """Bytes of the Zstandard frame at ``at``, from its header and block headers."""
    f.seek(at)
    head = f.read(18)
    if len(head) < 6 or struct.unpack_from("<I", head)[0] != FRAME_MAGIC:
        raise WarcError(f"no frame at byte {at}")
    flags = head[4]
    single = flags >> 5 & 1
    size = 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        f.seek(at + size)
        block = f.read(3)
        if len(block) < 3:
            raise WarcError(f"the frame at byte {at} is cut off")
        value = int.from_bytes(block, "little")
        last, kind, length = bool(value & 1), value >> 1 & 3, value >> 3
        size += 3 + (1 if kind == 1 else length)
    return size + 4 * (flags >> 2 & 1)


def _joined_chunks(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line, end, _ = body[at : at + 1024].partition(b"\r\n")
        digits = line.split(b";")[0].strip()
        try:
            size = int(digits, 16)
        except ValueError:
            raise WarcError(f"bad chunk size {digits!r}") from None
        at += len(line) + 2
        if not end or at + size > len(body):
            raise WarcError("a chunk is cut off")
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        at += size + 2


def _http(block: bytes) -> tuple[bytes, int | None]:
    """Payload and stated length of an HTTP message."""
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]) if colon}
    if b"chunked" in fields.get(b"transfer-encoding", b"").lower() and payload:
        return _joined_chunks(payload), None
    length = fields.get(b"content-length", b"")
    return payload, int(length) if length.isdigit() else None


def _matches(payload: bytes, claimed: str) -> bool:
    """Whether a labelled digest is that of ``payload``; unknown algorithms cannot be tested."""
    name, _, value = claimed.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "md5"):
        return True
    raw = hashlib.new(name, payload).digest()
    return value.strip().lower().rstrip("=") in (raw.hex(), base64.b32encode(raw).decode().lower().rstrip("="))


def parse_record(data: bytes) -> dict:
    """Fields and payload of the one record in ``data``, validated."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no version line")
    fields: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += f" {line.strip()}"
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise WarcError(f"bad field {line!r}")
        fields[name] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"no {name}")
    if not (fields["content-length"].isascii() and fields["content-length"].isdigit()) or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError("the block is not as long as Content-Length, or not one record")
    block, kind = rest[:-4], fields["warc-type"].lower()
    if "warc-block-digest" in fields and not _matches(block, fields["warc-block-digest"]):
        raise WarcError("the block does not match its digest")
    http = fields.get("content-type", "").lower().startswith("application/http")
    payload, length = _http(block) if http else (block, None)
    claimed = fields.get("warc-payload-digest", "")
    if kind != "revisit" and "warc-truncated" not in fields:
        if length is not None and length != len(payload):
            raise WarcError("the payload does not match its length")
        raw = block.partition(b"\r\n\r\n")[2] if http else block
        # Writers differ in whether they take the digest of a chunked body before or after it is joined.
        if claimed and not _matches(payload, claimed) and not _matches(raw, claimed):
            raise WarcError("the payload does not match its digest")
    found = claimed.partition(":")[2].strip() if claimed.lower().startswith("sha1:") else None if kind == "revisit" else digest(payload)
    return {"fields": fields, "type": kind, "payload": payload, "bytes": length if kind == "revisit" and length is not None else len(payload), "digest": found}


def read_archive(path: str) -> Iterator[dict]:
    with open_file(path) as f:
        end = f.seek(0, 2)
        at, unpacker = 0, zstandard.ZstdDecompressor()
        while at < end:
            f.seek(at)
            head = f.read(8)
            magic, length = struct.unpack("<II", head.ljust(8, b"\0"))
            if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
                if len(head) < 8 or at + 8 + length > end:
                    raise WarcError("a skippable frame is cut off")
                if magic == DICTIONARY_MAGIC and at == 0:
                    body = f.read(length)
                    try:
                        if body[:4] == struct.pack("<I", FRAME_MAGIC):
                            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
                    except zstandard.ZstdError as error:
                        raise WarcError(f"bad dictionary: {error}") from error
                at += 8 + length
                continue
            size = frame_size(f, at)
            f.seek(at)
            frame = f.read(size)
            if len(frame) < size:
                raise WarcError(f"the frame at byte {at} is cut off")
            try:
                record = unpacker.decompressobj().decompress(frame)
            except zstandard.ZstdError as error:
                raise WarcError(f"bad frame at byte {at}: {error}") from error
            yield parse_record(record)
            at += size


def write_warc(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; returns the manifest (path, records), a table in the shared folder."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary"))))
    same = rows.filter(F.octet_length("html") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Only payloads that come back; read from a table, so that its size decides how it is joined.
    same = materialize(same.filter("n > 1").select("sha1", "first"), "warc-payloads")
    rows = rows.join(same, "sha1", "left").withColumn("first", F.when(F.octet_length("html") >= least, F.col("first")))
    rows = rows.withColumn("revisit", F.coalesce(~F.col("first").eqNullSafe(F.col("page_id")) & F.col("first").isNotNull(), F.lit(False)))
    rows = rows.select("page_id", "url", "html", "first", "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, file = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{file:05d}.warc.zst"
            write_file(path, archive(held))
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(held)], pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, first, revisit = (batch.column(c)[i].as_py() for c in range(5))
                held.append(build_record(page, url, html.encode("utf-8", "surrogatepass"), first, revisit))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size, file = [], 0, file + 1
        if held:
            yield close()

    return materialize(rows.mapInArrow(run, "path string, records long"), "warc-manifest")


def read_warc(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id, refers_to_id and, if asked for, the html (null on revisits)."""
    files = manifest.select("path").repartition(max(1, min(manifest.count(), 4096)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for record in read_archive(path):
                    f, kind = record["fields"], record["type"]
                    refers = f.get("warc-refers-to") if kind == "revisit" else None
                    html = None
                    if with_payload and kind != "revisit":
                        try:
                            html = record["payload"].decode("utf-8", "surrogatepass")
                        except UnicodeDecodeError:
                            pass  # not a text
                    rows.append((_page(f["warc-record-id"]), record["bytes"], record["digest"], kind, _page(refers), f.get("warc-target-uri"), f["warc-record-id"], refers, html))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "refers_to_id", "html"]
    out = files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, refers_to_id string, html string")
    return out if with_payload else out.drop("html")


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages into a new shared folder and read them back."""
    return read_warc(write_warc(pages, shared_dir(pages.sparkSession, "warc"), least))
