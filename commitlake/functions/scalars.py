"""Scalar functions of repository queries, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def object_id(kind: str, payload: Column) -> Column:
    """SHA-1 of the framed object."""
    head = F.concat(F.lit(f"{kind} "), F.octet_length(payload).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), payload))


def content_id(payload: Column) -> Column:
    return F.sha2(payload, 256)


def is_binary(payload: Column) -> Column:
    """A NUL among the first 8000 bytes."""
    return F.contains(F.substring(payload, 1, 8000), F.unhex(F.lit("00")))


def strict_utf8(payload: Column) -> Column:
    return F.is_valid_utf8(payload) & ~F.contains(payload, F.unhex(F.lit("00")))


def extension(path: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(path, "[.]([^./]+)$", 1)), F.lit(""))


def octal_mode(mode: Column) -> Column:
    return F.lpad(F.conv(mode.cast("string"), 10, 8), 6, "0")


def normalize_path(path: Column) -> Column:
    """Without leading slash and ``.``; blank paths and ``..`` raise an error."""
    parts = F.filter(F.split(F.regexp_replace(path, "\\\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    bad = (F.size(parts) == 0) | F.array_contains(parts, "..")
    return F.when(bad, F.raise_error(F.concat(F.lit("bad path: "), path))).otherwise(F.array_join(parts, "/"))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, summed in double precision."""
    zero = F.lit(0.0)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), zero, lambda s, v: s + v)

    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tracking_name(name: Column, remote: str) -> Column:
    """The local name under which a remote's branch is followed; other names stay."""
    head = "refs/heads/"
    return F.when(name.startswith(head), F.concat(F.lit(f"refs/remotes/{remote}/"), F.substring(name, F.lit(len(head) + 1), F.length(name)))).otherwise(name)
