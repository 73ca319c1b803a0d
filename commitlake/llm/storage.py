"""Files in the folder that the whole cluster shares, and its tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from pathlib import PurePosixPath

from pyarrow import fs

from ..plans.cut import materialize, shared_dir

__all__ = ["materialize", "open_file", "read_file", "shared_dir", "write_file"]


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_file(path: str, parts: Iterable[bytes]) -> int:
    """Write a file under a name of its own and move it into place, so that a repeated task replaces it whole."""
    store, at = _filesystem(path)
    store.create_dir(str(PurePosixPath(at).parent), recursive=True)
    temporary, size = f"{at}.{uuid.uuid4().hex}.tmp", 0
    with store.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    store.move(temporary, at)
    return size


def read_file(path: str) -> bytes:
    store, at = _filesystem(path)
    with store.open_input_stream(at) as source:
        return source.read()


def open_file(path: str):
    """A seekable file."""
    store, at = _filesystem(path)
    return store.open_input_file(at)

