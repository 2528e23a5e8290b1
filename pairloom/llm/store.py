"""Files that Python tasks write and read in the shared folder, whole or by range."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    part = urlparse(uri)
    return unquote(part.path) if part.scheme in ("", "file") else None


def _remote(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Writes the chunks under another name and then renames: a task that is lost or run twice leaves one whole file. Returns the bytes."""
    temp, size = f"{uri}.{uuid.uuid4().hex}.part", 0
    path = _local(uri)
    if path is not None:
        temp = _local(temp)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(temp, "wb") as f:
            for c in chunks:
                f.write(c)
                size += len(c)
        os.replace(temp, path)
        return size
    fs, at = _remote(uri)
    _, temp = _remote(temp)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(temp) as f:
        for c in chunks:
            f.write(c)
            size += len(c)
    fs.move(temp, at)
    return size


class Reader:
    """Range reads of one file."""

    def __init__(self, uri: str):
        path = _local(uri)
        if path is not None:
            self.f, self.size = open(path, "rb"), os.path.getsize(path)
        else:
            fs, at = _remote(uri)
            self.f = fs.open_input_file(at)
            self.size = self.f.size()

    def read(self, offset: int, length: int) -> bytes:
        self.f.seek(offset)
        out = self.f.read(length)
        if len(out) != length:
            raise ValueError(f"file ends before {offset + length}")
        return out

    def __enter__(self):
        return self

    def __exit__(self, *a):
        self.f.close()
