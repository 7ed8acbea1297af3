"""Files that executors write and read themselves, in the folder that all machines share.

A task names its files with a token of its own attempt and returns the names as rows; what
a lost or repeated attempt left behind is never in the table of names that Spark commits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def new(folder: str, name: str) -> Iterator[tuple[str, BinaryIO]]:
    """A new file's URI and a stream to write to it."""
    uri = f"{folder}/{uuid.uuid4().hex}-{name}"
    where, path = _open(uri)
    if isinstance(where, fs.LocalFileSystem):
        where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(path, compression=None, buffer_size=1 << 18) as out:
        yield uri, out


def put(folder: str, name: str, data: bytes) -> str:
    """Write ``data`` as a new file and return its URI."""
    with new(folder, name) as (uri, out):
        out.write(data)
    return uri


def get(uri: str) -> bytes:
    where, path = _open(uri)
    with where.open_input_stream(path, compression=None) as f:
        return f.read()


def lines(uri: str) -> Iterator[bytes]:
    """A file's lines, a bounded piece of it in memory at a time."""
    left = b""
    for piece in pieces(uri):
        *whole, left = (left + piece).split(b"\n")
        yield from whole
    if left:
        yield left


def spans(uri: str, places: Iterable[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes at each (offset, length) of a file."""
    where, path = _open(uri)
    with where.open_input_file(path) as f:
        for offset, length in places:
            yield f.read_at(length, offset)


def remove(uri: str) -> None:
    """Delete a file; one that a lost attempt has deleted already is no error."""
    where, path = _open(uri)
    if where.get_file_info(path).type != fs.FileType.NotFound:
        where.delete_file(path)


def pieces(uri: str, size: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes from its start, ``size`` at a time."""
    where, path = _open(uri)
    with where.open_input_stream(path, compression=None) as f:
        while piece := f.read(size):
            yield piece
