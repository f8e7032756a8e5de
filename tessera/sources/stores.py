"""Files of any store that pyarrow knows; plain paths are local or mounted ones."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def exists(path: str) -> bool:
    store, inside = store_of(path)
    return store.get_file_info(inside).type == fs.FileType.File


def read_bytes(path: str) -> bytes:
    store, inside = store_of(path)
    with store.open_input_stream(inside) as f:
        return f.read()


def open_new(path: str):
    """A stream to a new file; folders above it are made."""
    store, inside = store_of(path)
    store.create_dir(os.path.dirname(inside), recursive=True)
    return store.open_output_stream(inside)


def put_whole(path: str, data: bytes) -> None:
    """Write a file under a hidden name first, so that nobody ever sees a part of it."""
    store, inside = store_of(path)
    store.create_dir(os.path.dirname(inside), recursive=True)
    put_hidden(store, inside, data)


def put_hidden(store: fs.FileSystem, inside: str, data: bytes | pa.Buffer) -> None:
    """The same for a path inside a store, whose folder is there."""
    folder, name = os.path.split(inside)
    hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as f:
        f.write(data)
    store.move(hidden, inside)


def children(path: str) -> list[str]:
    """Names of the folders and files in a folder, in order."""
    store, inside = store_of(path)
    return sorted(x.base_name for x in store.get_file_info(fs.FileSelector(inside)))


def file_names(path: str) -> Iterator[str]:
    """Names of the files in a folder in no order; those of a local one come as they are read."""
    store, inside = store_of(path)
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(inside) as found:
            yield from (x.name for x in found if x.is_file())
    else:
        yield from (x.base_name for x in store.get_file_info(fs.FileSelector(inside)) if x.type == fs.FileType.File)


def is_missing(path: str) -> bool:
    store, inside = store_of(path)
    return store.get_file_info(inside).type == fs.FileType.NotFound


def remove(path: str) -> None:
    store, inside = store_of(path)
    store.delete_file(inside)


def is_empty(path: str) -> bool:
    """Whether a folder is missing or holds nothing."""
    store, inside = store_of(path)
    return store.get_file_info(inside).type == fs.FileType.NotFound or not store.get_file_info(fs.FileSelector(inside))
