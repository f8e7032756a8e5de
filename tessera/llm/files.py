"""Files of own formats in any store that pyarrow knows; plain paths are local or mounted ones."""

from __future__ import annotations

import os
from urllib.parse import urlparse


def _store(path: str):
    from pyarrow import fs

    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def open_output(path: str):
    store, inside = _store(path)
    store.create_dir(os.path.dirname(inside), recursive=True)
    return store.open_output_stream(inside)


def open_input(path: str):
    store, inside = _store(path)
    return store.open_input_file(inside)


def listing(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """Path and size of the files of a folder, or of the file itself, in order of their names."""
    from pyarrow import fs

    store, inside = _store(path)
    prefix = path[: len(path) - len(inside)] if path.endswith(inside) else f"{urlparse(path).scheme}://{urlparse(path).netloc}"
    info = store.get_file_info(inside)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside, recursive=True))
    return sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(suffixes))


def delete(spark, path: str) -> None:
    """Remove a folder of intermediate files, in any store that Spark reads."""
    inside = spark._jvm.org.apache.hadoop.fs.Path(path)
    inside.getFileSystem(spark._jsc.hadoopConfiguration()).delete(inside, True)
