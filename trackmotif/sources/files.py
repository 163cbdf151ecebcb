"""Text files of exports: a path of the local file system, or a URI that pyarrow's file systems take."""

from __future__ import annotations

import contextlib
import io
from collections.abc import Iterator
from typing import TextIO

from pyarrow import fs
from pyspark.sql import DataFrame


@contextlib.contextmanager
def create(path: str) -> Iterator[TextIO]:
    """A new UTF-8 file; its folder is made where there is none."""
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    folder = name.rpartition("/")[0]
    if folder:
        system.create_dir(folder, recursive=True)
    with system.open_output_stream(name, compression=None) as raw, io.TextIOWrapper(raw, "utf-8", newline="\n") as out:
        yield out


def write_lines(rows: DataFrame, path: str, *order: str, parts: bool = False) -> None:
    """The column line of ``rows``, by ``order``: as one file, or with ``parts`` as a folder of files that tasks write side by
    side, each with a range of the order, whose names' order is that of their lines: joined, they are the one file.

    One file is streamed a part at a time; what is held is a part.
    """
    ordered = rows.orderBy(*order).select("line")
    if parts:
        ordered.write.text(path)
        return
    with create(path) as f:
        for r in ordered.toLocalIterator():
            f.write(r.line + "\n")
