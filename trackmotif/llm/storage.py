"""Files in the shared scratch folder, from Python on any node: pyarrow's file systems take the folder's URI."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def create(uri: str) -> Iterator[BinaryIO]:
    """A new file; its folder is made where there is none."""
    system, path = resolve(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        yield out


@contextlib.contextmanager
def open_file(uri: str) -> Iterator[BinaryIO]:
    """A file to seek in."""
    system, path = resolve(uri)
    with system.open_input_file(path) as f:
        yield f


def pack(parts: dict[str, np.ndarray], out: BinaryIO) -> None:
    """Arrays as one file that ``mapped`` reads: a line of JSON with names, types and lengths, then the arrays at multiples of 8."""
    head = json.dumps([(name, x.dtype.str, len(x)) for name, x in parts.items()]).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    out.write(head)
    for x in parts.values():
        data = x.tobytes()
        out.write(data + b"\0" * (-len(data) % 8))


def _arrays(data: np.ndarray, head: bytes) -> dict[str, np.ndarray]:
    parts, at = {}, len(head)
    for name, kind, n in json.loads(head):
        end = at + n * np.dtype(kind).itemsize
        parts[name] = data[at:end].view(kind)
        at = end + -end % 8
    return parts


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a local file, memory-mapped: their pages are the file's, and a node's processes share them."""
    with open(path, "rb") as f:
        return _arrays(np.memmap(path, np.uint8, "r"), f.readline())


def loaded(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file of the shared folder, read into memory."""
    with open_file(uri) as f:
        data = f.read()
    return _arrays(np.frombuffer(data, np.uint8), data[: data.index(b"\n") + 1])
