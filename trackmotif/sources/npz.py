"""Format "npz": a tensor of (examples, 4, positions) in an .npz (key arr_0) or .npy file, as rows of positions.

A partition is a range of examples, which is read at its place in the file. A compressed member has no places: it is one
partition, which inflates it once, an example at a time, and one beyond ``packed_bytes`` (an option) is refused, as what one
task would take too long for. Paths are local, or URIs that pyarrow's file systems take.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trackmotif.session import ship_package

KEY, ROWS = "arr_0", 1024
#: Bytes that a compressed tensor may have when it is inflated.
PACKED_BYTES = 32 << 30


def _header(f) -> tuple[tuple, np.dtype, bool]:
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(f)
    return shape, kind, fortran


def _open(path: str):
    """The array's bytes, and whether they are compressed."""
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    f = system.open_input_file(name)
    if not path.endswith(".npz"):
        return f, False
    archive = zipfile.ZipFile(f)
    return archive.open(f"{KEY}.npy"), archive.getinfo(f"{KEY}.npy").compress_type != zipfile.ZIP_STORED


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class NpzReader(DataSourceReader):
    def __init__(self, path: str, rows: int, packed_bytes: int):
        self.path, self.rows, self.packed_bytes = path, rows, packed_bytes

    def partitions(self) -> list[Rows]:
        f, packed = _open(self.path)
        with f:
            shape, kind, fortran = _header(f)
        if packed and (size := int(np.prod(shape)) * kind.itemsize) > self.packed_bytes:
            raise ValueError(f"{self.path}: {size} compressed bytes are more than one task should inflate ({self.packed_bytes}); save the array uncompressed")
        if len(shape) != 3 or shape[1] != 4 or fortran:
            raise ValueError(f"{self.path}: (examples, 4, positions) in C order is needed, not {shape}")
        step = max(1, shape[0]) if packed else self.rows
        return [Rows(k, min(k + step, shape[0])) for k in range(0, shape[0], step)]

    def read(self, partition: Rows | None) -> Iterator[tuple]:
        if partition is None:
            return
        with _open(self.path)[0] as f:
            shape, kind, _ = _header(f)
            size = shape[1] * shape[2] * kind.itemsize
            f.seek(f.tell() + partition.first * size)
            for k in range(partition.first, partition.last):
                yield k, np.frombuffer(f.read(size), kind).reshape(shape[1:]).T.astype(float).tolist()


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "example_idx long, tensor array<array<double>>"

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options["path"], int(self.options.get("rows", ROWS)), int(self.options.get("packed_bytes", PACKED_BYTES)))


def read_tracks(spark: SparkSession, sequences: str, attributions: str, window: int | None = None) -> DataFrame:
    """example_idx, one_hot and hyp of two tensors of one shape, cropped to the middle ``window`` positions."""
    from trackmotif.functions import vec

    ship_package(spark)
    spark.dataSource.register(NpzSource)
    a = spark.read.format("npz").load(sequences).withColumnRenamed("tensor", "one_hot")
    b = spark.read.format("npz").load(attributions).withColumnRenamed("tensor", "hyp")
    joined = a.join(b, "example_idx")
    if window is None:
        return joined
    longest = joined.agg(F.min(F.size("one_hot"))).first()[0] or 0
    if window > longest:
        raise ValueError(f"the window ({window}) is longer than the tracks ({longest})")
    return joined.select("example_idx", *(vec.centred_crop(F.col(c), window).alias(c) for c in ("one_hot", "hyp")))
