"""Point tables in binary PLY files as a Spark data source: `spark.read.format("ply").load(path)`.

A file must be little-endian, hold vertices only, begin with x, y, z, and have float or double properties.
It is read in byte ranges of whole records by as many tasks; `source_id` is a record's place in the file.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, FloatType, LongType, StringType, StructField, StructType

_KINDS = {"float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
#: Bytes of records that one task reads.
RANGE_BYTES = 64 * 1024 * 1024
#: Records of one Arrow batch.
BATCH = 65_536


@dataclass(frozen=True)
class Layout:
    count: int
    start: int
    fields: tuple[tuple[str, str], ...]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(list(self.fields))


def read_layout(path: str) -> Layout:
    """A file's header, checked against its size."""
    count, fields, lines = None, [], []
    with open(path, "rb") as file:
        while True:
            line = file.readline(4096)
            if not line.endswith(b"\n"):
                raise ValueError(f"{path}: the header does not end")
            words = line.decode("ascii").split()
            lines.append(words)
            if words == ["end_header"]:
                break
            if words[:1] == ["element"]:
                if count is not None or words[1] != "vertex":
                    raise ValueError(f"{path}: vertices alone are read")
                count = int(words[2])
            elif words[:1] == ["property"]:
                if len(words) != 3 or words[1] not in _KINDS:
                    raise ValueError(f"{path}: property {words[1:]} is neither float nor double")
                fields.append((words[2], _KINDS[words[1]]))
        start = file.tell()
    if lines[0] != ["ply"] or ["format", "binary_little_endian", "1.0"] not in lines:
        raise ValueError(f"{path}: no binary little-endian PLY file")
    if count is None or [n for n, _ in fields[:3]] != ["x", "y", "z"] or len({n for n, _ in fields}) != len(fields):
        raise ValueError(f"{path}: properties must be distinct and begin with x, y, z")
    layout = Layout(count, start, tuple(fields))
    if os.path.getsize(path) != start + count * layout.dtype.itemsize:
        raise ValueError(f"{path}: the size does not fit {count} records")
    return layout


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    count: int

    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class PlyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def _files(self) -> list[str]:
        path = self.options["path"].removeprefix("file://")
        files = sorted(glob.glob(os.path.join(path, "*.ply")) if os.path.isdir(path) else glob.glob(path))
        if not files:
            raise FileNotFoundError(path)
        return files

    def schema(self) -> StructType:
        fields = read_layout(self._files()[0]).fields
        kinds = {"<f4": FloatType(), "<f8": DoubleType()}
        return StructType([StructField(n, kinds[k]) for n, k in fields] + [StructField("source_file", StringType()), StructField("source_id", LongType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PlyReader(self._files(), int(self.options.get("rangeBytes", RANGE_BYTES)))


class _PlyReader(DataSourceReader):
    def __init__(self, files: list[str], range_bytes: int):
        self.files, self.range_bytes = files, range_bytes

    def partitions(self) -> list[_Range]:
        layouts = [read_layout(f) for f in self.files]
        if len({x.fields for x in layouts}) > 1:
            raise ValueError("the files differ in their properties")
        step = max(1, self.range_bytes // layouts[0].dtype.itemsize)
        return [_Range(f, i, min(step, x.count - i)) for f, x in zip(self.files, layouts, strict=True) for i in range(0, x.count, step)] or [_Range(self.files[0], 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        layout = read_layout(partition.path)
        kind = layout.dtype
        with open(partition.path, "rb") as file:
            file.seek(layout.start + partition.first * kind.itemsize)
            for at in range(0, partition.count, BATCH):
                n = min(BATCH, partition.count - at)
                rows = np.frombuffer(file.read(n * kind.itemsize), kind)
                columns = [pa.array(np.ascontiguousarray(rows[name])) for name, _ in layout.fields]
                ids = np.arange(partition.first + at, partition.first + at + n)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([os.path.basename(partition.path)] * n), pa.array(ids)], names=[*[n for n, _ in layout.fields], "source_file", "source_id"]
                )


def read_points(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(PlyDataSource)
    return spark.read.format("ply").options(**options).load(path)


def vertex_count(path: str) -> int:
    """Records of a file, from its header alone."""
    return read_layout(path).count


def ply_header(columns: list[tuple[str, str]], count: int) -> bytes:
    """The header of a file of `count` records of (name, float or double) columns."""
    properties = "".join(f"property {kind} {name}\n" for name, kind in columns)
    return f"ply\nformat binary_little_endian 1.0\nelement vertex {count}\n{properties}end_header\n".encode()


def pack_records(rows: list[tuple], kinds: str) -> bytes:
    """Records in a struct format, one after the other."""
    return b"".join(struct.pack("<" + kinds, *r) for r in rows)
