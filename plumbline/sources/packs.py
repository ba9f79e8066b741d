"""Fixed-width records in packs, and points in one PLY file: Spark data sources that also write.

`df.write.format("packs")` lays each pack out as a header of 32 bytes and its records. Tasks write files of their own;
only the manifest names them, and it is written when all tasks have succeeded, so that a failed job leaves nothing to
be read. Paths are any that pyarrow's file systems know.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from plumbline.functions.geometry import dequantise, quantise, symmetric_quantise, symmetric_scale
from plumbline.operators.lineage import cut

from .point_tables import ply_header

#: magic, version, bytes of the header, bytes of a record, reserved, records, a number of the pack's name, CRC-32 of the records
_HEADER = struct.Struct("<4sHHHHIQI4x")
MAGIC = b"PLPK"
VERSION = 1
MANIFEST = "manifest.json"
MOST_BYTES = 128 << 20
#: Kinds of fields, and the Spark types they are read as.
KINDS = {"u1": "int", "i1": "int", "u2": "int", "i2": "int", "u4": "long", "i4": "int", "i8": "long", "f4": "float", "f8": "double"}
BATCH = 65_536


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


def _dtype(fields: list[tuple[str, str]]) -> np.dtype:
    return np.dtype([(name, "<" + kind) for name, kind in fields])


def _identity(pack: str) -> int:
    return zlib.crc32(pack.encode()) << 32 | zlib.adler32(pack.encode())


def encoded_pack(pack: str, records: np.ndarray) -> bytes:
    """A pack's bytes; an error if it has no record or is over the limit."""
    payload = records.tobytes()
    if not payload or _HEADER.size + len(payload) > MOST_BYTES:
        raise ValueError(f"pack {pack}: {len(records)} records are none or too many")
    return _HEADER.pack(MAGIC, VERSION, _HEADER.size, records.dtype.itemsize, 0, len(records), _identity(pack), zlib.crc32(payload)) + payload


def decoded_pack(pack: str, data: bytes, kind: np.dtype) -> np.ndarray:
    """A pack's records, checked against its header."""
    if len(data) < _HEADER.size:
        raise ValueError(f"pack {pack}: the header is cut off")
    magic, version, header, record, _, count, identity, crc = _HEADER.unpack_from(data)
    if (magic, version, header, record, identity) != (MAGIC, VERSION, _HEADER.size, kind.itemsize, _identity(pack)):
        raise ValueError(f"pack {pack}: the header is another one's")
    if len(data) != header + count * record or zlib.crc32(data[header:]) != crc:
        raise ValueError(f"pack {pack}: length or checksum do not fit")
    return np.frombuffer(data, kind, count, header)


@dataclass
class _Written(WriterCommitMessage):
    packs: list


class _PackWriter(DataSourceArrowWriter):
    def __init__(self, path: str, pack: str, fields: list, constants: list, overwrite: bool):
        self.path, self.pack, self.fields, self.constants, self.overwrite = path, pack, fields, constants, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        """Write each pack of this task; its rows must come together."""
        store, root = _place(self.path)
        store.create_dir(root, recursive=True)
        kind, held, size, done, now, first = _dtype(self.fields), [], 0, [], None, None
        own = uuid.uuid4().hex[:12]

        def flush() -> None:
            data = encoded_pack(str(now), np.concatenate(held))
            name = f"{len(done)}-{own}.bin"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            done.append({"id": str(now), "path": name, "records": (len(data) - _HEADER.size) // kind.itemsize, "bytes": len(data), "crc32": zlib.crc32(data[_HEADER.size :]), "constants": first})

        for batch in batches:
            packs = np.array(batch.column(self.pack).to_pylist(), object)
            rows = np.empty(len(packs), kind)
            for name, _ in self.fields:
                column = batch.column(name)
                if column.null_count:
                    raise ValueError(f"{name} is null in a record")
                rows[name] = column.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(packs[1:] != packs[:-1]) + 1).tolist(), len(packs)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if packs[lo] != now or not held:
                    if held:
                        flush()
                    now, held, size = packs[lo], [], 0
                    first = {c: batch.column(c)[lo].as_py() for c in self.constants}
                held.append(rows[lo:hi].copy())
                size += (hi - lo) * kind.itemsize
                if size > MOST_BYTES:
                    raise ValueError(f"pack {now}: over {MOST_BYTES} bytes")
        if held:
            flush()
        return _Written(done)

    def commit(self, messages: list) -> None:
        """Name all packs in the manifest, which appears at once."""
        store, root = _place(self.path)
        packs = sorted((p for m in messages if m is not None for p in m.packs), key=lambda p: p["id"])
        if len({p["id"] for p in packs}) != len(packs):
            self.abort(messages)
            raise ValueError("rows of one pack came to several tasks; deal them by pack before writing")
        store.create_dir(root, recursive=True)
        before = _manifest(self.path, missing=True)
        if before and not self.overwrite:
            known = {p["id"] for p in packs}
            if before["fields"] != [list(f) for f in self.fields] or known & {p["id"] for p in before["packs"]}:
                self.abort(messages)
                raise ValueError("packs of that name or of other fields are there")
            packs = sorted(before["packs"] + packs, key=lambda p: p["id"])
        text = json.dumps({"version": VERSION, "pack": self.pack, "fields": self.fields, "packs": packs}, sort_keys=True, separators=(",", ":")) + "\n"
        draft = f"{root}/.{MANIFEST}-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(text.encode())
        store.move(draft, f"{root}/{MANIFEST}")
        for p in before["packs"] if before and self.overwrite else []:
            store.delete_file(f"{root}/{p['path']}")

    def abort(self, messages: list) -> None:
        """Remove what tasks have told of; what a killed task has left is named nowhere."""
        store, root = _place(self.path)
        for message in messages:
            for p in message.packs if message is not None else []:
                if store.get_file_info(f"{root}/{p['path']}").is_file:
                    store.delete_file(f"{root}/{p['path']}")


def _manifest(path: str, missing: bool = False) -> dict | None:
    store, root = _place(path)
    if missing and not store.get_file_info(f"{root}/{MANIFEST}").is_file:
        return None
    with store.open_input_stream(f"{root}/{MANIFEST}") as file:
        return json.loads(file.read())


@dataclass
class _Pack(InputPartition):
    def __init__(self, entry: dict):
        self.entry = entry


class _PackReader(DataSourceReader):
    def __init__(self, path: str, manifest: dict, names: list):
        self.path, self.manifest, self.names = path, manifest, names

    def partitions(self) -> list[_Pack]:
        return [_Pack(p) for p in self.manifest["packs"]] or [_Pack({})]

    def read(self, partition: _Pack) -> Iterator[pa.RecordBatch]:
        entry = partition.entry
        if not entry:
            return
        store, root = _place(self.path)
        with store.open_input_stream(f"{root}/{entry['path']}") as file:
            records = decoded_pack(entry["id"], file.read(), _dtype(self.manifest["fields"]))
        types = {"int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}
        for at in range(0, len(records), BATCH):
            part = records[at : at + BATCH]
            columns = [pa.array([entry["id"]] * len(part)), pa.array(np.arange(at, at + len(part)))]
            columns += [pa.array(np.ascontiguousarray(part[n])).cast(types[KINDS[k]]) for n, k in self.manifest["fields"]]
            columns += [pa.array([entry["constants"][c]] * len(part), pa.float64()) for c in sorted(entry["constants"])]
            yield pa.RecordBatch.from_arrays(columns, names=self.names)


class PackDataSource(DataSource):
    """`fields` (JSON pairs of name and kind) and `pack` (the column that names a pack, a string) are needed to write; columns
    of `constants` (a JSON list) have one number in all rows of a pack and go into the manifest."""

    @classmethod
    def name(cls) -> str:
        return "packs"

    def schema(self) -> str:
        m = _manifest(self.options["path"])
        constants = sorted({c for p in m["packs"] for c in p["constants"]})
        return ", ".join(["pack string", "place long", *[f"`{n}` {KINDS[k]}" for n, k in m["fields"]], *[f"`{c}` double" for c in constants]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PackReader(self.options["path"], _manifest(self.options["path"]), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        fields = [tuple(f) for f in json.loads(self.options["fields"])]
        if not fields or any(k not in KINDS for _, k in fields):
            raise ValueError(f"kinds of fields are {', '.join(KINDS)}")
        return _PackWriter(self.options["path"], self.options["pack"], fields, json.loads(self.options.get("constants", "[]")), overwrite)


def quantised_packs(df: DataFrame, pack: str, affine: list[str], symmetric: dict[str, int], levels: int = 65_535) -> DataFrame:
    """Columns as integers by pack: `affine` ones over their range (added as <c>_low, <c>_high), `symmetric` ones (to so many
    bits) by their greatest absolute value (added as <c>_scale). No value may be null."""
    ends = [F.min(c).alias(f"{c}_low") for c in affine] + [F.max(c).alias(f"{c}_high") for c in affine]
    ends += [symmetric_scale(F.max(F.abs(F.col(c).cast("double"))), bits).alias(f"{c}_scale") for c, bits in symmetric.items()]
    known = df.groupBy(pack).agg(*ends)
    out = df.join(known, pack)
    made = {c: quantise(F.col(c).cast("double"), F.col(f"{c}_low").cast("double"), F.col(f"{c}_high").cast("double"), levels) for c in affine}
    return out.withColumns(made | {c: symmetric_quantise(F.col(c).cast("double"), F.col(f"{c}_scale"), bits) for c, bits in symmetric.items()})


def restored(df: DataFrame, affine: list[str], symmetric: list[str], levels: int = 65_535) -> DataFrame:
    """The values that the integers of `quantised_packs` stand for."""
    made = {c: dequantise(F.col(c), F.col(f"{c}_low"), F.col(f"{c}_high"), levels) for c in affine} | {c: F.col(c) * F.col(f"{c}_scale") for c in symmetric}
    return df.withColumns(made).drop(*[f"{c}_{s}" for c in affine for s in ("low", "high")], *[f"{c}_scale" for c in symmetric])


def write_packs(df: DataFrame, path: str, pack: str, order: list[str], fields: list[tuple[str, str]], constants: list[str] = (), mode: str = "append") -> None:
    """Write rows as packs, each by one task, records in order. Packs are bounded, so no task holds more than one of them."""
    df.sparkSession.dataSource.register(PackDataSource)
    rows = df.select(F.col(pack).cast("string").alias(pack), *[n for n, _ in fields if n != pack], *[F.col(c).cast("double").alias(c) for c in constants], *[o for o in order if o not in {n for n, _ in fields}])
    dealt = rows.repartition(pack).sortWithinPartitions(pack, *order)
    dealt.write.format("packs").mode(mode).option("fields", json.dumps(fields)).option("pack", pack).option("constants", json.dumps(list(constants))).save(path)


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """pack, place, the fields and the packs' constants; an error if a pack is not what its header and manifest say."""
    spark.dataSource.register(PackDataSource)
    return spark.read.format("packs").load(path)


class _PlyWriter(DataSourceArrowWriter):
    def __init__(self, draft: str, path: str, starts: dict, columns: list):
        self.draft, self.path, self.starts, self.columns = draft, path, starts, columns

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        kind = np.dtype([(n, "<f4" if k == "float" else "<f8") for n, k in self.columns])
        at, end = self.starts.get(str(TaskContext.get().partitionId()), (0, 0))  # a task without rows was not counted
        with open(self.draft, "r+b") as file:
            file.seek(at)
            for batch in batches:
                rows = np.empty(batch.num_rows, kind)
                for n, _ in self.columns:
                    rows[n] = batch.column(n).to_numpy(zero_copy_only=False)
                file.write(rows.tobytes())
            if file.tell() != end:
                raise ValueError("a task has other rows than were counted")
        return _Written([])

    def commit(self, messages: list) -> None:
        os.replace(self.draft, self.path)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.draft):
            os.remove(self.draft)


class PlyFileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply_file"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        o = self.options
        return _PlyWriter(o["draft"], o["path"], json.loads(o["starts"]), json.loads(o["columns"]))


def write_ply(df: DataFrame, path: str) -> None:
    """One PLY file of all rows, in a folder that all tasks can write at any place of a file, as on a shared disk.

    Float and double columns only, x, y and z first. Rows are kept, counted by task, and each task writes its own range:
    its place is the sum of the counts before it. The file appears when all have succeeded.
    """
    kinds = dict(df.dtypes)
    columns = [(c, kinds[c]) for c in df.columns]
    if [c for c, _ in columns[:3]] != ["x", "y", "z"] or any(k not in ("float", "double") for _, k in columns):
        raise ValueError("columns are float or double and begin with x, y, z")
    df.sparkSession.dataSource.register(PlyFileSink)
    kept = cut(df)
    counts = {r["p"]: r["n"] for r in kept.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    header = ply_header(columns, sum(counts.values()))
    width = sum(4 if k == "float" else 8 for _, k in columns)
    starts, at = {}, len(header)
    for p in sorted(counts):
        starts[str(p)] = (at, at + width * counts[p])
        at = starts[str(p)][1]
    target = path.removeprefix("file://")
    draft = f"{target}.{uuid.uuid4().hex}.draft"
    with open(draft, "wb") as file:
        file.write(header)
        file.truncate(at)
    kept.write.format("ply_file").mode("append").option("draft", draft).option("starts", json.dumps(starts)).option("columns", json.dumps(columns)).save(target)
