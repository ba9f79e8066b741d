"""What image files say of themselves, lists of files, and strict manifests, through Spark's own readers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How an XMP packet and an EXIF block begin in a JPEG's APP1 segment (fixed values).
XMP_START = b"http://ns.adobe.com/xap/1.0/\x00"
EXIF_START = b"Exif\x00\x00"
#: EXIF tags by number (fixed values).
_IMAGE_TAGS = {0x010F: "make", 0x0110: "model", 0x0132: "changed_at", 0x8769: "exif", 0x8825: "gps"}
_EXIF_TAGS = {0x9003: "captured_at", 0xA002: "width", 0xA003: "height", 0x920A: "focal_length"}
_GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 5: "alt_ref", 6: "alt"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def jpeg_segments(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, payload) of a JPEG's segments up to its image data; what is cut off or no JPEG ends them."""
    at, n = 2, len(content)
    if content[:2] != b"\xff\xd8":
        return
    while at + 4 <= n:
        if content[at] != 0xFF:
            at += 1
            continue
        marker = content[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker in (0xD9, 0xDA):
            return
        elif marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
        else:
            size = int.from_bytes(content[at + 2 : at + 4], "big")
            if size < 2 or at + 2 + size > n:
                return
            yield marker, content[at + 4 : at + 2 + size]
            at += 2 + size


def exif_fields(block: bytes) -> dict:
    """Camera, times, size and position of a TIFF block; what is damaged is left out."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8:
        return {}
    out: dict = {}

    def read(offset: int, names: dict[int, str]) -> None:
        if not 0 < offset <= len(block) - 2:
            return
        (count,) = struct.unpack_from(order + "H", block, offset)
        for i in range(count):
            entry = offset + 2 + 12 * i
            if entry + 12 > len(block):
                return
            tag, kind, n = struct.unpack_from(order + "HHI", block, entry)
            if tag not in names or kind not in _SIZES or n > len(block):
                continue
            size = _SIZES[kind] * n
            place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", block, entry + 8)[0]
            raw = block[place : place + size]
            if len(raw) < size:
                continue
            if kind == 2:
                value: object = raw.split(b"\0")[0].decode("latin-1").strip()
            elif kind in (5, 10):
                pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * n, raw)
                value = [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
            else:
                value = list(struct.unpack(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind] * n, raw))
            out[names[tag]] = value

    read(struct.unpack_from(order + "I", block, 4)[0], _IMAGE_TAGS)
    for name, tags in (("exif", _EXIF_TAGS), ("gps", _GPS_TAGS)):
        if isinstance(out.get(name), list):
            read(out[name][0], tags)
    return out


def _degrees(parts: object, mark: object) -> float | None:
    if not isinstance(parts, list) or len(parts) != 3 or None in parts:
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -value if str(mark).upper()[:1] in ("S", "W") else value


_IMAGE = "path string, bytes long, make string, model string, captured_at string, width long, height long, lat double, lon double, alt double, xmp string"


def read_images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("jpg", "jpeg")) -> DataFrame:
    """A row for each image below a folder: EXIF camera, time, size and position, and the XMP packet as text.

    Only headers are looked at, in tasks; an image without EXIF or XMP, or that is no JPEG, has nulls. The time is
    as the camera wrote it (`exif_time` reads it). Folders are walked; names' case does not count.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, size, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found, packet = {}, None
                for marker, payload in jpeg_segments(content.as_py()):
                    if marker == 0xE1 and payload.startswith(EXIF_START) and not found:
                        found = exif_fields(payload[len(EXIF_START) :])
                    elif marker == 0xE1 and payload.startswith(XMP_START) and packet is None:
                        packet = payload[len(XMP_START) :].decode("utf-8", "replace")
                first = lambda k, found=found: found[k][0] if isinstance(found.get(k), list) and found[k] else None
                alt = first("alt")
                below = first("alt_ref") == 1
                rows.append(
                    (name, size, found.get("make"), found.get("model"), found.get("captured_at") or found.get("changed_at"), first("width"), first("height"),
                     _degrees(found.get("lat"), found.get("lat_ref")), _degrees(found.get("lon"), found.get("lon_ref")), -alt if below and alt is not None else alt, packet)
                )
            names = [x.split()[0] for x in _IMAGE.split(", ")]
            kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
            types = [kinds[x.split()[1]] for x in _IMAGE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return discover(spark, path, suffixes, content=True).select("path", "length", "content").mapInArrow(describe, _IMAGE)


def xmp_property(packet: Column, name: str) -> Column:
    """A property of an XMP packet, written as an attribute or as an element, whatever its prefix; null without one."""
    attribute = F.regexp_extract(packet, rf'(?s)\b[\w-]+:{name}\s*=\s*"([^"]*)"', 1)
    element = F.regexp_extract(packet, rf"(?s)<[\w-]+:{name}(?:\s[^>]*)?>([^<]*)</", 1)
    return F.coalesce(F.nullif(F.trim(attribute), F.lit("")), F.nullif(F.trim(element), F.lit("")))


def discover(spark: SparkSession, path: str, suffixes: tuple[str, ...], prefixes: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """Files below a folder with one of the suffixes: path, name, length, modified, and whether the name occurs twice.

    `prefixes` keeps only files in those folders below the root. Spark lists the folders; contents are read only
    where they are asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    low = F.lower("path")
    wanted = files.where(F.exists(F.array(*[F.lit(f".{s.lower()}") for s in suffixes]), lambda s: low.endswith(s)))
    if prefixes:
        root = path.rstrip("/")
        wanted = wanted.where(F.exists(F.array(*[F.lit(f"{root}/{p.strip('/')}/") for p in prefixes]), lambda p: F.contains("path", p)))
    name = F.element_at(F.split("path", "/"), -1)
    shown = wanted.select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    twice = shown.groupBy(F.lower("name").alias("__n")).agg((F.count(F.lit(1)) > 1).alias("name_twice"))
    return shown.join(twice, F.lower("name") == F.col("__n")).drop("__n")


def strict_manifests(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """JSON manifests, one a file, that must have exactly these fields (name to Spark type): their values and `problem`.

    `problem` tells a text that is no object, missing and unknown fields, fields given twice and values of
    another type; it is null for a good manifest.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.trim("value").alias("value"))
    keys = F.json_object_keys("value")
    schema = ", ".join(f"`{n}` {t}" for n, t in fields.items())
    parsed = text.select("source_file", "value", keys.alias("keys"), F.from_json("value", schema).alias("m"))
    names = F.array(*[F.lit(n) for n in fields])
    missing, unknown = F.array_except(names, "keys"), F.array_except("keys", names)
    # The keys of the object itself, in the order and as often as they are given.
    twice = F.size("keys") > F.size(F.array_distinct("keys"))
    wrong = F.exists(F.array(*[F.struct(F.get_json_object("value", f"$.{n}").isNotNull().alias("there"), F.col(f"m.{n}").isNull().alias("null")) for n in fields]), lambda x: x["there"] & x["null"])
    problem = (
        F.when(F.col("keys").isNull(), "no object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(F.array_sort(missing), ", ")))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(unknown), ", ")))
        .when(twice, "a field given twice")
        .when(wrong, "a value of another type")
    )
    return parsed.select("source_file", *[F.col(f"m.{n}").alias(n) for n in fields], problem.alias("problem"))


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """Markers of photogrammetry XML files: file, id, label and reference point. Markers without a point are left out."""
    schema = "_id string, _label string, reference struct<_x:double,_y:double,_z:double>"
    rows = spark.read.format("xml").option("rowTag", "marker").schema(schema).load(path).withColumn("source_file", F.col("_metadata.file_path"))
    rows = rows.where("_id IS NOT NULL AND reference._x IS NOT NULL AND reference._y IS NOT NULL")
    return rows.select("source_file", F.col("_id").alias("id"), F.coalesce("_label", "_id").alias("external_id"), F.col("reference._x").alias("x"), F.col("reference._y").alias("y"), F.coalesce("reference._z", F.lit(0.0)).alias("z"))


def file_manifest(files: DataFrame) -> DataFrame:
    """Path, length and SHA-256 of files (path, length, content), in order of their paths."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path")


def canonical_json(columns: dict[str, Column]) -> Column:
    """A JSON object with its keys in order, no blanks, and nulls written out."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def flight_paths(df: DataFrame, mission: str, order: str, lon: str, lat: str) -> DataFrame:
    """A GeoJSON LineString for each mission through its positions in order; a mission of one position has a Point.

    A mission's positions make one line, so they meet in one row, as they must in the result.
    """
    points = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.array(F.col(lon), F.col(lat)).alias("p"))))
    rows = df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).groupBy(mission).agg(F.transform(points, lambda x: x["p"]).alias("line"))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.col("line").alias("coordinates")))
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.element_at("line", 1).alias("coordinates")))
    return rows.select(mission, F.when(F.size("line") > 1, line).otherwise(point).alias("geometry"), F.size("line").alias("n"))


def write_pairs(pairs: DataFrame, a: str, b: str, path: str) -> None:
    """`a b` lines, each unordered pair once, sorted over all part files."""
    low, high = F.least(a, b), F.greatest(a, b)
    distinct = pairs.where(F.col(a) != F.col(b)).select(low.alias("a"), high.alias("b")).distinct()
    distinct.orderBy("a", "b").select(F.concat_ws(" ", "a", "b").alias("value")).write.text(path)
