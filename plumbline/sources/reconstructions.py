"""Sparse reconstructions in their binary exchange format: cameras, images and points with tracks.

Files are read through Spark, so that any store will do, and parsed record by record into Arrow batches; a
short file is an error. KML placemarks come through Spark's XML reader.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parameters of each camera model by its number (fixed values).
MODEL_PARAMETERS = {0: 3, 1: 4, 2: 4, 3: 5, 4: 8, 5: 8, 6: 12, 7: 5, 8: 4, 9: 5, 10: 12}
BATCH = 4096

_CAMERAS = "camera_id int, model_id int, width long, height long, params array<double>"
_IMAGES = "image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, points array<struct<x:double,y:double,point3d_id:long>>"
_POINTS = "point3d_id long, x double, y double, z double, r int, g int, b int, error double, track array<struct<image_id:int,point2d_idx:int>>"


def _cameras(data: bytes, at: int) -> tuple[dict, int]:
    camera, model, width, height = struct.unpack_from("<iiQQ", data, at)
    n = MODEL_PARAMETERS[model]
    params = list(struct.unpack_from(f"<{n}d", data, at + 24))
    return {"camera_id": camera, "model_id": model, "width": width, "height": height, "params": params}, at + 24 + 8 * n


def _images(data: bytes, at: int) -> tuple[dict, int]:
    image, *pose, camera = struct.unpack_from("<i7di", data, at)
    end = data.index(b"\0", at + 64)
    (n,) = struct.unpack_from("<Q", data, end + 1)
    start = end + 9
    if start + 24 * n > len(data):
        raise ValueError("the file ends inside an image's points")
    points = [dict(zip(("x", "y", "point3d_id"), p, strict=True)) for p in struct.iter_unpack("<ddq", data[start : start + 24 * n])]
    row = {"image_id": image, "qvec": pose[:4], "tvec": pose[4:], "camera_id": camera, "name": data[at + 64 : end].decode(), "points": points}
    return row, start + 24 * n


def _points(data: bytes, at: int) -> tuple[dict, int]:
    point, x, y, z, r, g, b, error, n = struct.unpack_from("<Q3d3BdQ", data, at)
    start = at + 51
    if start + 8 * n > len(data):
        raise ValueError("the file ends inside a track")
    track = [{"image_id": i, "point2d_idx": k} for i, k in struct.iter_unpack("<ii", data[start : start + 8 * n])]
    return {"point3d_id": point, "x": x, "y": y, "z": z, "r": r, "g": g, "b": b, "error": error, "track": track}, start + 8 * n


def _read(spark: SparkSession, path: str, schema: str, parse: Callable[[bytes, int], tuple[dict, int]]) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                (n,), at, held = struct.unpack_from("<Q", data, 0), 8, []
                for _ in range(n):
                    row, at = parse(data, at)
                    held.append(row)
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema)


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _CAMERAS, _cameras)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _IMAGES, _images)


def read_points3d(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _POINTS, _points)


def good_points(points: DataFrame, most_error: float, least_track: int) -> DataFrame:
    """Points with a small enough reprojection error that enough images see."""
    return points.where((F.col("error") <= most_error) & (F.size("track") >= least_track))


def tracks_in_crops(points: DataFrame, images: DataFrame, crops: DataFrame) -> DataFrame:
    """Observations inside their image's crop (image_id, x0, y0, x1, y1; half-open), nested by point again."""
    seen = points.select("point3d_id", F.inline("track"))
    placed = images.join(F.broadcast(crops), "image_id").select("image_id", "x0", "y0", "x1", "y1", F.posexplode("points").alias("point2d_idx", "p"))
    inside = (F.col("p.x") >= F.col("x0")) & (F.col("p.x") < F.col("x1")) & (F.col("p.y") >= F.col("y0")) & (F.col("p.y") < F.col("y1"))
    kept = seen.join(placed.where(inside), ["image_id", "point2d_idx"])
    return kept.groupBy("point3d_id").agg(F.array_sort(F.collect_list(F.struct("image_id", "point2d_idx"))).alias("track"))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks with a point: name, longitude, latitude, altitude (0 where there is none)."""
    schema = "name string, Point struct<coordinates:string>"
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path).where("Point.coordinates IS NOT NULL")
    part = F.split(F.trim("Point.coordinates"), ",")
    number = lambda i: F.get(part, F.lit(i)).try_cast("double")
    return rows.select("name", number(0).alias("longitude"), number(1).alias("latitude"), F.coalesce(number(2), F.lit(0.0)).alias("altitude"))
