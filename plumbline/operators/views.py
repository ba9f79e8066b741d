"""Which cameras see which points: an index of what each can see of the ground, then the exact projection.

A camera table has image, width, height, model, params and pose, the 3 x 4 matrix (12 numbers by rows) from world to camera.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from plumbline.functions.features import clip_ring, distorted, stable_ceil, stable_floor
from plumbline.functions.geometry import ring_area

from .lineage import cut

#: Parameters of each lens model in all, and how many of them come before the distortion terms (fixed values).
MODELS = {"SIMPLE_PINHOLE": (3, 3), "PINHOLE": (4, 4), "SIMPLE_RADIAL": (4, 3), "RADIAL": (5, 3), "OPENCV": (8, 4), "FULL_OPENCV": (12, 4), "OPENCV_FISHEYE": (8, 4)}
SCHEMA_VERSION = 1
#: Cells that the ground seen by a camera is laid out on along either side, at most, before cells are doubled.
SIDE_CELLS = 32
#: With a limit: cells along either side of the extent, and the points and cameras of a cell at most that one task has.
GRID = 8
TASK_POINTS = 200_000
TASK_CAMERAS = 50_000
#: Points of a box and pairs at which no box is halved any more.
LEAF_POINTS = 8
LEAF_PAIRS = 8_192
_RAYS = 64


def read_camera_index(spark: SparkSession, path: str) -> DataFrame:
    """Cameras of JSON indexes (schema_version, crs, images): source_file, crs, camera columns, and `problem`.

    `problem` is null for a good camera, else tells the first of: version, crs, name, repeated name, size, parameters,
    pose. Cameras of an unknown model are left out. Each file is one JSON object.
    """
    image = "struct<image_name:string,width:long,height:long,model:string,params:array<double>,cam_from_world:array<array<double>>>"
    raw = spark.read.schema(f"schema_version int, crs string, images array<{image}>").option("multiLine", True).json(path).withColumn("source_file", F.col("_metadata.file_path"))
    rows = raw.select("source_file", "schema_version", "crs", F.inline("images")).where(F.trim("model").isin(*MODELS))
    rows = rows.withColumns({"image": F.trim("image_name"), "model": F.trim("model")})
    repeated = F.count(F.lit(1)).over(Window.partitionBy("source_file", "image")) > 1
    wanted = F.create_map(*[F.lit(x) for m, (n, _) in MODELS.items() for x in (m, n)])[F.col("model")]
    finite = lambda values: F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    pose = F.flatten("cam_from_world")
    three = (F.size("cam_from_world") == 3) & F.forall("cam_from_world", lambda r: F.size(r) == 4)
    problem = (
        F.when(F.coalesce(F.col("schema_version") != SCHEMA_VERSION, F.lit(True)), "version").when(F.coalesce(F.trim("crs") == "", F.lit(True)), "crs")
        .when(F.coalesce(F.col("image") == "", F.lit(True)), "name").when(repeated, "repeated name")
        .when(F.coalesce((F.col("width") < 1) | (F.col("height") < 1), F.lit(True)), "size")
        .when(~F.coalesce((F.size("params") == wanted) & finite("params"), F.lit(False)), "parameters").when(~F.coalesce(three & finite(pose), F.lit(False)), "pose")
    )
    return rows.select("source_file", "crs", "image", "width", "height", "model", "params", pose.alias("pose"), problem.alias("problem"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often the expression names it."""
    return F.transform(F.array(value), then)[0]


def projected(model: Column, params: Column, pose: Column, x: Column, y: Column, z: Column) -> Column:
    """Pixel (x, y) of a point of the world; null behind the camera or for an unknown model."""
    at = lambda r: pose[4 * r] * x + pose[4 * r + 1] * y + pose[4 * r + 2] * z + pose[4 * r + 3]
    one_focal = model.isin(*[m for m, (_, n) in MODELS.items() if n == 3])
    terms = F.slice(params, F.when(one_focal, 4).otherwise(5), F.size(params))
    fy, cx, cy = (F.when(one_focal, params[i]).otherwise(params[k]) for i, k in ((0, 1), (1, 2), (2, 3)))
    ahead = F.struct(at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    level = lambda c: F.when(c["z"] > 0, F.struct((c["x"] / c["z"]).alias("x"), (c["y"] / c["z"]).alias("y")))
    bent = _let(_let(ahead, level), lambda n: distorted(model, terms, n["x"], n["y"]))
    return _let(bent, lambda b: F.when(b["x"].isNotNull(), F.struct((params[0] * b["x"] + cx).alias("x"), (fy * b["y"] + cy).alias("y"))))


def _bend(model: str, params: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lens once more, for arrays: only to find how far from its axis a camera can see at all."""
    head = MODELS[model][1]
    k = np.zeros(8)
    k[: len(params) - head] = params[head:]
    r2 = x * x + y * y
    if model == "OPENCV_FISHEYE":
        r = np.sqrt(r2)
        theta = np.arctan(r)
        scale = np.where(r > 1e-12, theta * (1 + k[0] * theta**2 + k[1] * theta**4 + k[2] * theta**6 + k[3] * theta**8) / np.maximum(r, 1e-12), 1.0)
    else:
        scale = 1 + k[0] * r2 + k[1] * r2 * r2 * (head == 4 or model == "RADIAL")
        if model == "FULL_OPENCV":
            scale = (scale + k[4] * r2**3) / (1 + k[5] * r2 + k[6] * r2**2 + k[7] * r2**3)
    tilt = model in ("OPENCV", "FULL_OPENCV")
    p1, p2 = (k[2], k[3]) if tilt else (0.0, 0.0)
    u = x * scale + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)
    v = y * scale + 2 * p2 * x * y + p1 * (r2 + 2 * y * y)
    fx, fy = (params[0], params[0]) if head == 3 else params[:2]
    return fx * u + params[head - 2], fy * v + params[head - 1]


@lru_cache(10_000)
def _reach(model: str, params: tuple[float, ...], width: int, height: int) -> float:
    """The largest angle from the axis, in radians, at which a direction may fall into the frame; found on a fine polar grid.

    One step of the grid is added on the outside. Lenses bend rays far out back into the frame; such rays count as well.
    """
    angles = np.linspace(0, np.pi / 2, 1801)[1:-1]
    turns = np.linspace(0, 2 * np.pi, 181)
    r = np.tan(angles)[:, None]
    with np.errstate(all="ignore"):
        u, v = _bend(model, np.asarray(params, float), r * np.cos(turns), r * np.sin(turns))
        # A frame grown by what the pixels move within one step of the grid.
        step_u = np.abs(np.diff(u, axis=0, prepend=u[:1])) + np.abs(np.diff(u, axis=1, prepend=u[:, :1])) + 1
        step_v = np.abs(np.diff(v, axis=0, prepend=v[:1])) + np.abs(np.diff(v, axis=1, prepend=v[:, :1])) + 1
        inside = (u >= -step_u) & (u < width + step_u) & (v >= -step_v) & (v < height + step_v)
    rows = np.flatnonzero(inside.any(axis=1))
    if not len(rows):
        return angles[0]
    return float(angles[min(rows[-1] + 1, len(angles) - 1)]) if rows[-1] + 2 < len(angles) else np.pi / 2


def _ground(model: str, params: np.ndarray, width: int, height: int, pose: np.ndarray, low: float, high: float) -> tuple[float, float, float, float] | None:
    """A box of the ground (west, south, east, north) that holds all the camera sees between two heights; None if it is unbounded."""
    m = np.asarray(pose, float).reshape(3, 4)
    centre = -np.linalg.pinv(m[:, :3]) @ m[:, 3]
    reach = _reach(model, tuple(params), width, height)
    if reach >= np.pi / 2 - 1e-6:
        return None
    # A pyramid around the cone of view.
    turn = np.arange(_RAYS) * 2 * np.pi / _RAYS
    r = np.tan(reach) / np.cos(np.pi / _RAYS)
    rays = np.linalg.pinv(m[:, :3]) @ np.stack([r * np.cos(turn), r * np.sin(turn), np.ones(_RAYS)])
    corners = []
    for level in (low, high):
        away = level - centre[2]
        with np.errstate(all="ignore"):
            t = away / rays[2]
        if not (np.isfinite(t) & (t > 0)).all():
            # The pyramid meets this level without bound, or not at all.
            if away == 0 or (rays[2] * away > 0).any():
                return None
            continue
        corners.append(centre[:2, None] + rays[:2] * t)
    if low <= centre[2] <= high:
        corners.append(centre[:2, None])
    if not corners:
        return (0.0, 0.0, -1.0, -1.0)
    every = np.concatenate(corners, axis=1)
    return (*every.min(axis=1), *every.max(axis=1))


def seen_ground(cameras: DataFrame, low: float, high: float) -> DataFrame:
    """Add `ground`, a box (west, south, east, north) around all that each camera sees between two heights, null if unbounded."""

    @F.pandas_udf("struct<west:double,south:double,east:double,north:double>")
    def boxes(model: pd.Series, params: pd.Series, width: pd.Series, height: pd.Series, pose: pd.Series) -> pd.DataFrame:
        found = [_ground(*c, low, high) for c in zip(model, params, width, height, pose, strict=True)]
        return pd.DataFrame([f or (None,) * 4 for f in found], columns=["west", "south", "east", "north"], dtype=float)

    made = cameras.withColumn("ground", boxes("model", "params", "width", "height", "pose"))
    return made.withColumn("ground", F.when(F.col("ground.west").isNotNull() & ~F.isnan("ground.west"), F.col("ground")))


#: Columns of a camera's row of numbers: pose, focal lengths, centre, radial and tangential terms or those of a fisheye lens, frame.
_NUMBERS = [*[f"p{i}" for i in range(12)], "fx", "fy", "cx", "cy", *[f"k{i}" for i in range(8)], *[f"f{i}" for i in range(4)], "fish", "w", "h"]


def _numbers(cameras: DataFrame) -> DataFrame:
    """Cameras (camera, model, params, pose, width, height) as plain numbers, terms that a model lacks as 0."""
    model, params, fish = F.col("model"), F.col("params"), F.col("model") == "OPENCV_FISHEYE"
    of = lambda i: F.create_map(*[F.lit(x) for m, v in MODELS.items() for x in (m, v[i])])[model]
    head, terms = of(1), of(0) - of(1)
    at = lambda i: F.get(params, i)
    k = lambda i: F.when(i < terms, F.coalesce(at(head + i), F.lit(0.0))).otherwise(0.0)
    values = [F.get("pose", F.lit(i)) for i in range(12)] + [at(F.lit(0)), at(head - 3), at(head - 2), at(head - 1)]
    values += [F.when(fish, 0.0).otherwise(k(F.lit(i))) for i in range(8)] + [F.when(fish, k(F.lit(i))).otherwise(0.0) for i in range(4)]
    values += [fish, F.col("width"), F.col("height")]
    return cameras.select(*[c for c in cameras.columns if c not in ("model", "params", "pose", "width", "height", "image")], *[v.cast("double").alias(n) for v, n in zip(values, _NUMBERS, strict=True)])


def _pixels(c: np.ndarray, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth and pixel of each point (column) in each camera (row of `_NUMBERS`)."""
    ahead = [c[:, 4 * r : 4 * r + 3] @ xyz.T + c[:, 4 * r + 3, None] for r in range(3)]
    k = c[:, 16:24, None].swapaxes(0, 1)
    with np.errstate(all="ignore"):
        x, y = ahead[0] / ahead[2], ahead[1] / ahead[2]
        t = x * x + y * y
        s = (1 + t * (k[0] + t * (k[1] + t * k[4]))) / (1 + t * (k[5] + t * (k[6] + t * k[7])))
        fish = c[:, 28] > 0
        if fish.any():
            r, f = np.sqrt(t[fish]), c[fish, 24:28, None].swapaxes(0, 1)
            turn = np.arctan(r)
            t2 = turn * turn
            s[fish] = np.where(r > 1e-12, turn / np.maximum(r, 1e-12) * (1 + t2 * (f[0] + t2 * (f[1] + t2 * (f[2] + t2 * f[3])))), 1.0)
        u = x * s + 2 * k[2] * x * y + k[3] * (t + 2 * x * x)
        v = y * s + 2 * k[3] * x * y + k[2] * (t + 2 * y * y)
        return ahead[2], c[:, 12, None] * u + c[:, 14, None], c[:, 13, None] * v + c[:, 15, None]


def _times(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest product of numbers from two intervals."""
    every = [a[i] * b[j] for i in (0, 1) for j in (0, 1)]
    return np.minimum(np.minimum(every[0], every[1]), np.minimum(every[2], every[3])), np.maximum(np.maximum(every[0], every[1]), np.maximum(every[2], every[3]))


def _square(a: tuple) -> tuple[np.ndarray, np.ndarray]:
    low, high = a[0] * a[0], a[1] * a[1]
    return np.where((a[0] < 0) & (a[1] > 0), 0.0, np.minimum(low, high)), np.maximum(low, high)


def _polynomial(t: tuple, k1: np.ndarray, k2: np.ndarray, k3: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of 1 + k1 t + k2 t^2 + k3 t^3 for t >= 0: those of the first three terms are exact."""
    ends = [1 + v * (k1 + v * k2) for v in t]
    turn = -k1 / np.where(k2 == 0, 1.0, 2 * k2)
    top = np.where((k2 != 0) & (turn > t[0]) & (turn < t[1]), 1 + turn * (k1 + turn * k2), ends[0])
    cubes = [k3 * v**3 for v in t]
    return np.minimum(np.minimum(*ends), top) + np.minimum(*cubes), np.maximum(np.maximum(*ends), top) + np.maximum(*cubes)


def _bounds(c: np.ndarray, low: np.ndarray, high: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each camera and the points of a box: the least score there may be, the greatest if all are seen (else infinite), and whether any may be seen."""
    middle, half = (low + high) / 2, (high - low) / 2
    span = []
    for r in range(3):
        turn, at = c[:, 4 * r : 4 * r + 3], c[:, 4 * r + 3]
        centre = turn @ middle + at
        wide = np.abs(turn) @ half * (1 + 1e-9) + 1e-12 * (np.abs(turn) @ np.abs(middle) + np.abs(at))
        span.append((centre - wide, centre + wide))
    z = span[2]
    near = z[0] <= 0
    far = (np.where(near, 1.0, z[0]), np.where(near, 1.0, z[1]))
    with np.errstate(all="ignore"):
        x, y = ((np.minimum(v[0] / far[0], v[0] / far[1]), np.maximum(v[1] / far[0], v[1] / far[1])) for v in span[:2])
        x2, y2 = _square(x), _square(y)
        t = (x2[0] + y2[0], x2[1] + y2[1])
        k = c[:, 16:24].T
        s = _polynomial(t, k[0], k[1], k[4])
        if k[5:].any():
            under = _polynomial(t, k[5], k[6], k[7])
            zero = (under[0] <= 0) & (under[1] >= 0)
            s = _times(s, (1 / np.where(zero, 1.0, under[1]), 1 / np.where(zero, 1.0, under[0])))
            s = (np.where(zero, -1e18, s[0]), np.where(zero, 1e18, s[1]))
        fish = c[:, 28] > 0
        if fish.any():
            r, f = [np.sqrt(v) for v in t], c[:, 24:28].T
            turn = [np.arctan(v) for v in r]
            more = [np.array([f[i] * v ** (2 * i + 2) for i in range(4)]) for v in turn]
            bent = _times((turn[1] / np.maximum(r[1], 1e-12) * (r[1] > 1e-12) + (r[1] <= 1e-12), np.where(r[0] > 1e-12, turn[0] / np.maximum(r[0], 1e-12), 1.0)), (1 + np.minimum(*more).sum(axis=0), 1 + np.maximum(*more).sum(axis=0)))
            s = tuple(np.where(fish, b, o) for b, o in zip(bent, s, strict=True))
        u, v = _times(x, s), _times(y, s)
        if k[2:4].any():
            xy = _times(x, y)
            for own, square, one, two in ((u, x2, k[2], k[3]), (v, y2, k[3], k[2])):
                skew, along = _times((2 * one, 2 * one), xy), _times((two, two), (t[0] + 2 * square[0], t[1] + 2 * square[1]))
                own[0][:] += skew[0] + along[0]
                own[1][:] += skew[1] + along[1]
        least, most, seen, sure = 0.0, 0.0, z[1] > 0, ~near
        for (a, b), focal, centre, size in ((u, c[:, 12], c[:, 14], c[:, 29]), (v, c[:, 13], c[:, 15], c[:, 30])):
            first, last = np.minimum(focal * a, focal * b) + centre, np.maximum(focal * a, focal * b) + centre
            slack = 1e-6 + 1e-9 * (np.abs(first) + np.abs(last))
            first, last = first - slack, last + slack
            seen &= near | ((last >= size * margin) & (first < size - size * margin))
            sure &= (first >= size * margin) & (last < size - size * margin)
            off = ((first - size / 2) / (size / 2), (last - size / 2) / (size / 2))
            squared = _square(off)
            least, most = least + squared[0], most + squared[1]
    return np.where(near, 0.0, np.sqrt(least)), np.where(sure, np.sqrt(most), np.inf), seen


def _shortlist(xyz: np.ndarray, c: np.ndarray, margin: float, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place of a point, place of a camera) among which are the `limit` best images of each point, and few others.

    Points are halved along their box's longest side. In each box a camera goes that sees nothing of it, or scores worse at
    best than `limit` cameras that see all of it do at worst.
    """
    found, left = [], [(np.arange(len(xyz)), np.arange(len(c)))]
    while left:
        points, cams = left.pop()
        low, high = xyz[points].min(axis=0), xyz[points].max(axis=0)
        if len(points) > LEAF_POINTS and len(points) * len(cams) > LEAF_PAIRS or len(points) * len(cams) > 64 * LEAF_PAIRS:
            least, most, seen = _bounds(c[cams], low, high, margin)
            worst = np.partition(most, limit - 1)[limit - 1] if len(most) >= limit else np.inf
            cams = cams[seen & (least <= worst + 1e-6)]
            if len(points) > LEAF_POINTS and (high > low).any():
                axis = int(np.argmax(high - low))
                points = points[np.argsort(xyz[points, axis], kind="stable")]
                left += [(points[: len(points) // 2], cams), (points[len(points) // 2 :], cams)]
                continue
        if not len(cams):
            continue
        step = max(1, 64 * LEAF_PAIRS // len(cams))
        for start in range(0, len(points), step):
            some = points[start : start + step]
            z, u, v = _pixels(c[cams], xyz[some])
            w, h = c[cams, 29, None], c[cams, 30, None]
            with np.errstate(all="ignore"):
                score = np.hypot((u - w / 2) / (w / 2), (v - h / 2) / (h / 2))
                inside = lambda grown: (u >= w * margin - grown) & (u < w - w * margin + grown) & (v >= h * margin - grown) & (v < h - h * margin + grown) & (z > -1e-9 * (grown > 0))  # noqa: E731, B023
                sure = np.where(inside(-1e-6), score, np.inf)
                worst = np.partition(sure, limit - 1, axis=0)[limit - 1] if len(cams) >= limit else np.inf
                camera, point = np.nonzero(inside(1e-6) & (score <= worst + 1e-6))
            found.append((some[point], cams[camera]))
    return tuple(np.concatenate(side) if found else np.zeros(0, np.int64) for side in (zip(*found, strict=True) if found else ((), ())))


def _best(good: DataFrame, seen: DataFrame, extent: Row, margin: float, limit: int) -> DataFrame:
    """Points, each with the key of every `camera` that may be among its `limit` best, and few others.

    A task has the points of a cell of a coarse grid, or a part of them, and the cameras that may see it, or a part of them.
    """
    side = max(extent["hi_x"] - extent["lo_x"], extent["hi_y"] - extent["lo_y"]) / GRID or 1.0
    at = lambda c, low: F.floor((c - extent[low]) / side).cast("long")
    placed = good.withColumns({"gx": at(F.col("x"), "lo_x"), "gy": at(F.col("y"), "lo_y")})
    cells = cut(placed.groupBy("gx", "gy").agg(F.ceil(F.count(F.lit(1)) / TASK_POINTS).alias("parts")))  # (GRID + 1) squared at most
    chunks = max(1, -(-seen.count() // TASK_CAMERAS))
    keys = ["gx", "gy", "part", "chunk"]
    placed = placed.join(F.broadcast(cells), ["gx", "gy"]).withColumn("part", F.pmod(F.xxhash64("x", "y", "z"), F.col("parts"))).drop("parts")
    placed = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    around = [F.sequence(at(F.col(a), low), at(F.col(b), low)) for a, b, low in (("west", "east", "lo_x"), ("south", "north", "lo_y"))]
    laid = _numbers(seen.drop("level")).withColumn("chunk", F.pmod(F.xxhash64("camera"), F.lit(chunks)).cast("int"))
    laid = laid.withColumn("gx", F.explode(around[0])).withColumn("gy", F.explode(around[1])).drop("west", "south", "east", "north")
    laid = laid.join(F.broadcast(cells), ["gx", "gy"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def pick(points: pd.DataFrame, cameras: pd.DataFrame) -> pd.DataFrame:
        p, c = _shortlist(points[["x", "y", "z"]].to_numpy(float), cameras[_NUMBERS].to_numpy(float), margin, limit)
        return points[["point", "x", "y", "z"]].iloc[p].assign(camera=cameras["camera"].to_numpy()[c])

    schema = StructType([*good.schema, StructField("camera", LongType())])
    return placed.groupBy(*keys).cogroup(laid.groupBy(*keys)).applyInPandas(pick, schema)


def views(points: DataFrame, cameras: DataFrame, cell: float, margin: float = 0.0, known: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Images that see a point inside their frame: point, image, pixel_x, pixel_y, score, rank.

    `points` has point, x, y, z; the frame is half-open and shrunk by a share `margin` of each side. The score is the distance
    from the frame's centre in half frames. Images rank by (score, image); with `limit` only the first ones stay, and
    pairs (point, image) of `known` are left out first. Points with a null coordinate see nothing.

    Scores rank rounded to nine digits. Each camera goes to the ground cells around what it can see between the lowest and
    the highest point, larger cells where these would be many; points meet the cameras of their cell, not all of them. A camera
    without bound (a level view, a lens of half a sphere) meets the whole extent of the points. With `limit` points
    meet only those cameras that bounds of the score in boxes of points leave (`_shortlist`), or a point's worst `known` images more.
    """
    if not 0 <= margin < 0.5 or (limit is not None and limit < 1):
        raise ValueError("a margin is in [0, 0.5), a limit positive")
    good = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select("point", *[F.col(c).cast("double") for c in "xyz"])
    extent = good.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    none = "point, image, CAST(NULL AS DOUBLE) AS pixel_x, CAST(NULL AS DOUBLE) AS pixel_y, CAST(NULL AS DOUBLE) AS score, 0L AS rank".split(", ")
    if extent["lo_x"] is None:
        return good.select("point").join(cameras.select("image"), F.lit(False)).selectExpr(*none)
    seen = seen_ground(cameras.select("image", "width", "height", "model", "params", "pose"), extent["lo_z"], extent["hi_z"])
    edges = {"west": (F.greatest, "lo_x"), "south": (F.greatest, "lo_y"), "east": (F.least, "hi_x"), "north": (F.least, "hi_y")}
    for name, (tighter, bound) in edges.items():
        seen = seen.withColumn(name, F.coalesce(tighter(F.col(f"ground.{name}"), F.lit(extent[bound])), F.lit(extent[bound])))
    seen = seen.where("west <= east AND south <= north").drop("ground")
    side = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    seen = seen.withColumn("camera", F.monotonically_increasing_id())
    seen = cut(seen.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(cell)) / (SIDE_CELLS * cell)))).cast("int")))
    if limit is None:
        levels = [r["level"] for r in seen.select("level").distinct().collect()]  # no more than a double has exponents
        size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("level"))
        at = lambda c: F.floor(c / size).cast("long")
        laid = seen.withColumn("cx", F.explode(F.sequence(at(F.col("west")), at(F.col("east"))))).withColumn("cy", F.explode(F.sequence(at(F.col("south")), at(F.col("north")))))
        placed = good.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>"))).withColumns({"cx": at(F.col("x")), "cy": at(F.col("y"))})
        met = placed.join(laid.drop("west", "south", "east", "north"), ["level", "cx", "cy"])
    else:
        beside = 0 if known is None else known.groupBy("point").count().agg(F.max("count")).first()[0] or 0
        met = _best(good, seen, extent, margin, limit + beside).join(seen.drop("west", "south", "east", "north", "level"), "camera")
    pixel = projected(F.col("model"), F.col("params"), F.col("pose"), F.col("x"), F.col("y"), F.col("z"))
    found = met.withColumn("p", pixel).select("point", "image", "width", "height", F.col("p.x").alias("pixel_x"), F.col("p.y").alias("pixel_y"))
    inside = lambda p, n: (p >= F.col(n) * margin) & (p < F.col(n) - F.col(n) * margin)
    found = found.where(inside(F.col("pixel_x"), "width") & inside(F.col("pixel_y"), "height"))
    off = lambda p, n: (p - F.col(n) / 2) / (F.col(n) / 2)
    found = found.withColumn("score", F.hypot(off(F.col("pixel_x"), "width"), off(F.col("pixel_y"), "height")))
    if known is not None:
        found = found.join(known.select("point", "image"), ["point", "image"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("point").orderBy(F.round("score", 9), "image")).cast("long")
    ranked = found.select("point", "image", "pixel_x", "pixel_y", "score", rank.alias("rank"))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def block_crops(
    cameras: DataFrame, blocks: DataFrame, low: float, high: float, margin: int = 128, most_incidence: float = 75.0, least_overlap: float = 1.0, least_crop: int = 32
) -> DataFrame:
    """The part of an image that shows a block of ground between two heights: image, block, x, y, width, height, overlap, incidence.

    `cameras` has image, width, height, fx, fy, cx, cy and pose (no lens), `blocks` has block, west, south, east, north. A camera's
    footprint at either height is the quadrangle of its corner rays; a camera one of whose rays misses the ground, that
    looks away from straight down by more than the incidence, or is not above the ground has none. A pair is kept if
    at one height the block has at least that area of the footprint. The crop holds the clipped footprints of both heights and a
    margin, within the image.

    Footprints and blocks meet in cells as large as a block is on average, a pair once, in the cell of the lower left corner
    of what their boxes have in common.
    """
    if margin < 0 or not 0 < most_incidence < 90:
        raise ValueError("a margin is not negative, an incidence within 0 and 90 degrees")
    cameras = cut(cameras.select("image", "width", "height", "fx", "fy", "cx", "cy", "pose"))
    pose = F.col("pose")
    centre = [-sum((pose[4 * r + i] * pose[4 * r + 3] for r in range(3)), F.lit(0.0)) for i in range(3)]
    posed = cameras.withColumn("c", F.array(*centre)).withColumn("incidence", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -pose[10])))))
    posed = posed.where((F.col("incidence") <= most_incidence) & (F.col("c")[2] > high))

    def ray(u: Column, v: Column) -> Column:
        x, y = (u - F.col("cx")) / F.col("fx"), (v - F.col("cy")) / F.col("fy")
        return F.array(*[pose[i] * x + pose[4 + i] * y + pose[8 + i] for i in range(3)])

    zero = F.lit(0.0)
    rays = F.array(ray(zero, zero), ray(F.col("width"), zero), ray(F.col("width"), F.col("height")), ray(zero, F.col("height")))
    posed = posed.withColumn("rays", rays).where(F.forall("rays", lambda r: r[2] < -1e-9))
    at = lambda level: F.transform("rays", lambda r: F.struct(*[(F.col("c")[i] + (level - F.col("c")[2]) / r[2] * r[i]).alias("xy"[i]) for i in range(2)]))
    posed = posed.withColumns({"low": at(low), "high": at(high)})
    edge = lambda pick, c: pick(F.transform(F.concat("low", "high"), lambda p: p[c]))
    boxed = cut(posed.withColumns({"w": edge(F.array_min, "x"), "s": edge(F.array_min, "y"), "e": edge(F.array_max, "x"), "n": edge(F.array_max, "y")}))
    side = blocks.agg(F.avg(F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south")))).first()[0]
    size = max(float(side or 1.0), 1e-6)
    extent = blocks.agg(F.min("west"), F.min("south"), F.max("east"), F.max("north")).first()
    cell = lambda c: F.floor(c / size).cast("long")

    def spread(df: DataFrame, west: Column, south: Column, east: Column, north: Column) -> DataFrame:
        return df.where((west <= east) & (south <= north)).withColumn("gx", F.explode(F.sequence(cell(west), cell(east)))).withColumn("gy", F.explode(F.sequence(cell(south), cell(north))))

    if extent[0] is None:
        extent = (0.0, 0.0, -1.0, -1.0)
    # A footprint beyond all blocks fills no cells there.
    w, s, e, n = (f(F.col(c), F.lit(float(b))) for f, c, b in zip((F.greatest, F.greatest, F.least, F.least), "wsen", extent, strict=True))
    met = spread(boxed, w, s, e, n).join(spread(blocks, *[F.col(c) for c in ("west", "south", "east", "north")]), ["gx", "gy"])
    met = met.where((cell(F.greatest("w", "west")) == F.col("gx")) & (cell(F.greatest("s", "south")) == F.col("gy")) & (F.col("w") <= F.col("east")) & (F.col("west") <= F.col("e")) & (F.col("s") <= F.col("north")) & (F.col("south") <= F.col("n")))
    bounds = [F.col(c) for c in ("west", "south", "east", "north")]
    shaped = met.withColumns({"low": clip_ring(F.col("low"), *bounds), "high": clip_ring(F.col("high"), *bounds)})
    shaped = shaped.withColumns({"a_low": F.abs(ring_area(F.col("low"))), "a_high": F.abs(ring_area(F.col("high")))})
    shaped = shaped.withColumn("overlap", F.greatest("a_low", "a_high")).where(F.col("overlap") >= least_overlap)

    def pixels(ring: str, level: float) -> Column:
        def pixel(p: Column) -> Column:
            d = [p["x"] - F.col("c")[0], p["y"] - F.col("c")[1], F.lit(level) - F.col("c")[2]]
            x, y, z = (sum((pose[4 * r + i] * d[i] for i in range(3)), F.lit(0.0)) for r in range(3))
            return F.struct((F.col("fx") * x / z + F.col("cx")).alias("u"), (F.col("fy") * y / z + F.col("cy")).alias("v"))

        return F.when(F.col(f"a_{ring}") > 0, F.transform(ring, pixel)).otherwise(F.array().cast("array<struct<u:double,v:double>>"))

    shown = shaped.withColumn("pixels", F.concat(pixels("low", low), pixels("high", high)))
    along = lambda pick, c: pick(F.transform("pixels", lambda p: p[c]))
    shown = shown.withColumns({"l": along(F.array_min, "u"), "t": along(F.array_min, "v"), "r": along(F.array_max, "u"), "b": along(F.array_max, "v")})
    left, top = (F.greatest(F.lit(0).cast("long"), stable_floor(F.col(c)) - margin) for c in "lt")
    right, bottom = (F.least(F.col(most).cast("long"), stable_ceil(F.col(c)) + margin) for c, most in (("r", "width"), ("b", "height")))
    crop = shown.select("image", "block", left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height"), "overlap", "incidence")
    return crop.where((F.col("width") >= least_crop) & (F.col("height") >= least_crop))
