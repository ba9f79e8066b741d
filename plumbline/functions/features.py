"""Geometries, projections, rotations and lenses as column expressions."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half the width of the Web Mercator square and the radius of its sphere, in metres (fixed values).
MERCATOR_HALF = 20037508.342789244
MERCATOR_RADIUS = 6378137.0


def parse_box(raw: Column) -> Column:
    """`west,south,east,north` as an array of numbers, or null unless they are finite, in order and on the globe."""
    parts = F.transform(F.split(raw, ","), lambda p: F.trim(p).try_cast("double"))
    w, s, e, n = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3, 4))
    good = (F.size(parts) == 4) & (w < e) & (s < n) & w.between(-180, 180) & e.between(-180, 180) & s.between(-90, 90) & n.between(-90, 90)
    return F.when(good, parts)


def _points(ring: Column) -> Column:
    return F.array_join(F.transform(ring, lambda p: F.concat(F.format_string("%.3f", p["x"]), F.lit(" "), F.format_string("%.3f", p["y"]))), ", ")


def closed_ring(ring: Column) -> Column:
    """A ring whose last point is its first one; an empty one stays empty."""
    first, last = F.try_element_at(ring, F.lit(1)), F.try_element_at(ring, F.lit(-1))
    return F.when((F.size(ring) > 0) & ~first.eqNullSafe(last), F.concat(ring, F.array(first))).otherwise(ring)


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), F.format_string("%.3f", x), F.lit(" "), F.format_string("%.3f", y), F.lit(")"))


def line_wkt(line: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), _points(line), F.lit(")"))


def polygon_wkt(ring: Column) -> Column:
    return F.concat(F.lit("POLYGON (("), _points(closed_ring(ring)), F.lit("))"))


def point_wkb(x: Column, y: Column) -> Column:
    """Little-endian well-known binary of a point, in hex: doubles by their bits, without a Python function."""
    return F.concat(F.lit("0101000000"), _double_hex(x), _double_hex(y))


def _double_hex(x: Column) -> Column:
    """The eight bytes of a double, least significant first, in hex."""
    a = F.abs(x.cast("double"))
    power = F.greatest(F.floor(F.log2(a)), F.lit(-1022)).cast("double")
    # The logarithm may round over a power of two.
    power = F.when(a < F.pow(F.lit(2.0), power), power - 1).when(a >= F.pow(F.lit(2.0), power + 1), power + 1).otherwise(power)
    fraction = ((a / F.pow(F.lit(2.0), power) - 1) * 2.0**52).cast("long")
    bits = F.shiftleft((power + 1023).cast("long"), 52).bitwiseOR(fraction)
    bits = F.when(a == 0, F.lit(0).cast("long")).otherwise(bits)
    bits = F.when(x < 0, bits.bitwiseOR(F.lit(-(2**63)))).otherwise(bits)
    text = F.lpad(F.hex(bits), 16, "0")
    return F.concat(*[F.substring(text, 15 - 2 * i, 2) for i in range(8)])


def ring_centroid(ring: Column) -> Column:
    """Centroid (x, y) of a ring's area; of its corners where it has none."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, i)
    steps = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(at(i)["x"].alias("x"), at(i)["y"].alias("y"), at(i % n + 1)["x"].alias("u"), at(i % n + 1)["y"].alias("v")))
    cross = lambda s: s["x"] * s["v"] - s["u"] * s["y"]
    total = lambda f: F.aggregate(F.transform(steps, f), F.lit(0.0), lambda a, b: a + b)
    area = total(cross) / 2
    mean = lambda k: F.aggregate(F.transform(ring, lambda p: p[k].cast("double")), F.lit(0.0), lambda a, b: a + b) / n
    flat = F.abs(area) < 1e-12
    x = F.when(flat, mean("x")).otherwise(total(lambda s: (s["x"] + s["u"]) * cross(s)) / (6 * area))
    y = F.when(flat, mean("y")).otherwise(total(lambda s: (s["y"] + s["v"]) * cross(s)) / (6 * area))
    return F.when(n > 0, F.struct(x.alias("x"), y.alias("y")))


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a ring or on its edge."""
    from .geometry import point_in_ring

    n = F.size(ring)

    def on_edge(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i % n + 1)
        flat = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return flat & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    edge = F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), on_edge)
    return F.when(n >= 3, edge | point_in_ring(x, y, ring)).otherwise(False)


def clip_ring(ring: Column, west: Column | float, south: Column | float, east: Column | float, north: Column | float) -> Column:
    """The part of a ring (an array of x, y structs) inside a rectangle: cut by one half-plane after another.

    Each cut reads the whole ring before it, which nested expressions cannot do without doubling themselves.
    """

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def clipped(rings: pd.Series, w: pd.Series, s: pd.Series, e: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for corners, *bounds in zip(rings, w, s, e, n, strict=True):
            points = None if corners is None else [(float(p["x"]), float(p["y"])) for p in corners]
            for axis, bound, sign in zip((0, 1, 0, 1), bounds, (1.0, 1.0, -1.0, -1.0), strict=True):
                kept = []
                for before, now in zip(points[-1:] + points[:-1], points, strict=True) if points else ():
                    was, is_in = sign * before[axis] >= sign * bound, sign * now[axis] >= sign * bound
                    if was != is_in:
                        t = (bound - before[axis]) / (now[axis] - before[axis])
                        other = before[1 - axis] + t * (now[1 - axis] - before[1 - axis])
                        kept.append((bound, other) if axis == 0 else (other, bound))
                    if is_in:
                        kept.append(now)
                points = kept if points is not None else None
            out.append(None if points is None else [{"x": x, "y": y} for x, y in points])
        return pd.Series(out)

    sides = [side if isinstance(side, Column) else F.lit(float(side)) for side in (west, south, east, north)]
    return clipped.asNondeterministic()(ring, *sides)  # so that Catalyst keeps it out of the lambdas that read its result


def to_web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """x and y in metres of a point in degrees."""
    return lon * (MERCATOR_HALF / 180), F.log(F.tan((lat + 90) * (math.pi / 360))) * MERCATOR_RADIUS


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a point in metres."""
    return F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS))) - 90, x / MERCATOR_HALF * 180


def pixel_to_world(transform: tuple[float, float, float, float, float, float], col: Column, row: Column) -> tuple[Column, Column]:
    """x and y of a pixel by origin, column step and row step of x, and the same of y."""
    x0, xc, xr, y0, yc, yr = transform
    return x0 + xc * col + xr * row, y0 + yc * col + yr * row


def ellipsoid_area(a: Column, b: Column, c: Column) -> Column:
    """Surface of an ellipsoid, to about one per cent."""
    p = 1.6075
    return 4 * math.pi * F.pow((F.pow(a * b, F.lit(p)) + F.pow(a * c, F.lit(p)) + F.pow(b * c, F.lit(p))) / 3, F.lit(1 / p))


def stable_floor(x: Column) -> Column:
    """The floor of a number that rounding may have put just below a whole one."""
    return F.floor(x + 1e-9 * F.greatest(F.lit(1.0), F.abs(x))).cast("long")


def stable_ceil(x: Column) -> Column:
    return F.ceil(x - 1e-9 * F.greatest(F.lit(1.0), F.abs(x))).cast("long")


def depth_to_height(depth: Column, camera: Column) -> Column:
    """Height of what lies at a depth below a camera; null without a finite positive depth."""
    return F.when((depth > 0) & (depth < float("inf")) & ~F.isnan(depth), camera - depth)


def quaternion_matrix(w: Column, x: Column, y: Column, z: Column) -> Column:
    """The nine entries, row by row, of the rotation of a quaternion of any length but 0."""
    n = F.nullif(F.sqrt(w * w + x * x + y * y + z * z), F.lit(0.0))
    a, b, c, d = w / n, x / n, y / n, z / n
    return F.array(
        1 - 2 * (c * c + d * d), 2 * (b * c - a * d), 2 * (b * d + a * c),
        2 * (b * c + a * d), 1 - 2 * (b * b + d * d), 2 * (c * d - a * b),
        2 * (b * d - a * c), 2 * (c * d + a * b), 1 - 2 * (b * b + c * c),
    )


def distorted(model: Column, params: Column, x: Column, y: Column) -> Column:
    """Where a lens puts a normalised point: (x, y). `params` are the model's distortion terms in order.

    Models: SIMPLE_PINHOLE and PINHOLE (none), SIMPLE_RADIAL (k), RADIAL (k1, k2), OPENCV (k1, k2, p1, p2), FULL_OPENCV
    (k1, k2, p1, p2, k3 to k6) and OPENCV_FISHEYE (k1 to k4); any other gives null.
    """
    k = lambda i: F.coalesce(F.try_element_at(params, F.lit(i)), F.lit(0.0))
    r2 = x * x + y * y
    r = F.sqrt(r2)
    theta = F.atan(r)
    t2 = theta * theta
    fish = F.when(r > 1e-12, theta * (1 + t2 * (k(1) + t2 * (k(2) + t2 * (k(3) + t2 * k(4))))) / F.nullif(r, F.lit(0.0))).otherwise(1.0)
    two = 1 + k(1) * r2 + k(2) * r2 * r2
    full = (two + k(5) * r2 * r2 * r2) / F.nullif(1 + k(6) * r2 + k(7) * r2 * r2 + k(8) * r2 * r2 * r2, F.lit(0.0))
    tilt_x, tilt_y = 2 * k(3) * x * y + k(4) * (r2 + 2 * x * x), 2 * k(4) * x * y + k(3) * (r2 + 2 * y * y)
    cv_x = x * two + 2 * k(3) * x * y + k(4) * (r2 + 2 * x * x)
    cv_y = y * two + 2 * k(4) * x * y + k(3) * (r2 + 2 * y * y)
    pair = lambda u, v: F.struct(u.alias("x"), v.alias("y"))
    return (
        F.when(model.isin("SIMPLE_PINHOLE", "PINHOLE"), pair(x * 1.0, y * 1.0))
        .when(model == "SIMPLE_RADIAL", pair(x * (1 + k(1) * r2), y * (1 + k(1) * r2)))
        .when(model == "RADIAL", pair(x * two, y * two))
        .when(model == "OPENCV", pair(cv_x, cv_y))
        .when(model == "FULL_OPENCV", pair(x * full + tilt_x, y * full + tilt_y))
        .when(model == "OPENCV_FISHEYE", pair(x * fish, y * fish))
    )


def newest(*times: Column) -> Column:
    """The latest of some times, null ones left out."""
    return F.greatest(*times) if len(times) > 1 else times[0]


def merged_parameters(defaults: Column, *overrides: Column) -> Column:
    """A map of defaults in which later maps' values win; null values and keys that the defaults lack change nothing."""
    def over(old: Column, more: Column) -> Column:
        known = F.map_filter(F.coalesce(more, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & F.map_contains_key(defaults, k))
        latest = lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.try_element_at(known, e["key"]), e["value"]).alias("value"))
        return F.map_from_entries(F.transform(F.map_entries(old), latest))

    return reduce(over, overrides, defaults)


def parameter_matches(actual: Column, expected: Column, tolerance: float = 1e-9) -> Column:
    """Whether two values given as text are equal: as numbers within a relative tolerance where both are, as truth values or text else."""
    a, b = actual.try_cast("double"), expected.try_cast("double")
    numbers = F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    return F.coalesce(numbers, F.lower(F.trim(actual)) == F.lower(F.trim(expected)), actual.isNull() & expected.isNull())


def gravity(pitch: Column, roll: Column) -> Column:
    """The direction of gravity in a camera's axes (x right, y down, z ahead) from its gimbal's angles in degrees.

    Pitch is elevation, -90 straight down; roll is about the axis of view; yaw does not matter. Null for an angle that is
    null or not finite.
    """
    p, r = F.radians(pitch), F.radians(roll)
    down = F.struct((F.sin(r) * F.cos(p)).alias("x"), (F.cos(r) * F.cos(p)).alias("y"), (-F.sin(p)).alias("z"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(finite(pitch.cast("double")) & finite(roll.cast("double")), down)


def mask_polygons(polygons: Column, dx: Column | float = 0.0, dy: Column | float = 0.0) -> Column:
    """Polygons of a mask (arrays of rings of [x, y]) moved by an offset; null if one is not sound.

    A polygon has an outer ring at least; a ring has four points at least, is closed, and its points are pairs of finite numbers.
    """
    dx, dy = (v if isinstance(v, Column) else F.lit(float(v)) for v in (dx, dy))
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    pair = lambda p: (F.size(p) == 2) & F.forall(p, number)
    sound = lambda ring: (F.size(ring) >= 4) & F.forall(ring, pair) & (F.get(ring, 0) == F.element_at(ring, -1))
    good = F.forall(polygons, lambda polygon: (F.size(polygon) > 0) & F.forall(polygon, lambda ring: F.when(F.size(ring) >= 4, sound(ring)).otherwise(False)))
    moved = F.transform(polygons, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.array(F.get(p, 0) + dx, F.get(p, 1) + dy))))
    return F.when(F.coalesce(good, F.lit(False)), moved)
