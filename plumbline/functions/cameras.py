"""What a camera sees of boxes, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[float, float, float]

#: Pixels of a merged tile's radius on the screen that count as one pixel of error.
RADIUS_PER_ERROR = 64


def _dot(a: Vector, b: Vector) -> float:
    return sum(x * y for x, y in zip(a, b, strict=True))


def _cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _unit(a: Vector) -> Vector:
    length = math.sqrt(_dot(a, a))
    if not math.isfinite(length) or length <= 1e-9:
        raise ValueError("a camera needs a direction and an up vector that differ")
    return a[0] / length, a[1] / length, a[2] / length


@dataclass(frozen=True)
class Camera:
    """A pinhole camera: where it is, where it looks, its vertical opening in radians and its screen in pixels."""

    position: Vector
    direction: Vector
    up: Vector
    opening: float
    width: int
    height: int

    def planes(self) -> list[Vector]:
        """Inner normals of the planes through the camera that bound what it sees."""
        ahead = _unit(self.direction)
        right = _unit(_cross(ahead, _unit(self.up)))
        above = _unit(_cross(right, ahead))
        tall = math.tan(self.opening / 2)
        wide = tall * self.width / self.height
        sides = [(axis, reach, sign) for axis, reach in ((right, wide), (above, tall)) for sign in (-1, 1)]
        return [ahead, *[tuple(a * reach + b * sign for a, b in zip(ahead, axis, strict=True)) for axis, reach, sign in sides]]

    @property
    def focal(self) -> float:
        """Pixels of a unit length at unit depth."""
        return self.height / (2 * math.tan(self.opening / 2))


def seen(camera: Camera, low: list[Column], high: list[Column], error: Column, inner: Column) -> Column:
    """Of a box: visible, radius on the screen and projected error in pixels, as a struct.

    `error` is a length in the scene; only an `inner` node, one that merged tiles stand for, has an error, and its own
    footprint counts as one. A box is visible unless it lies beyond one of the planes.
    """
    centre = [(a + b) / 2 - c for a, b, c in zip(low, high, camera.position, strict=True)]
    half = [(b - a) / 2 for a, b in zip(low, high, strict=True)]

    def along(plane: Vector) -> Column:
        return sum((c * p for c, p in zip(centre, plane, strict=True)), F.lit(0.0))

    visible = F.lit(True)
    for plane in camera.planes():
        visible &= along(plane) + sum((h * abs(p) for h, p in zip(half, plane, strict=True)), F.lit(0.0)) >= 0
    size = F.sqrt(sum((h * h for h in half), F.lit(0.0)))
    radius = F.when(visible, size * camera.focal / F.greatest(along(camera.planes()[0]) - size, F.lit(1e-6))).otherwise(0.0)
    outside = [F.greatest(a - p, F.lit(0.0), p - b) for a, b, p in zip(low, high, camera.position, strict=True)]
    distance = F.greatest(F.sqrt(sum((d * d for d in outside), F.lit(0.0))), F.lit(1e-6))
    scene = F.when(error > 0, error * camera.focal / F.greatest(distance, error)).otherwise(0.0)
    footprint = F.least(radius, F.lit(camera.focal)) / RADIUS_PER_ERROR
    return F.struct(visible.alias("visible"), radius.alias("radius"), F.when(visible & inner, F.greatest(scene, footprint)).otherwise(0.0).alias("error"))
