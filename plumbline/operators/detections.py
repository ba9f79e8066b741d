"""Duplicate detections of objects: polygons that overlap, suppressed in order of size in blocks of the plane."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.features import ring_centroid
from plumbline.functions.geometry import ring_area

from .suppression import Hits, scanned


def _box(ring: Column) -> list[Column]:
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)]


def _contains(xs: list[float], ys: list[float], x: float, y: float) -> bool:
    """`ring_contains` for plain numbers: whether a point lies in a ring or on its edge."""
    odd = False
    for ax, ay, bx, by in zip(xs, ys, xs[1:] + xs[:1], ys[1:] + ys[:1], strict=True):
        if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def deduplicated(df: DataFrame, row_id: str, kind: str, confidence: str, ring: str, x: str, y: str, near: float = 40.0, iou: float = 0.05) -> DataFrame:
    """Add `kept`: larger objects first, then surer ones, an object is kept unless a kept one has it.

    One has another of its class if it holds the other's centroid or one of its corners (edges count), or if
    their centres lie at most `near` apart along each axis and their boxes overlap by `iou` or more. Rows whose
    ring has under three corners are kept and suppress nothing. Ties in area and confidence go by id. A null
    class is a class.
    """
    number = lambda c: F.col(c).cast("double")
    sure = F.coalesce(number(confidence), F.lit(0.0))
    polygons = df.where(F.size(ring) >= 3).select(
        F.col(row_id).alias("id"), F.concat(F.coalesce(F.col(kind).cast("string"), F.lit("")), F.when(F.col(kind).isNull(), "\n0").otherwise("\n1")).alias("group"),
        *[c.alias(name) for name, c in zip("wsen", _box(F.col(ring)), strict=True)], number(x).alias("x"), number(y).alias("y"), ring_centroid(F.col(ring)).alias("centre"),
        F.transform(ring, lambda p: p["x"].cast("double")).alias("ring_x"), F.transform(ring, lambda p: p["y"].cast("double")).alias("ring_y"), ring_area(F.col(ring)).alias("area"), F.when(F.isnan(sure), float("inf")).otherwise(sure).alias("sure"),
    )
    placed = polygons.select("*", F.col("centre.x").alias("centre_x"), F.col("centre.y").alias("centre_y")).drop("centre")

    def test(rows: pd.DataFrame) -> Hits:
        w, s, e, n, at_x, at_y, centre_x, centre_y = (rows[c].tolist() for c in ("w", "s", "e", "n", "x", "y", "centre_x", "centre_y"))
        xs, ys = ([list(map(float, r)) for r in rows[c]] for c in ("ring_x", "ring_y"))
        size = [(x - u) * (y - v) for u, v, x, y in zip(w, s, e, n, strict=True)]

        def hits(j: int, i: int) -> bool:
            if abs(at_x[j] - at_x[i]) <= near and abs(at_y[j] - at_y[i]) <= near:
                both = max(0.0, min(e[i], e[j]) - max(w[i], w[j])) * max(0.0, min(n[i], n[j]) - max(s[i], s[j]))
                union = size[i] + size[j] - both
                if (both / union if union > 0 else 0.0) >= iou:
                    return True
            left, low, right, top = w[j], s[j], e[j], n[j]
            inside = lambda x, y: left <= x <= right and low <= y <= top and _contains(xs[j], ys[j], x, y)
            return inside(centre_x[i], centre_y[i]) or any(map(inside, xs[i], ys[i]))

        return hits

    kept = scanned(placed, "group", [-F.col("area"), -F.col("sure"), F.col("id")], ["x", "y", "centre_x", "centre_y", "ring_x", "ring_y"], test)
    out = df.join(kept.select(F.col("id").alias("__id")), F.col(row_id) == F.col("__id"), "left")
    polygon = F.coalesce(F.size(ring) >= 3, F.lit(False)) & F.col(row_id).isNotNull()
    return out.withColumn("kept", ~polygon | F.col("__id").isNotNull()).drop("__id")
