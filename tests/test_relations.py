"""Mutations, usage aggregates, links, features and detections on small tables."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import features
from plumbline.operators import detections, linking, matching, mutations, points, stateful, statistics, usage


def _one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_optimistic_update(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 5, "b"), (3, 1, "c")], "id long, version long, v string")
    changes = spark.createDataFrame([(1, 1, "x"), (2, 4, "y"), (9, 1, "z")], "id long, version long, v string")
    got = {r["id"]: tuple(r)[1:] for r in mutations.optimistic_update(rows, changes, "id", "version", "v").collect()}
    assert got == {1: (2, "x", "updated"), 2: (5, "b", "conflict"), 3: (1, "c", None), 9: (None, None, "missing")}


def test_append_only(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    mutations.append_only(rows, path, "id")
    mutations.append_only(rows.selectExpr("id + 2 AS id", "v"), path, "id")
    with pytest.raises(ValueError):
        mutations.append_only(rows, path, "id")
    assert spark.read.parquet(path).count() == 4


def test_run_states(spark):
    rows = [("a", 1, "succeeded"), ("a", 2, "running"), ("a", 3, "running"), ("a", 4, "failed"), ("a", 5, "succeeded"), ("b", 1, "cancelled"), ("b", 2, "running"), ("c", 1, "failed")]
    got = {r["run"]: (r["state"], r["n_refused"]) for r in mutations.run_states(spark.createDataFrame(rows, "run string, at int, s string"), "run", "at", "s").collect()}
    assert got == {"a": ("failed", 3), "b": ("cancelled", 1), "c": ("queued", 1)}


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=101), "b": rng.normal(size=4), None: np.array([3.0])}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("a", None), ("a", math.nan), ("a", math.inf), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    wanted = {"lin": ("linear", 0.3), "near": ("nearest", 0.95), "low": ("floor", 0.75)}
    got = {r["k"]: (r["lin"], r["near"], r["low"]) for r in statistics.quantiles(df, ["k"], F.col("v"), wanted).collect()}
    for k, x in values.items():
        s = np.sort(x)
        assert got[k] == pytest.approx((np.quantile(s, 0.3), s[max(0, math.ceil(len(s) * 0.95) - 1)], s[math.floor((len(s) - 1) * 0.75)]))
    assert got["d"] == (None, None, None)


def test_rays_and_similarities(spark):
    origins = [(0.0, 0.0, 0.0), (10.0, 0.0, 0.0), (0.0, 8.0, 1.0), (3.0, 3.0, 9.0)]
    target = np.array([4.0, 5.0, 6.0])
    rows = [(*o, *(float(t) for t in (target - np.array(o)) * 0.7)) for o in origins]
    rays = spark.createDataFrame(rows, "x double, y double, z double, u double, v double, w double")
    assert usage.ray_intersection(rays, ["x", "y", "z"], ["u", "v", "w"])["point"] == pytest.approx(target)
    with pytest.raises(ValueError):
        usage.ray_intersection(rays.limit(1), ["x", "y", "z"], ["u", "v", "w"])
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 3))
    turn = np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    b = 3 * a @ turn.T + np.array([1.0, 2.0, 3.0])
    b[:4] += 50  # outliers
    pairs = spark.createDataFrame([(*map(float, p), *map(float, q)) for p, q in zip(a, b, strict=True)], "x double, y double, z double, u double, v double, w double")
    fit = usage.robust_similarity(pairs, ["x", "y", "z"], ["u", "v", "w"])
    assert fit["n"] == 36 and fit["scale"] == pytest.approx(3) and fit["rotation"] == pytest.approx(turn, abs=1e-9)


def test_farthest_pair(spark):
    rng = np.random.default_rng(8)
    for x in (rng.normal(size=(500, 2)), np.array([[1.0, 1.0]]), np.array([[0.0, 0.0], [3.0, 4.0]]), np.stack([np.arange(50.0), np.zeros(50)], axis=1)):
        df = spark.createDataFrame([tuple(map(float, p)) for p in x], "x double, y double").repartition(3)
        want = max(float(np.hypot(*(p - q))) for p in x for q in x)
        assert linking.farthest_pair(df, "x", "y", 4).first()["diameter"] == pytest.approx(want)
    assert [r["diameter"] for r in linking.farthest_pair(df.limit(0), "x", "y").collect()] == [None]


def test_untested_so_far(spark):
    """Clock offsets, name ranges, components, retention, concatenation and smoothed rates."""
    left = spark.createDataFrame([("k", 10_000)], "k string, at long")
    right = spark.createDataFrame([("k", 10_000 - 3 * 3600 + 5)], "k string, at long")
    assert tuple(matching.clock_offset(left, right, "k", "at").first()) == ("k", 3, 5.0)
    names = spark.createDataFrame([("IMG_1.jpg",), ("img_5.JPG",), ("img_9.jpg",)], "n string")
    ranges = spark.createDataFrame([("img_4.jpg", "IMG_6.jpg")], "a string, b string")
    assert sorted(r["n"] for r in matching.excluded_ranges(names, "n", ranges, "a", "b").collect()) == ["IMG_1.jpg", "img_9.jpg"]
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, component long")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert sorted(r["id"] for r in points.largest_component(rows, "id", labels).collect()) == [1, 2]
    assert points.retained(rows, rows.limit(1), 0.5).first()["accepted"] is False
    assert points.concatenated_cores([rows, rows]).count() == 6
    with pytest.raises(ValueError):
        points.concatenated_cores([rows, labels])
    moves = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 10.0), ("a", 2.0, 10.0), ("a", 9.0, 50.0), ("a", 10.0, 51.0), ("b", 0.0, 1.0)], "k string, at double, v double")
    got = {(r["k"], r["at"]): r["velocity"] for r in stateful.smoothed_velocity(moves, "k", "at", "v").collect()}
    assert got == {("a", 0.0): None, ("a", 1.0): 10.0, ("a", 2.0): pytest.approx(4.0), ("a", 9.0): None, ("a", 10.0): 1.0, ("b", 0.0): None}


def test_feature_functions(spark):
    for x in (0.0, 1.0, -2.5, 1e-5, 123456.789, -0.1, 3.0e300, 2.0**60):
        assert _one(spark, features.point_wkb(F.lit(x), F.lit(-x)))[0].lower() == (b"\x01\x01\x00\x00\x00" + struct.pack("<dd", x, 0.0 if x == 0 else -x)).hex()
    matrix = _one(spark, features.quaternion_matrix(F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)))[0]
    assert matrix == pytest.approx([0, -1, 0, 1, 0, 0, 0, 0, 1], abs=1e-12)
    bent = _one(spark, features.distorted(F.lit("SIMPLE_RADIAL"), F.array(F.lit(0.1)), F.lit(0.5), F.lit(0.0)))[0]
    assert (bent["x"], bent["y"]) == pytest.approx((0.5 * 1.025, 0.0))
    assert _one(spark, features.distorted(F.lit("NO_LENS"), F.array(F.lit(0.1)), F.lit(0.5), F.lit(0.0)))[0] is None
    x, y = features.to_web_mercator(F.lit(48.5), F.lit(2.25))
    lat, lon = features.from_web_mercator(x, y)
    assert tuple(_one(spark, lat, lon)) == pytest.approx((48.5, 2.25))
    merged = features.merged_parameters(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("7"), F.lit("z"), F.lit("0")), F.create_map(F.lit("b"), F.lit(None).cast("string")))
    assert _one(spark, merged)[0] == {"a": "7", "b": "2"}
    cases = [("1.0", "1", True), ("true", " TRUE ", True), ("a", "b", False), (None, None, True), ("1", None, False)]
    assert [_one(spark, features.parameter_matches(F.lit(a).cast("string"), F.lit(b).cast("string")))[0] for a, b, _ in cases] == [c for _, _, c in cases]


def _inside(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def test_detections_are_suppressed_in_order(spark):
    rng = random.Random(3)
    rows = [(900, "car", 0.5, [(1.0, 1.0), (2.0, 2.0)], 1.5, 1.5), (901, "car", 0.5, [], 0.0, 0.0)]
    for i in range(160):
        w, h = (rng.choice([1, 2, 3, 8, 40]) for _ in "wh")
        x, y = rng.randrange(120), rng.randrange(60)
        ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)] if i % 3 else [(x, y), (x + w, y), (x, y + h)]
        rows.append((i, rng.choice(["car", "boat", None]), rng.choice([0.2, 0.9]), [(float(a), float(b)) for a, b in ring], x + w / 2, y + h / 2))
    df = spark.createDataFrame(rows, "id long, kind string, confidence double, ring array<struct<x:double,y:double>>, x double, y double")
    got = {r["id"] for r in detections.deduplicated(df.repartition(4), "id", "kind", "confidence", "ring", "x", "y", near=2.0, iou=0.3).where("kept").collect()}

    def area(r):
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True))) / 2

    def box(r):
        return min(p[0] for p in r), min(p[1] for p in r), max(p[0] for p in r), max(p[1] for p in r)

    def duplicate(small, big):
        r, k = small[3], big[3]
        if small[1] != big[1]:
            return False
        cross = [a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True)]
        cx = sum((a[0] + b[0]) * c for a, b, c in zip(r, r[1:] + r[:1], cross, strict=True)) / (3 * sum(cross))
        cy = sum((a[1] + b[1]) * c for a, b, c in zip(r, r[1:] + r[:1], cross, strict=True)) / (3 * sum(cross))
        if _inside(k, cx, cy) or any(_inside(k, *p) for p in r):
            return True
        p, q = box(r), box(k)
        i = max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1]))
        union = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - i
        return abs(small[4] - big[4]) <= 2 and abs(small[5] - big[5]) <= 2 and i / union >= 0.3

    kept = []
    for row in sorted((r for r in rows if len(r[3]) > 2), key=lambda r: (-area(r[3]), -r[2], r[0])):
        if not any(duplicate(row, k) for k in kept):
            kept.append(row)
    assert got == {r[0] for r in kept} | {900, 901} and len(kept) < 150


def test_detections_are_suppressed_alike_in_small_blocks(spark, monkeypatch):
    from plumbline.operators import suppression

    rng, rows = random.Random(13), []
    for i in range(150):
        x, y, w, h = rng.random() * 60, rng.random() * 30, rng.choice([1, 3, 25]), rng.choice([1, 2, 6])
        rows.append((i, "car", 0.5, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)], x, y))
    df = spark.createDataFrame(rows, "id long, kind string, confidence double, ring array<struct<x:double,y:double>>, x double, y double")
    want = {r["id"] for r in detections.deduplicated(df, "id", "kind", "confidence", "ring", "x", "y", near=2.0, iou=0.3).where("kept").collect()}
    monkeypatch.setattr(suppression, "BLOCK_BOXES", 30)
    got = {r["id"] for r in detections.deduplicated(df, "id", "kind", "confidence", "ring", "x", "y", near=2.0, iou=0.3).where("kept").collect()}
    assert got == want and 20 < len(got) < 150
