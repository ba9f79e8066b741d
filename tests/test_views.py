"""Projection joins against all cameras and points; camera indexes."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import views

LENSES = {"SIMPLE_PINHOLE": [], "PINHOLE": [], "SIMPLE_RADIAL": [-0.08], "RADIAL": [0.05, -0.02], "OPENCV": [0.03, -0.01, 0.002, -0.003], "FULL_OPENCV": [0.03, -0.01, 0.001, 0.002, 0.001, 0.02, 0.004, 0.001], "OPENCV_FISHEYE": [0.02, -0.01, 0.003, -0.001]}


def _camera(rng, i):
    model = rng.choice(list(LENSES))
    focal = [rng.uniform(300, 900)] if views.MODELS[model][1] == 3 else [rng.uniform(300, 900), rng.uniform(300, 900)]
    q = np.array([rng.gauss(0, 1) * (0.15 if i % 3 else 1) for _ in range(3)])
    turn = np.array([[1, 0, 0], [0, -1, 0], [0, 0, -1]]) @ np.linalg.qr(np.eye(3) + np.array([[0, -q[2], q[1]], [q[2], 0, -q[0]], [-q[1], q[0], 0]]) * 0.5)[0]
    turn *= np.sign(np.linalg.det(turn))
    centre = np.array([rng.uniform(-50, 250), rng.uniform(-50, 250), rng.choice([120, 120, 80, 3])])
    pose = np.column_stack([turn, -turn @ centre]).ravel().tolist()
    return f"i{i}", 800, 600, model, [*focal, 410.0, 290.0, *LENSES[model]], pose


def _pixel(camera, p):
    _, _, _, model, params, pose = camera
    x, y, z = np.array(pose).reshape(3, 4) @ np.array([*p, 1.0])
    if z <= 0:
        return None
    x, y = x / z, y / z
    n = views.MODELS[model][1]
    k, r2 = params[n:], x * x + y * y
    if model == "OPENCV_FISHEYE":
        r = math.sqrt(r2)
        t = math.atan(r)
        s = t * (1 + sum(c * t ** (2 * i + 2) for i, c in enumerate(k))) / r if r > 1e-12 else 1.0
        x, y = x * s, y * s
    elif model in ("OPENCV", "FULL_OPENCV"):
        s = 1 + k[0] * r2 + k[1] * r2**2
        if model == "FULL_OPENCV":
            s = (s + k[4] * r2**3) / (1 + k[5] * r2 + k[6] * r2**2 + k[7] * r2**3)
        x, y = x * s + 2 * k[2] * x * y + k[3] * (r2 + 2 * x * x), y * s + k[2] * (r2 + 2 * y * y) + 2 * k[3] * x * y
    else:
        s = 1 + sum(c * r2 ** (i + 1) for i, c in enumerate(k))
        x, y = x * s, y * s
    return (params[0] * x + params[n - 2], params[0 if n == 3 else 1] * y + params[n - 1])


@pytest.mark.parametrize("seed,margin,limit,cell", [(1, 0.0, None, 20.0), (2, 0.1, 4, 3.0), (3, 0.0, 2, 500.0)])
def test_against_all_pairs(spark, seed, margin, limit, cell):
    rng = random.Random(seed)
    cameras = [_camera(rng, i) for i in range(60)]
    points = [(i, rng.uniform(0, 200), rng.uniform(0, 200), rng.uniform(0, 12)) for i in range(150)]
    known = [(i, f"i{i % 60}") for i in range(0, 150, 2)]
    df = spark.createDataFrame([*points, (900, None, 1.0, 1.0)], "point long, x double, y double, z double")
    cams = spark.createDataFrame(cameras, "image string, width long, height long, model string, params array<double>, pose array<double>")
    found = views.views(df, cams, cell, margin, spark.createDataFrame(known, "point long, image string"), limit).collect()
    want = {}
    for i, *p in points:
        hits = []
        for c in cameras:
            at = _pixel(c, p)
            if at and (i, c[0]) not in known and 800 * margin <= at[0] < 800 - 800 * margin and 600 * margin <= at[1] < 600 - 600 * margin:
                hits.append((math.hypot((at[0] - 400) / 400, (at[1] - 300) / 300), c[0], at))
        for rank, (score, image, at) in enumerate(sorted(hits)[:limit], 1):
            want[i, image] = (rank, score, at)
    assert len(want) > 100
    assert {(r["point"], r["image"]) for r in found} == set(want)
    for r in found:
        rank, score, at = want[r["point"], r["image"]]
        assert r["rank"] == rank and r["score"] == pytest.approx(score) and (r["pixel_x"], r["pixel_y"]) == pytest.approx(at)


def test_index_leaves_cameras_out(spark):
    rng = random.Random(9)
    cams = spark.createDataFrame([_camera(rng, 1), _camera(rng, 2)], "image string, width long, height long, model string, params array<double>, pose array<double>")
    boxes = [r["ground"] for r in views.seen_ground(cams, 0.0, 10.0).collect()]
    assert all(b is None or b["west"] < b["east"] for b in boxes)
    none = spark.createDataFrame([], "point long, x double, y double, z double")
    assert views.views(none, cams, 1.0).columns == ["point", "image", "pixel_x", "pixel_y", "score", "rank"] and views.views(none, cams, 1.0).count() == 0
    one = spark.createDataFrame([(1, 1.0, 1.0, 1.0)], "point long, x double, y double, z double")
    assert views.views(one, cams.limit(0), 1.0).count() == 0
    for wrong in ({"margin": 0.5}, {"limit": 0}):
        with pytest.raises(ValueError):
            views.views(one, cams, 1.0, **wrong)


def test_camera_index(spark, tmp_path):
    pose = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]]
    image = {"image_name": "a", "width": 10, "height": 10, "model": "PINHOLE", "params": [1, 1, 5, 5], "cam_from_world": pose}
    changes = {"ok": {}, "name": {"image_name": " "}, "size": {"width": 0}, "parameters": {"params": [1, 1, 5]}, "pose": {"cam_from_world": pose[:2]}, "unknown": {"model": "THIN"}}
    index = {"schema_version": 1, "crs": "EPSG:2154", "images": [image | {"image_name": k} | v for k, v in changes.items()] + [image, image]}
    (tmp_path / "a.json").write_text(json.dumps(index, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(index | {"schema_version": 2, "images": [image]}))
    (tmp_path / "c.json").write_text(json.dumps(index | {"crs": "", "images": [image]}))
    rows = views.read_camera_index(spark, str(tmp_path)).collect()
    got = sorted((r["source_file"][-6:-5], r["image"], r["problem"] or "-") for r in rows)
    want = [("a", "", "name"), ("a", "a", "repeated name"), ("a", "a", "repeated name"), ("a", "ok", "-"), ("a", "parameters", "parameters"), ("a", "pose", "pose"), ("a", "size", "size"), ("b", "a", "version"), ("c", "a", "crs")]
    assert got == want
    good = next(r for r in rows if r["image"] == "ok")
    assert good["pose"] == [float(v) for row in pose for v in row]
    at = spark.createDataFrame([good], views.read_camera_index(spark, str(tmp_path)).schema).select(views.projected(F.col("model"), F.col("params"), F.col("pose"), F.lit(2.0), F.lit(4.0), F.lit(2.0)).alias("p")).first()["p"]
    assert tuple(at) == (6.0, 7.0)


def _crop(camera, block, low, high, margin):
    """One camera and one block, by plain geometry: clip the footprint with a fine polygon clipper, project its corners."""
    _, w, h, fx, fy, cx, cy, pose = camera
    m = np.array(pose).reshape(3, 4)
    turn, centre = m[:, :3], -m[:, :3].T @ m[:, 3]
    incidence = math.degrees(math.acos(np.clip(-turn[2, 2], -1, 1)))
    if incidence > 75 or centre[2] <= high:
        return None
    pixels, best = [], 0.0
    for level in (low, high):
        ring = []
        for u, v in ((0, 0), (w, 0), (w, h), (0, h)):
            ray = turn.T @ np.array([(u - cx) / fx, (v - cy) / fy, 1.0])
            if ray[2] >= -1e-9:
                return None
            ring.append(centre + (level - centre[2]) / ray[2] * ray)
        ring = [p[:2] for p in ring]
        for axis, bound, sign in ((0, block[1], 1), (0, block[3], -1), (1, block[2], 1), (1, block[4], -1)):
            out = []
            for a, b in zip(ring[-1:] + ring[:-1], ring, strict=True):
                if (sign * a[axis] >= sign * bound) != (sign * b[axis] >= sign * bound):
                    out.append(a + (bound - a[axis]) / (b[axis] - a[axis]) * (b - a))
                if sign * b[axis] >= sign * bound:
                    out.append(b)
            ring = out
        x, y = np.array([p[0] for p in ring]), np.array([p[1] for p in ring])
        area = abs(x @ np.roll(y, 1) - y @ np.roll(x, 1)) / 2 if len(ring) > 2 else 0.0
        best = max(best, area)
        if area > 0:
            for p in ring:
                q = turn @ (np.array([*p, level]) - centre)
                pixels.append((fx * q[0] / q[2] + cx, fy * q[1] / q[2] + cy))
    if best < 1 or not pixels:
        return None
    u, v = zip(*pixels, strict=True)
    tell = lambda f, x, d: int(f(x + d * 1e-9 * max(1, abs(x))))
    left, top = max(0, tell(math.floor, min(u), 1) - margin), max(0, tell(math.floor, min(v), 1) - margin)
    right, bottom = min(w, tell(math.ceil, max(u), -1) + margin), min(h, tell(math.ceil, max(v), -1) + margin)
    return (left, top, right - left, bottom - top, best) if right - left >= 32 and bottom - top >= 32 else None


def test_block_crops(spark):
    rng = random.Random(6)
    cameras = []
    for i in range(40):
        _, w, h, _, _, pose = _camera(rng, i)
        cameras.append((f"i{i}", w, h, 500.0, 520.0, 400.0, 300.0, pose))
    blocks = [(f"b{c}{r}", c * 40.0 - 5, r * 40.0 - 5, c * 40.0 + 45, r * 40.0 + 45) for c in range(5) for r in range(5)]
    cams = spark.createDataFrame(cameras, "image string, width long, height long, fx double, fy double, cx double, cy double, pose array<double>")
    table = spark.createDataFrame(blocks, "block string, west double, south double, east double, north double")
    found = {(r["image"], r["block"]): (r["x"], r["y"], r["width"], r["height"], r["overlap"]) for r in views.block_crops(cams, table, 0.0, 4.0, 20).collect()}
    want = {(c[0], b[0]): crop for c in cameras for b in blocks if (crop := _crop(c, b, 0.0, 4.0, 20))}
    assert len(want) > 60 and found.keys() == want.keys()
    for k, crop in want.items():
        assert found[k][:4] == crop[:4] and found[k][4] == pytest.approx(crop[4])
    assert views.block_crops(cams, table.limit(0), 0.0, 4.0).count() == 0 and views.block_crops(cams.limit(0), table, 0.0, 4.0).count() == 0
    with pytest.raises(ValueError):
        views.block_crops(cams, table, 0.0, 4.0, most_incidence=90.0)


def test_shortlist_keeps_the_best_and_little_else(spark, monkeypatch):
    rng = random.Random(4)
    cams = spark.createDataFrame([_camera(rng, i) for i in range(200)], "image string, width long, height long, model string, params array<double>, pose array<double>")
    rows = cams.withColumn("camera", F.lit(0)).collect()
    c = views._numbers(cams.withColumn("camera", F.monotonically_increasing_id())).toPandas()[views._NUMBERS].to_numpy(float)
    xyz = np.array([[rng.uniform(0, 200), rng.uniform(0, 200), rng.uniform(0, 12)] for _ in range(300)] + [[70.0, 70.0, 5.0]] * 40)
    monkeypatch.setattr(views, "LEAF_PAIRS", 64)
    points, cameras = views._shortlist(xyz, c, 0.05, 3)
    got = set(zip(points.tolist(), cameras.tolist(), strict=True))
    assert len(got) == len(points) <= 3 * len(xyz)
    for i, p in enumerate(xyz):
        at = {j: _pixel(tuple(r)[:6], p) for j, r in enumerate(rows)}
        hits = sorted((math.hypot((u - 400) / 400, (v - 300) / 300), j) for j, (u, v) in ((j, a) for j, a in at.items() if a) if 40 <= u < 760 and 30 <= v < 570)
        assert {(i, j) for _, j in hits[:3]} <= got
