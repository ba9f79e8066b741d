"""Stage plans, inserted features, gravity and masks against plain Python."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import features
from plumbline.operators import mutations, stateful

NEEDS = [("train", "map"), ("filter", "train"), ("raster", "map"), ("raster", "filter"), ("detect", "raster")]


def test_planned_stages(spark):
    selected = [(r, s, "{}") for r, stages in ((1, ["map", "train", "filter"]), (2, ["raster", "detect"]), (3, ["detect"]), (4, ["train", "raster"])) for s in stages]
    given = [(2, "map", "a-map"), (2, "filter", "a-filter"), (3, "raster", "a-raster"), (4, "map", "b"), (4, "map", "a"), (4, "train", "t")]
    df = spark.createDataFrame([*selected, selected[0], (None, "map", "{}"), (1, None, "{}")], "run long, stage string, parameters string")
    found = stateful.planned_stages(df, spark.createDataFrame([*NEEDS, NEEDS[0]], "stage string, upstream string"), spark.createDataFrame(given, "run long, stage string, artifact string"), "v1").collect()
    artifacts = {}
    for r, s, a in given:
        artifacts[r, s] = min(a, artifacts.get((r, s), a))
    here = {(r, s) for r, s, _ in selected}
    assert len(found) == len(selected)
    for r in found:
        needs = [u for s, u in NEEDS if s == r["stage"]]
        blocked = any((r["run"], u) in here and (r["run"], u) not in artifacts for u in needs)
        inputs = sorted(artifacts[r["run"], u] for u in needs if (r["run"], u) in artifacts)
        assert (r["status"], r["inputs"]) == ("blocked" if blocked else "queued", inputs)
        key = json.dumps({"attempt": 0, "inputs": inputs, "parameters": "{}", "run": str(r["run"]), "stage": r["stage"], "version": "v1"}, separators=(",", ":"))
        assert r["idempotency_key"] == hashlib.sha256(key.encode()).hexdigest()
    assert len({r["idempotency_key"] for r in found}) == len(found)


def test_inserted_features(spark):
    point = '{"type": "Point", "coordinates": [1, 2]}'
    rows = [(1, "m", point, "  Roof ", None, "#AABBCC", [" a ", "a", ""], "u"), (2, "m", '{"type": "Point", "coordinates": [1]}', "x", "d", None, None, "u"), (3, "m", point, "  ", "d", "red", [], "u"), (4, "m", None, "n", " d ", "red", ["b"], None), (5, "m", point, "n", " d ", "red", ["b"], None), (5, "m", point, "n", " d ", "red", ["b"], None)]
    df = spark.createDataFrame(rows, "id long, mission string, geometry string, name string, description string, color string, tags array<string>, actor string")
    created, audit = mutations.inserted_features(df, F.lit("2024-01-01").cast("timestamp"))
    got = {r["id"]: (r["name"], r["description"], r["color"], r["tags"], r["source"]) for r in created.collect()}
    assert got == {1: ("Roof", "", "#aabbcc", ["a"], "manual"), 5: ("n", "d", None, ["b"], "manual")}
    log = {r["id"]: (r["action"], r["problem"], r["before_state"], r["after_state"] is not None) for r in audit.collect()}
    assert log == {1: ("created", None, None, True), 2: ("refused", "structure", None, False), 3: ("refused", "name", None, False), 4: ("refused", "object", None, False), 5: ("created", None, None, True)}
    assert json.loads(next(r["after_state"] for r in audit.collect() if r["id"] == 1))["name"] == "Roof"


def test_gravity(spark):
    rows = [(-90.0, 0.0), (0.0, 0.0), (-45.0, 30.0), (10.0, -170.0), (None, 1.0), (float("nan"), 1.0), (1.0, float("inf"))]
    found = spark.createDataFrame(rows, "p double, r double").select("p", "r", features.gravity(F.col("p"), F.col("r")).alias("g")).collect()
    for row in found:
        if row["p"] is None or not math.isfinite(row["p"]) or not math.isfinite(row["r"]):
            assert row["g"] is None
            continue
        p, r = math.radians(row["p"]), math.radians(row["r"])
        assert tuple(row["g"]) == pytest.approx((math.sin(r) * math.cos(p), math.cos(r) * math.cos(p), -math.sin(p)))
        assert sum(v * v for v in row["g"]) == pytest.approx(1)


def test_mask_polygons(spark):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 0.0]]
    hole = [[1.0, 0.5], [2.0, 0.5], [2.0, 1.0], [1.0, 0.5]]
    cases = [[[ring]], [[ring, hole], [ring]], [], [[]], [[ring[:3]]], [[[*ring[:3], [9.0, 9.0]]]], [[[[0.0], [1.0], [2.0], [0.0]]]], [[[[0.0, None]] * 4]], [[[[0.0, float("inf")]] * 4]], None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i long, m array<array<array<array<double>>>>")
    found = {r["i"]: r["m"] for r in df.select("i", features.mask_polygons(F.col("m"), 10.0, F.col("i") * 1.0).alias("m")).collect()}
    for i, case in enumerate(cases):
        want = [[[[x + 10, y + i] for x, y in r] for r in polygon] for polygon in case] if i < 3 else None
        assert found[i] == want, i
