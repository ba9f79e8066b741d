"""Geometry checks against a walk through the parsed JSON."""

import json
import math
import random

from pyspark.sql import functions as F

from plumbline.functions import shapes


def _walk(geometry):
    try:
        g = json.loads(geometry) if geometry is not None else None
    except ValueError:
        g = None
    if not isinstance(g, dict):
        return "object", None
    pairs, ok = [], True

    def visit(node):
        nonlocal ok
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        if not isinstance(node, list):
            ok = False
        elif len(node) > 1 and number(node[0]) and number(node[1]):
            pairs.append((float(node[0]), float(node[1])))
        else:
            for child in node:
                visit(child)

    visit(g.get("coordinates"))
    if g.get("type") not in shapes.LEAST:
        return "type", pairs
    if not ok:
        return "structure", pairs
    if len(pairs) > shapes.MOST:
        return "many", pairs
    if any(not (abs(x) <= 180 and abs(y) <= 90) for x, y in pairs):
        return "range", pairs
    return ("few" if len(pairs) < shapes.LEAST[g["type"]] else None), pairs


def test_against_a_walk(spark):
    rng = random.Random(4)
    ring = [[0, 0], [1.5, -0.25], [1e1, 2E-1, 7], [0, 0]]
    shapes_ = [[1, 2], [1, 2, 3], [181, 0], [0, -90.5], [-180, 90], [], [1], [[1, 2], 3], [[1, 2], "x"], [[1, 2], None], ["a", "b"], [True, False], ring, [ring], [[ring], [ring, ring]], [[], ring], {"x": 1}, "text", 5, None, [[[[[[[1, 2]]]]]]], [[1, 2]] * 50_000, [[1, 2]] * 50_001]
    rows = [json.dumps({"type": t, "coordinates": c}, indent=rng.choice([None, 1])) for t in [*shapes.LEAST, "Circle", None] for c in shapes_]
    rows += ["[1, 2]", "no json", "", None, '{"coordinates": [1, 2]}', '{"type": "Point"}', '{"type": "Point", "coordinates": [1, 2], "type2": 3}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, g string")
    found = df.select("i", shapes.geometry_problem(F.col("g")).alias("p"), shapes.flat_coordinates(F.get_json_object("g", "$.coordinates")).alias("c")).collect()
    for r in found:
        want, pairs = _walk(rows[r["i"]])
        assert r["p"] == want, (rows[r["i"]][:80], r["p"], want)
        if want is None:
            assert all(math.isclose(p["x"], x) and math.isclose(p["y"], y) for p, (x, y) in zip(r["c"], pairs, strict=True))
