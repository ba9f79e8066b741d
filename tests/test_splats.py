"""Harmonics by formula, merged splats and generations against a sequential scan."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import harmonics
from plumbline.operators import generations, graph

SCHEMA = "tile long, id long, x double, y double, z double, scale array<double>, rotation array<double>, opacity double, opacity_sh array<double>, colour array<double>, error double"


def _splats(n, sh=3, tiles=1, seed=1):
    rng = random.Random(seed)
    g = lambda k, s=1.0: [rng.gauss(0, s) for _ in range(k)]
    return [(i % tiles, i * 3 + 1, *(v + 5e6 for v in g(3, 20)), g(3, 0.5), g(4), rng.gauss(0, 2), g(sh, 0.3), g(5), abs(rng.gauss(0, 0.1))) for i in range(n)]


def test_harmonics_are_orthonormal():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200_000, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    y = np.stack(harmonics.basis(3, *v.T))
    assert np.allclose(4 * math.pi * y @ y.T / len(v), np.eye(16), atol=0.05)
    x, y, z = 0.48, 0.6, 0.64
    b = harmonics.basis(3, x, y, z)
    want = {0: 0.28209479, 1: -0.48860251 * y, 2: 0.48860251 * z, 3: -0.48860251 * x, 4: 1.09254843 * x * y, 5: -1.09254843 * y * z, 6: 0.31539157 * (2 * z * z - x * x - y * y), 7: -1.09254843 * x * z, 8: 0.54627422 * (x * x - y * y)}
    assert all(b[i] == pytest.approx(w, abs=1e-7) for i, w in want.items())


def test_upper_bound_holds(spark):
    rng = np.random.default_rng(2)
    coefficients = rng.normal(size=(40, 15))
    rows = [(i, float(i % 5), [float(c) for c in row]) for i, row in enumerate(coefficients)]
    df = spark.createDataFrame(rows, "i long, o double, c array<double>").select("i", harmonics.greatest_logit(F.col("o"), F.col("c"), 15).alias("g"))
    bound = {r["i"]: r["g"] for r in df.collect()}
    v = rng.normal(size=(3000, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    values = np.stack(harmonics.basis(3, *v.T))[1:]
    for i, o, c in rows:
        parts = [math.sqrt(sum(x * x for x in c[d * d - 1 : (d + 1) ** 2 - 1])) * math.sqrt((2 * d + 1) / (4 * math.pi)) for d in (1, 2, 3)]
        assert bound[i] == pytest.approx(o + sum(parts))
        assert (o + np.array(c) @ values).max() <= bound[i]
    with pytest.raises(ValueError):
        harmonics.degree_of(4)


def _matrix(q):
    w, x, y, z = np.array(q) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def _area(s):
    p = 1.6075
    return 4 * math.pi * (((s[0] * s[1]) ** p + (s[0] * s[2]) ** p + (s[1] * s[2]) ** p) / 3) ** (1 / p)


def _merge(rows):
    """One splat for some, by sums over them in turn."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    d = harmonics.design(len(rows[0][8]))
    mass = [sigmoid(r[7]) * _area(np.exp(r[5])) for r in rows]
    total = sum(mass)
    centre = sum(m * np.array(r[2:5]) for m, r in zip(mass, rows, strict=True)) / total
    covariance = 1e-8 * np.eye(3)
    for m, r in zip(mass, rows, strict=True):
        o, turn = np.array(r[2:5]) - centre, _matrix(r[6])
        covariance += m / total * (turn @ np.diag(np.exp(r[5]) ** 2) @ turn.T + np.outer(o, o))
    seen = sum(sigmoid(d @ np.array([r[7], *r[8]])) * _area(np.exp(r[5])) for r in rows)
    scales = np.sqrt(np.linalg.eigvalsh(covariance)[::-1])
    alpha = np.clip(seen / _area(scales), 1e-7, 1 - 1e-7)
    fitted = np.linalg.lstsq(d, np.log(alpha / (1 - alpha)), rcond=None)[0]
    colour = sum(m * np.array(r[9]) for m, r in zip(mass, rows, strict=True)) / total
    error = max(np.linalg.norm(np.array(r[2:5]) - centre) + r[10] for r in rows)
    return min(r[1] for r in rows), centre, covariance, fitted, colour, error


def _same(got, want):
    number, centre, covariance, fitted, colour, error = want
    assert got["id"] == number
    assert np.allclose([got["x"], got["y"], got["z"]], centre, rtol=0, atol=1e-6)
    turn, scales = _matrix(got["rotation"]), np.exp(got["scale"])
    assert np.allclose(turn @ np.diag(scales**2) @ turn.T, covariance, atol=1e-6) and np.linalg.det(turn) > 0
    assert scales[0] >= scales[1] >= scales[2] and got["rotation"][0] >= 0
    assert np.allclose([got["opacity"], *got["opacity_sh"]], fitted, atol=1e-6)
    assert np.allclose(got["colour"], colour) and got["error"] == pytest.approx(error, abs=1e-6)


@pytest.mark.parametrize("sh", [0, 3, 8, 15])
def test_merged_groups(spark, sh):
    rows = _splats(60, sh)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("g", F.col("id") % 7)
    found = {r["g"]: r for r in generations.merged(df, ["g"]).collect()}
    assert len(found) == 7
    for g, r in found.items():
        _same(r, _merge([x for x in rows if x[1] % 7 == g]))


def _zorder(rows):
    low, high = (np.array([f(r[2 + i] for r in rows) for i in range(3)]) for f in (min, max))
    out = []
    for r in rows:
        q = [int(np.rint((r[2 + i] - low[i]) / (high[i] - low[i]) * (2**21 - 1))) for i in range(3)]
        out.append((sum(((q[i] >> b) & 1) << (3 * b + i) for b in range(21) for i in range(3)), r[1], r))
    return [r for *_, r in sorted(out, key=lambda x: x[:2])]


def _halved(rows, limit):
    """One generation of a tile by a sequential scan: the groups of rows to merge."""
    if len(rows) <= limit:
        return [[r] for r in rows]
    rows = _zorder(rows)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, min(i + 9, len(rows)))]
    parts = []
    for i, j in pairs:
        a, b = rows[i], rows[j]
        bulk = sum(math.exp(2 * v) for v in a[5] + b[5])
        mean = lambda u, v: sum((p - q) ** 2 for p, q in zip(u, v, strict=True)) / max(1, len(u))
        parts.append((3 * mean(a[2:5], b[2:5]) / bulk, mean(a[5], b[5]), 3 * mean(a[9][:3], b[9][:3]), (sigmoid(a[7]) - sigmoid(b[7])) ** 2, mean(a[8], b[8])))
    usual = [np.median([v for v in column if v > 0] or [1.0]) for column in zip(*parts, strict=True)]
    costs = sorted((sum(w * math.log1p(v / m) for w, v, m in zip((1, 0.35, 2, 0.5, 0.5), p, usual, strict=True)), i, j) for p, (i, j) in zip(parts, pairs, strict=True))
    wanted = len(rows) - max(limit, (len(rows) + 1) // 2)
    used, found = set(), []
    for _, i, j in costs:
        if len(found) < wanted and not {i, j} & used:
            used |= {i, j}
            found.append((i, j))
    free = [i for i in range(len(rows)) if i not in used]
    while len(found) < wanted:
        found.append((free.pop(0), free.pop(0)))
    paired = {i for p in found for i in p}
    return [[rows[i], rows[j]] for i, j in found] + [[r] for i, r in enumerate(rows) if i not in paired]


def test_generation_against_a_sequential_scan(spark):
    rows = _splats(420, 3, tiles=3) + [(9, 5000 + i, *r[2:]) for i, r in enumerate(_splats(9))] + [(8, 6000 + i, 1.0, 1.0, 1.0, *_splats(1)[0][5:]) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["id"]: r for r in generations.next_generation(df, 10).collect()}
    want = {}
    for tile in {r[0] for r in rows if r[0] != 8}:
        for group in _halved([r for r in rows if r[0] == tile], 10):
            want[min(r[1] for r in group)] = group
    assert {i for i, r in found.items() if r["tile"] != 8} == set(want)
    for i, group in want.items():
        if len(group) > 1:
            _same(found[i], _merge(group))
        else:
            assert tuple(found[i]) == tuple(group[0])
    # Splats in one place: half are left, the limit at least.
    assert sum(r["tile"] == 8 for r in found.values()) == 10


def test_coarser_until_the_limit(spark):
    df = spark.createDataFrame(_splats(200, 0, tiles=2), SCHEMA)
    found = generations.coarser(df, 13)
    assert {r["tile"]: r["count"] for r in found.groupBy("tile").count().collect()} == {0: 13, 1: 13}
    assert generations.coarser(df.limit(0), 5).count() == 0
    assert generations.coarser(df, 100).count() == 200
    with pytest.raises(ValueError):
        generations.coarser(df, 0)


def test_coarser_in_tasks_is_coarser_by_generations(spark, monkeypatch):
    # Equal costs in a row, and splats in one place.
    line = [(7, 9000 + i, float(i), 0.0, 0.0, *_splats(1)[0][5:]) for i in range(40)]
    rows = _splats(120, 3, tiles=2) + line + [(8, 6000 + i, 1.0, 1.0, 1.0, *_splats(1)[0][5:]) for i in range(45)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["id"]: r for r in generations.coarser(df, 30).collect()}
    monkeypatch.setattr(generations, "TASK_SPLATS", 0)
    rounds = generations.coarser(df, 30)
    want = {r["id"]: r for r in rounds.collect()}
    assert set(found) == set(want) and len(want) == 120
    for i, r in want.items():
        for c in df.columns:
            assert np.allclose(found[i][c], r[c], atol=1e-7)


def test_a_matching_by_blocks_is_the_scan(spark, monkeypatch):
    monkeypatch.setattr(graph, "SCANNED_EDGES", 5)
    for costs in (range(50), range(1)):  # equal costs make one chain through all blocks
        edges = [(i, i + k, float(i * 37 % 1009 * k % len(costs))) for i in range(70) for k in (1, 2, 3)]
        free, want = set(range(80)), set()
        for _, a, b in sorted((c, a, b) for a, b, c in edges):
            if {a, b} <= free:
                free -= {a, b}
                want.add((a, b))
        df = spark.createDataFrame(edges, "a long, b long, cost double")
        for span in (None, 10):
            got = graph.greedy_matching(df, "a", "b", "cost", span).collect()
            assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
