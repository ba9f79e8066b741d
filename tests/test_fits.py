"""Robust fits against direct computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import fits


def _pairs(n, wrong, seed=1):
    rng = np.random.default_rng(seed)
    turn = fits._rotation(np.array([0.3, -0.7, 1.1]))
    source = rng.normal(size=(n, 3)) * [40, 30, 5] + [10, -20, 3]
    sigma = rng.uniform(0.01, 0.05, (n, 3))
    target = 2.5 * source @ turn.T + [600_000, 5_300_000, 120] + rng.normal(size=(n, 3)) * sigma
    target[:wrong] += rng.normal(size=(wrong, 3)) * 30
    return turn, source, target, sigma


def _frame(spark, source, target, sigma):
    rows = [tuple(float(v) for v in (*a, *b, *s)) for a, b, s in zip(source, target, sigma, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, x double, y double, z double, s double, t double, u double")


NAMES = (["a", "b", "c"], ["x", "y", "z"], ["s", "t", "u"])


def test_similarity_with_outliers(spark):
    turn, source, target, sigma = _pairs(100, 30)
    found = fits.cauchy_similarity(_frame(spark, source, target, sigma), *NAMES)
    assert np.allclose(found["R"], turn, atol=2e-4) and found["scale"] == pytest.approx(2.5, abs=2e-4)
    moved = found["scale"] * source @ found["R"].T + found["t"]
    assert np.abs(moved - target)[30:].max() < 0.3
    off = moved - target
    assert found["rmse"] == pytest.approx(np.sqrt((off**2).sum(axis=1).mean()), rel=1e-6)
    assert found["max_error"] == pytest.approx(np.linalg.norm(off, axis=1).max(), rel=1e-6)
    assert found["weighted_rmse"] == pytest.approx(np.sqrt(((off / sigma) ** 2).mean()), rel=1e-6)
    # The loss is least there: no small move lowers it.
    loss = lambda r, s, t: (9 * np.log1p((((s * source @ r.T + t - target) / sigma) ** 2).sum(axis=1) / 9)).sum()
    least = loss(found["R"], found["scale"], found["t"])
    for k in range(7):
        for size in (1e-5, -1e-5):
            v = np.zeros(7)
            v[k] = size
            centre = source.mean(axis=0)
            turned = fits._rotation(v[:3]) @ found["R"]
            scale = found["scale"] * math.exp(v[3])
            shift = found["t"] + found["scale"] * found["R"] @ centre - scale * turned @ centre + v[4:] * 100
            assert loss(turned, scale, shift) >= least - 1e-6


def test_similarity_errors(spark):
    _, source, target, sigma = _pairs(5, 0)
    with pytest.raises(ValueError):
        fits.cauchy_similarity(_frame(spark, source[:2], target[:2], sigma[:2]), *NAMES)
    for bad in (0.0, -1.0, float("nan"), float("inf")):
        sigma[0, 0] = bad
        with pytest.raises(ValueError):
            fits.cauchy_similarity(_frame(spark, source, target, sigma), *NAMES)
    with pytest.raises(ValueError):
        fits.cauchy_similarity(_frame(spark, source, target, np.abs(sigma)), *NAMES, loss_scale=0.0)


def _area(points, metres, quantile):
    p = points - np.median(points, axis=0)
    if len(p) >= 200:
        far = np.linalg.norm(p, axis=1)
        p = p[far <= np.quantile(far, 0.995)]
    plane = p @ np.linalg.svd(p, full_matrices=False)[2][:2].T
    low, high = np.quantile(plane, quantile, axis=0), np.quantile(plane, 1 - quantile, axis=0)
    kept = plane[((plane >= low) & (plane <= high)).all(axis=1)]
    ring = fits._hull(kept)
    x, y = ring[:, 0], ring[:, 1]
    return abs(x @ np.roll(y, 1) - y @ np.roll(x, 1)) / 2 * metres**2


@pytest.mark.parametrize("n", [50, 3000])
def test_ground_area(spark, n):
    rng = np.random.default_rng(n)
    flat = np.column_stack([rng.uniform(0, 200, n), rng.uniform(0, 90, n), rng.normal(size=n) * 0.5])
    flat[:2] += 5000
    points = flat @ fits._rotation(np.array([0.5, 0.2, -1.0])).T + [5e5, 5e6, 100]
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double, z double").repartition(3)
    assert fits.ground_area(df, ["x", "y", "z"], 0.5) == pytest.approx(_area(points, 0.5, 0.005), rel=1e-6)
    if n == 3000:
        assert fits.ground_area(df, ["x", "y", "z"], 1.0) == pytest.approx(200 * 90, rel=0.1)


def test_ground_area_errors(spark):
    make = lambda rows: spark.createDataFrame(rows, "x double, y double, z double")
    for rows in ([(1.0, 2.0, 3.0)] * 2, [(1.0, 2.0, 3.0)] * 9, [(1.0, 2.0, None)] * 4, [(1.0, 2.0, float("nan"))] * 4):
        with pytest.raises(ValueError):
            fits.ground_area(make(rows), ["x", "y", "z"], 1.0)
    with pytest.raises(ValueError):
        fits.ground_area(make([(1.0, 2.0, 3.0)] * 3), ["x", "y", "z"], 0.0)


def test_capacity():
    gib = 1 << 30
    plan = fits.capacity(18_000.0, 0.05, 2.0, 8_000_000, 200_000, total=24 * gib)
    assert (plan.pixels, plan.target, plan.scene, plan.cell, plan.enough_cells) == (7_200_000, 1_800_000, 1_800_000, 1_800_000, True)
    assert plan.memory_cap == int((24 * gib * 0.85 - 4 * gib) / 1280) // 100_000 * 100_000
    small = fits.capacity(18_000.0, 0.01, 1.0, 8_000_000, 200_000, total=8 * gib, cells=2, resident=True, kept=0.98)
    held = min(8_000_000, fits.memory_cap(8 * gib))
    assert small.scene == small.target == math.ceil(180_000_000 / 0.98 / 100_000) * 100_000
    assert small.cells_needed == math.ceil(small.scene * 1.4**2 / held) and not small.enough_cells and small.cell == held
    assert fits.capacity(1.0, 1.0, 1.0, 100_000, 100_000, resident=True).cells_needed == 1
    assert fits.memory_cap(24 * gib, 6 * gib) == int(2 * gib / 1280) // 100_000 * 100_000
    for wrong in ({"most": 10}, {"least": 10}, {"cells": 0}, {"overlap": 1.0}, {"pixel": 0.0}, {"total": gib}):
        with pytest.raises(ValueError):
            fits.capacity(**{"area": 1.0, "pixel": 1.0, "spacing": 1.0, "most": 200_000, "least": 100_000} | wrong)


def test_depth_comparison(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key, sign in (("a", 1), ("b", -1), (None, 1)):
        r = rng.normal(size=400) * 3
        d = sign * (r + 7 + rng.normal(size=400) * 0.1)
        rows += [(key, float(x), float(y)) for x, y in zip(d, r, strict=True)]
    rows += [("a", None, 1.0), ("a", float("nan"), 1.0), ("few", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, d double, r double").repartition(3)
    found = {r["k"]: r for r in fits.depth_comparison(df, ["k"], F.col("d"), F.col("r")).collect()}
    assert set(found) == {"a", "b", None}
    for key, got in found.items():
        d, r = (np.array([x[i] for x in rows if x[0] == key and x[1] is not None and math.isfinite(x[1])]) for i in (1, 2))
        best = min(((np.median(np.abs(s * d + np.median(r - s * d) - r)), -s, s) for s in (1, -1)))
        s = best[2]
        e = s * d + np.median(r - s * d) - r
        want = [len(d), s, np.median(r - s * d), np.median(e), best[0], np.quantile(np.abs(e), 0.9), np.quantile(np.abs(e), 0.95), np.sqrt((e**2).mean()), np.corrcoef(s * d, r)[0, 1]]
        assert [got[c] for c in ("n", "sign", "offset", "median_error", "median_absolute", "p90", "p95", "rmse", "correlation")] == pytest.approx(want, abs=1e-9)
    assert fits.depth_comparison(df.limit(0), ["k"], F.col("d"), F.col("r")).count() == 0
