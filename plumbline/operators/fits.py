"""Robust fits of points: similarities, ground areas, capacities, depths. Sums and ranks are Spark's; 3 x 3 algebra the driver's."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .linking import _hull
from .statistics import finite, quantiles

#: Capacities are whole multiples of this many; bytes that one of them takes, and bytes and share of memory that stay free (fixed values).
QUANTUM = 100_000
ITEM_BYTES = 1_280
RESERVE_BYTES = 4 << 30
USABLE_SHARE = 0.85


def _rotation(v: np.ndarray) -> np.ndarray:
    """The rotation by a vector: its length is the angle."""
    angle = float(np.linalg.norm(v))
    if angle < 1e-15:
        return np.eye(3)
    x, y, z = v / angle
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


def cauchy_similarity(pairs: DataFrame, source: list[str], target: list[str], sigma: list[str], loss_scale: float = 3.0, most_rounds: int = 100, tolerance: float = 1e-10) -> dict:
    """The similarity target = scale R source + t that minimises the sum of f^2 log(1 + |r|^2 / f^2), r in units of `sigma`.

    Gauss-Newton with Cauchy weights 1 / (1 + |r|^2 / f^2) for each pair, from an unweighted fit. A round is one aggregate of
    the 36 sums of the weighted normal equations, in coordinates about the means, and a solution of seven unknowns
    at the driver; a step that does not lower the loss is halved. Ends when no parameter moves by more than `tolerance`.
    Result: R, scale, t, n, rmse, max_error, weighted_rmse, max_normalized_error, rounds. An error for
    fewer than three pairs, values that are not finite, and deviations that are not positive.
    """
    if not (math.isfinite(loss_scale) and loss_scale > 0):
        raise ValueError("the scale of the loss is positive")
    names = source + target + sigma
    rows = cut(pairs.select(*[F.col(c).cast("double").alias(c) for c in names]))
    bad = F.exists(F.array(*names), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | F.exists(F.array(*sigma), lambda v: v <= 0)
    n, wrong, *means = rows.agg(F.count(F.lit(1)), F.coalesce(F.count_if(bad), F.lit(0)), *[F.avg(c) for c in source + target]).first()
    if n < 3 or wrong:
        raise ValueError("three pairs at least, finite and with positive deviations, are needed")
    ms, mt = np.array(means[:3]), np.array(means[3:])
    a = [F.col(c) - float(m) for c, m in zip(source, ms, strict=True)]
    b = [F.col(c) - float(m) for c, m in zip(target, mt, strict=True)]
    s = [F.col(c) for c in sigma]
    second = rows.agg(*[F.sum(q * p) for q in b for p in a], *[F.sum(p * p) for p in a]).first()
    cross, spread = np.array(second[:9]).reshape(3, 3), sum(second[9:])
    if spread <= 0:
        raise ValueError("the source points coincide")
    u, d, v = np.linalg.svd(cross)
    flip = np.array([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(v)) or 1])
    turn, scale, shift = u @ np.diag(flip) @ v, float((d * flip).sum() / spread), np.zeros(3)

    def measured(turn: np.ndarray, scale: float, shift: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, normal matrix and gradient at a similarity."""
        moved = [sum((float(scale * turn[i, k]) * a[k] for k in range(3)), F.lit(0.0)) for i in range(3)]
        r = [(moved[i] + float(shift[i]) - b[i]) / s[i] for i in range(3)]
        square = sum((x * x for x in r), F.lit(0.0))
        named = rows.select(*[m.alias(f"m{i}") for i, m in enumerate(moved)], *[x.alias(f"r{i}") for i, x in enumerate(r)], *[c.alias(f"s{i}") for i, c in enumerate(s)], square.alias("q"))
        m, r, s_ = ([F.col(f"{x}{i}") for i in range(3)] for x in "mrs")
        w = 1 / (1 + F.col("q") / loss_scale**2)
        # Derivatives by a turn of the moved points, by the logarithm of the scale, and by the shift.
        zero, one = F.lit(0.0), F.lit(1.0)
        slopes = [[zero, m[2], -m[1], m[0], one, zero, zero], [-m[2], zero, m[0], m[1], zero, one, zero], [m[1], -m[0], zero, m[2], zero, zero, one]]
        entries = [F.sum(w * sum((slopes[i][p] * slopes[i][q] / (s_[i] * s_[i]) for i in range(3)), F.lit(0.0))) for p in range(7) for q in range(p, 7)]
        gradient = [F.sum(w * sum((slopes[i][p] * r[i] / s_[i] for i in range(3)), F.lit(0.0))) for p in range(7)]
        loss, *sums = named.agg(F.sum(loss_scale**2 * F.log1p(F.col("q") / loss_scale**2)), *entries, *gradient).first()
        matrix = np.zeros((7, 7))
        matrix[np.triu_indices(7)] = sums[:28]
        return loss, matrix + np.triu(matrix, 1).T, np.array(sums[28:])

    rounds, at = 0, measured(turn, scale, shift)
    while rounds < most_rounds:
        rounds += 1
        step = -np.linalg.lstsq(at[1], at[2], rcond=None)[0]
        while True:
            new = (_rotation(step[:3]) @ turn, scale * math.exp(step[3]), shift + step[4:])
            after = measured(*new)
            if after[0] <= at[0] or np.abs(step).max() < tolerance:
                break
            step /= 2
        if after[0] <= at[0]:
            (turn, scale, shift), at = new, after
        if np.abs(step).max() < tolerance:
            break
    off = [sum((float(scale * turn[i, k]) * a[k] for k in range(3)), F.lit(0.0)) + float(shift[i]) - b[i] for i in range(3)]
    plain, normal = sum((x * x for x in off), F.lit(0.0)), sum((x * x / (c * c) for x, c in zip(off, s, strict=True)), F.lit(0.0))
    square, most, weighted, most_normal = rows.agg(F.avg(plain), F.max(plain), F.avg(normal) / 3, F.max(normal)).first()
    return {
        "R": turn, "scale": scale, "t": mt + shift - scale * turn @ ms, "n": n, "rmse": square**0.5, "max_error": most**0.5,
        "weighted_rmse": weighted**0.5, "max_normalized_error": most_normal**0.5, "rounds": rounds,
    }


def ground_area(points: DataFrame, axes: list[str], metres: float, quantile: float = 0.005) -> float:
    """The area of the ground that points cover, whatever way up they are.

    Points are centred by their medians; of 200 and more those beyond the 99.5 % quantile of the distance are left out. The two
    longest principal axes span the plane, where each coordinate is trimmed to its quantiles. The area is that of the
    convex hull, which tasks find of their own points first. One unit is so many `metres`. An error without three finite
    points, for a null or infinite one, and for an area of 0.
    """
    if not (metres > 0 and math.isfinite(metres) and 0 <= quantile < 0.5):
        raise ValueError("metres are positive, a quantile is in [0, 0.5)")
    named = points.select(*[F.col(c).cast("double").alias(f"p{i}") for i, c in enumerate(axes)])
    n, good = named.agg(F.count(F.lit(1)), F.count_if(F.forall(F.array("p0", "p1", "p2"), lambda v: finite(v).isNotNull()))).first()
    if n < 3 or good < n:
        raise ValueError("three points at least, all finite, are needed")
    middle = [quantiles(named, [], F.col(f"p{i}"), {"m": ("linear", 0.5)}).first()["m"] for i in range(3)]
    centred = cut(named.select(*[(F.col(f"p{i}") - m).alias(f"p{i}") for i, m in enumerate(middle)]))
    if n >= 200:
        far = F.sqrt(F.col("p0") * F.col("p0") + F.col("p1") * F.col("p1") + F.col("p2") * F.col("p2"))
        limit = quantiles(centred, [], far, {"q": ("linear", 0.995)}).first()["q"]
        centred = centred.where(far <= limit)
    sums = centred.agg(*[F.sum(F.col(f"p{i}") * F.col(f"p{j}")) for i in range(3) for j in range(3)]).first()
    along = np.linalg.eigh(np.array(sums).reshape(3, 3))[1][:, :0:-1]
    plane = cut(centred.select(*[sum((float(along[i, k]) * F.col(f"p{i}") for i in range(3)), F.lit(0.0)).alias("uv"[k]) for k in range(2)]))
    ends = {c: quantiles(plane, [], F.col(c), {"low": ("linear", quantile), "high": ("linear", 1 - quantile)}).first() for c in "uv"}
    kept = plane.where(F.col("u").between(*ends["u"]) & F.col("v").between(*ends["v"]))

    def corners(batches):
        held = np.zeros((0, 2))
        for batch in batches:
            held = _hull(np.concatenate([held, batch[["u", "v"]].to_numpy()]))
        yield pd.DataFrame(held, columns=["u", "v"])

    # Hulls of hulls: their corners are few, and one task has those of 64 others at last.
    hulls = kept.mapInPandas(corners, "u double, v double").repartition(64).mapInPandas(corners, "u double, v double").repartition(1).mapInPandas(corners, "u double, v double")
    ring = np.array([(r["u"], r["v"]) for r in hulls.collect()]).reshape(-1, 2)
    ring = _hull(ring) if len(ring) else ring
    x, y = ring[:, 0], ring[:, 1]
    area = abs(float(x @ np.roll(y, 1) - y @ np.roll(x, 1))) / 2 if len(ring) > 2 else 0.0
    if area <= 0:
        area = max(0.0, ends["u"]["high"] - ends["u"]["low"]) * max(0.0, ends["v"]["high"] - ends["v"]["low"])
    if not (math.isfinite(area) and area > 0):
        raise ValueError("the points cover no area")
    return area * metres**2


def _up(x: float) -> int:
    return math.ceil(x / QUANTUM) * QUANTUM


def _down(x: float) -> int:
    return max(QUANTUM, int(x // QUANTUM) * QUANTUM)


@dataclass(frozen=True)
class Capacity:
    """How many items a scene of some ground is given, in all and in each of its cells."""

    pixels: int
    target: int
    memory_cap: int | None
    scene: int
    cell: int
    cells_needed: int
    enough_cells: bool


def memory_cap(total: int, free: int | None = None) -> int:
    """Items that fit a memory of so many bytes."""
    usable = min(total * USABLE_SHARE - RESERVE_BYTES, math.inf if free is None else free - RESERVE_BYTES)
    if usable < QUANTUM * ITEM_BYTES:
        raise ValueError("the memory does not hold the least capacity")
    return _down(usable / ITEM_BYTES)


def capacity(area: float, pixel: float, spacing: float, most: int, least: int, total: int | None = None, free: int | None = None, cells: int = 1, overlap: float = 0.2, resident: bool = False, kept: float = 1.0) -> Capacity:
    """Items for an area with pixels of a size, `spacing` pixels apart, between `least` and `most`.

    `resident` cells hold their own items and those of a seam of `overlap` around them; `kept` is the share that a later filter leaves.
    """
    if most < QUANTUM or not QUANTUM <= least <= most or cells < 1 or not 0 <= overlap < 1 or not pixel > 0 or not spacing > 0 or not 0 < kept <= 1:
        raise ValueError("a capacity needs sound limits")
    pixels = max(1, math.ceil(area / pixel**2))
    target = _up(pixels / spacing**2 / kept)
    cap, scene = (None if total is None else memory_cap(total, free)), max(least, target)
    if not resident:
        scene = _down(min(x for x in (most, scene, cap) if x is not None))
        return Capacity(pixels, target, cap, scene, _up(scene / cells), 1, True)
    held = _down(min(most, cap if cap is not None else most))
    seam = (1 + 2 * overlap) ** 2
    needed = 1 if scene <= held else math.ceil(scene * seam / held)
    return Capacity(pixels, target, cap, scene, min(held, _up(scene if cells == 1 else scene * seam / cells)), needed, cells >= needed)


def depth_comparison(df: DataFrame, keys: list[str], depth: Column, reference: Column, least: int = 100) -> DataFrame:
    """How well depths fit a reference up to a sign and an offset: keys, n, sign, offset, median_error, median_absolute, p90, p95, rmse, correlation.

    Both signs are judged at once: the offset is the median of reference - sign depth, and the sign with the smaller median of
    absolute residuals wins, + if they tie. Rows with a null or infinite value do not count; keys with fewer than
    `least` rows have none.
    """
    rows = df.select(*keys, finite(depth.cast("double")).alias("__d"), finite(reference.cast("double")).alias("__r")).where("__d IS NOT NULL AND __r IS NOT NULL")
    both = cut(rows.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("__o", F.col("__r") - F.col("sign") * F.col("__d")))
    group = [*keys, "sign"]

    def met(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
        renamed = right.withColumnsRenamed({k: f"__k_{k}" for k in group})
        on = F.lit(True)
        for k in group:
            on &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        return left.join(renamed, on).select(*left.columns, *names)

    off = met(both, quantiles(both, group, F.col("__o"), {"offset": ("linear", 0.5)}), ["offset"])
    # sign depth + offset - reference
    off = cut(off.withColumn("__e", F.col("offset") - F.col("__o")))
    sizes = quantiles(off, group, F.abs(F.col("__e")), {"median_absolute": ("linear", 0.5), "p90": ("linear", 0.9), "p95": ("linear", 0.95)})
    errors = quantiles(off, group, F.col("__e"), {"median_error": ("linear", 0.5)})
    sums = off.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.first("offset").alias("offset"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"), F.corr(F.col("sign") * F.col("__d"), "__r").alias("correlation"))
    every = met(met(sums.where(F.col("n") >= least), sizes, ["median_absolute", "p90", "p95"]), errors, ["median_error"])
    columns = ["n", "sign", "offset", "median_error", "median_absolute", "p90", "p95", "rmse", "correlation"]
    best = every.groupBy(*keys).agg(F.min(F.struct("median_absolute", (-F.col("sign")).alias("o"), F.struct(*columns).alias("row"))).alias("b"))
    return best.select(*keys, *[F.col(f"b.row.{c}").alias(c) for c in columns])
