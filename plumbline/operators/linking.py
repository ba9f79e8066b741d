"""Joins of relations and of sources that describe the same things."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.geometry import haversine


def latest_done(artifacts: DataFrame, runs: DataFrame, run: str, keys: list[str], done: Column, order: list[Column]) -> DataFrame:
    """Of each key the latest artifact whose run is done."""
    joined = artifacts.join(runs.where(done).select(F.col(run).alias("__run")), F.col(run) == F.col("__run")).drop("__run")
    return joined.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def common_names(left: DataFrame, right: DataFrame, name: str, least: int = 3) -> DataFrame:
    """Rows of both sides by a name that both have; no rows where fewer than `least` names are common."""
    both = left.join(right, name).where(F.col(name).isNotNull())
    enough = both.select(name).distinct().limit(least).agg((F.count(F.lit(1)) >= least).alias("__enough"))
    return both.join(F.broadcast(enough.where("__enough"))).drop("__enough")


def sampled_pairs(df: DataFrame, row_id: str, n: int, pairs: int, seed: int) -> DataFrame:
    """Seeded random pairs (a, b) of different rows: `pairs` draws with replacement of ranks among n, by a hash.

    `df` has the rows' ranks (from 0) in `rank`. Draws of a row with itself fall away.
    """
    spark = df.sparkSession

    def place(side: str) -> Column:
        return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{side}:"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long"), F.lit(n))

    drawn = spark.range(pairs).select(F.col("id").alias("draw"), place("a").alias("pa"), place("b").alias("pb")).where("pa <> pb")
    a = df.select(F.col("rank").alias("pa"), F.col(row_id).alias("a"))
    b = df.select(F.col("rank").alias("pb"), F.col(row_id).alias("b"))
    return drawn.join(a, "pa").join(b, "pb").select("draw", "a", "b")


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points in the plane, in order."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def farthest_pair(df: DataFrame, x: str, y: str, parts: int = 64) -> DataFrame:
    """One row: the greatest distance of two points, `diameter`, null without a point. The farthest two are corners of the convex hull.

    Each task leaves the hull of its points, then `parts` tasks that of theirs, and one task that of all; a hull
    has few corners however many points there are, and its farthest corners are found in one turn around it.
    """
    xy = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def corners(batches):
        held = np.zeros((0, 2))
        for batch in batches:
            held = _hull(np.concatenate([held, batch[["x", "y"]].to_numpy()]))
        yield pd.DataFrame(held, columns=["x", "y"])

    def widest(batches):
        held = np.zeros((0, 2))
        for batch in batches:
            held = _hull(np.concatenate([held, batch[["x", "y"]].to_numpy()]))
        if len(held):
            n, best, j = len(held), 0.0, 1
            for i in range(n):
                while n > 1 and np.hypot(*(held[i] - held[(j + 1) % n])) > np.hypot(*(held[i] - held[j % n])):
                    j += 1
                best = max(best, float(np.hypot(*(held[i] - held[j % n]))), *(float(np.hypot(*(held[i] - held[(j + k) % n]))) for k in (-1, 1)))
            yield pd.DataFrame({"diameter": [best]})

    hulls = xy.mapInPandas(corners, "x double, y double").repartition(parts).mapInPandas(corners, "x double, y double")
    return hulls.repartition(1).mapInPandas(widest, "diameter double").agg(F.max("diameter").alias("diameter"))


def filled_by_distance(first: DataFrame, others: DataFrame, key: str, item: str, order: list[Column], distance: str, limit: int) -> DataFrame:
    """For each key its first candidates in order, then the nearest others, up to a limit; no candidate twice."""
    own = first.withColumn("tier", F.lit(0)).withColumn("__o", F.row_number().over(Window.partitionBy(key).orderBy(*order))).select(key, item, "tier", "__o")
    rest = others.join(first.select(key, item), [key, item], "left_anti").withColumn("tier", F.lit(1))
    rest = rest.withColumn("__o", F.row_number().over(Window.partitionBy(key).orderBy(distance, item))).select(key, item, "tier", "__o")
    place = F.row_number().over(Window.partitionBy(key).orderBy("tier", "__o"))
    return own.unionByName(rest).withColumn("place", place).where(F.col("place") <= limit).drop("__o")


def tile_intervals(df: DataFrame, row_id: str, low_x: Column, high_x: Column, low_y: Column, high_y: Column, across: int, down: int, depth: str) -> DataFrame:
    """A row for each tile that an interval box covers, with the tile's rows in depth order: tile, row id, place.

    Tiles beyond the grid are left out; a box that covers none has no row.
    """
    clamp = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most), c)).cast("long")
    inside = (F.floor(high_x) >= 0) & (F.floor(low_x) < across) & (F.floor(high_y) >= 0) & (F.floor(low_y) < down)
    spread = df.where(inside).select(row_id, depth, F.explode(F.sequence(clamp(F.floor(low_x), across - 1), clamp(F.floor(high_x), across - 1))).alias("tx"), low_y.alias("__l"), high_y.alias("__h"))
    spread = spread.select(row_id, depth, "tx", F.explode(F.sequence(clamp(F.floor("__l"), down - 1), clamp(F.floor("__h"), down - 1))).alias("ty"))
    placed = spread.withColumn("tile", F.col("ty") * across + F.col("tx"))
    return placed.select("tile", row_id, F.row_number().over(Window.partitionBy("tile").orderBy(depth, row_id)).alias("place"))


def shared_edges(cells: DataFrame, row_id: str, box: tuple[str, str, str, str], tolerance: float) -> DataFrame:
    """Pairs (a, b, axis) of cells of which b begins where a ends, along x or else along y, with some common side.

    Edges meet by their place in units of the tolerance: an equi-join on two neighbouring units.
    """
    west, south, east, north = box

    def along(end: str, start: str, low: str, high: str, axis: str) -> DataFrame:
        unit = lambda c: F.floor(F.col(c) / tolerance)
        a = cells.select(F.col(row_id).alias("a"), F.col(end).alias("e"), F.col(low).alias("al"), F.col(high).alias("ah"), F.explode(F.array(unit(end) - 1, unit(end), unit(end) + 1)).alias("u"))
        b = cells.select(F.col(row_id).alias("b"), F.col(start).alias("s"), F.col(low).alias("bl"), F.col(high).alias("bh"), unit(start).alias("u"))
        met = a.join(b, "u").where((F.col("a") != F.col("b")) & (F.abs(F.col("e") - F.col("s")) <= tolerance))
        return met.where(F.least("ah", "bh") - F.greatest("al", "bl") > tolerance).select("a", "b", F.lit(axis).alias("axis"))

    found = along(east, west, south, north, "x").unionByName(along(north, south, west, east, "y"))
    return found.groupBy("a", "b").agg(F.min("axis").alias("axis"))


def common_bounds(df: DataFrame, low: list[str], high: list[str]) -> DataFrame:
    """One row: the intersection of all rows' bounds, and whether it is empty."""
    row = df.agg(*[F.max(c).alias(c) for c in low], *[F.min(c).alias(c) for c in high])
    empty = F.lit(False)
    for a, b in zip(low, high, strict=True):
        empty = empty | (F.col(a) >= F.col(b))
    return row.withColumn("empty", empty)


def validated_positions(a: DataFrame, b: DataFrame, key: str, sigmas: float = 6.0) -> DataFrame:
    """Positions (lat, lon, alt, sigma) of one thing from two sources: distance apart, and whether both agree.

    They may lie 0.25 m apart, or six sigma, and half a metre in height, or six sigma.
    """
    left = a.select(key, *[F.col(c).alias(f"a_{c}") for c in ("lat", "lon", "alt", "sigma")])
    both = left.join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in ("lat", "lon", "alt")]), key)
    apart = haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    higher = F.abs(F.col("a_alt") - F.col("b_alt"))
    room = lambda least: F.greatest(F.lit(least), F.lit(sigmas) * F.coalesce("a_sigma", F.lit(0.0)))
    return both.select(key, apart.alias("horizontal_m"), higher.alias("vertical_m"), ((apart <= room(0.25)) & (higher <= room(0.5))).alias("agrees"))


def case_matrix(cases: DataFrame, backends: list[str], repetitions: int) -> DataFrame:
    """A row for each case, backend and repetition (from 1)."""
    return cases.withColumn("backend", F.explode(F.array(*[F.lit(b) for b in backends]))).withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))


def filled_owner(df: DataFrame, key: str, owners: DataFrame, owner: str, own: str, default: str) -> DataFrame:
    """Each row's owner: that of its key's row, else its own one unless empty, else the default."""
    known = owners.groupBy(F.col(key).alias("__k")).agg(F.min(owner).alias("__o"))
    joined = df.join(known, F.col(key) == F.col("__k"), "left")
    return joined.withColumn(own, F.coalesce("__o", F.nullif(F.col(own), F.lit("")), F.lit(default))).drop("__k", "__o")


def revision_diff(client: DataFrame, server: DataFrame, key: str, version: str) -> DataFrame:
    """What a client must do: `fetch` what is new or changed, `drop` what is gone; the rest is `same`."""
    a = client.select(F.col(key).alias("a"), F.col(version).alias("va"))
    b = server.select(F.col(key).alias("b"), F.col(version).alias("vb"))
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    action = F.when(F.col("b").isNull(), "drop").when(F.col("a").isNull() | ~F.col("va").eqNullSafe(F.col("vb")), "fetch").otherwise("same")
    return both.select(F.coalesce("a", "b").alias(key), action.alias("action"))
