"""Usage, telemetry, quality and scene aggregates: all of them sums that combine on the map side."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import global_rank
from .statistics import finite


def organization_usage(df: DataFrame, owner: str, active: Column, units: Column, eligible: Column) -> DataFrame:
    """For each owner the active rows, their units (1 where a row names none) and the rows retention may take."""
    return df.groupBy(owner).agg(
        F.count_if(active).alias("n_active"), F.coalesce(F.sum(F.when(active, F.coalesce(units, F.lit(1)))), F.lit(0)).alias("units"), F.count_if(eligible).alias("n_eligible")
    )


def effective_limits(policies: DataFrame, owner: str, limit: str, owners: list, platform: int) -> DataFrame:
    """Limits of the owners that have one, none above the platform's."""
    return policies.where(F.col(owner).isin(owners) & F.col(limit).isNotNull()).select(owner, F.least(F.col(limit), F.lit(platform)).alias(limit))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """How often each value occurs, as text and in order; nulls are dropped."""
    return df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy("value")


def role_metrics(df: DataFrame, role: str, errors: list[str]) -> DataFrame:
    """For each role its rows, and RMSE and greatest absolute value of each error column."""
    return df.groupBy(role).agg(
        F.count(F.lit(1)).alias("n"), *[F.sqrt(F.avg(F.col(e) * F.col(e))).alias(f"rmse_{e}") for e in errors], *[F.max(F.abs(F.col(e))).alias(f"max_{e}") for e in errors]
    )


def plane_fit(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """One row: the least-squares plane z = level + slope_x (x - mean x) + slope_y (y - mean y), from sums.

    Slopes are null where the points lie on a line.
    """
    m = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{k}") for k, c in zip("xyz", (x, y, z), strict=True)],
        F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    det = F.when(F.abs(det) > 1e-12 * F.col("xx") * F.col("yy"), det)
    return m.select(
        "n", F.col("mx").alias("mean_x"), F.col("my").alias("mean_y"), F.col("mz").alias("level"),
        ((F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det).alias("slope_x"), ((F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det).alias("slope_y"),
    )


def clamped_cells(df: DataFrame, x: str, y: str, grid: int) -> DataFrame:
    """Distinct grid cells of normalised points; what lies beyond the last one counts to it."""
    cell = lambda c: F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor(F.col(c) * grid))).cast("int")
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(cell(x).alias("cell_x"), cell(y).alias("cell_y")).distinct()


def worst(df: DataFrame, order: list[Column], k: int = 10) -> DataFrame:
    """The k worst rows: a partial top k in each task."""
    return df.orderBy(*order).limit(k)


def support_bounds(df: DataFrame, axes: list[str], extents: list[str], sigma: float = 3.0) -> DataFrame:
    """One row: least and greatest of position -/+ sigma times the extent along each axis."""
    return df.agg(
        *[F.min(F.col(a) - sigma * F.col(e)).alias(f"low_{a}") for a, e in zip(axes, extents, strict=True)],
        *[F.max(F.col(a) + sigma * F.col(e)).alias(f"high_{a}") for a, e in zip(axes, extents, strict=True)],
    )


def weighted_moments(df: DataFrame, keys: list[str], x: Column, weight: Column) -> DataFrame:
    """Mass, weighted mean and weighted population variance; rows without a positive weight do not count."""
    w = F.when(weight > 0, weight)
    return df.groupBy(*keys).agg(F.sum(w).alias("mass"), (F.sum(w * x) / F.sum(w)).alias("mean"), (F.sum(w * x * x) / F.sum(w) - F.pow(F.sum(w * x) / F.sum(w), 2)).alias("variance"))


def prefix_sums(df: DataFrame, order: list[Column], value: str) -> DataFrame:
    """Add the exclusive and inclusive running sums of a value in a total order, without one task for all rows.

    Rows are ranked in range partitions; sums of runs of 100,000 ranks give the offsets of the running sums inside them.
    """
    ranked = global_rank(df, order, "__r").withColumn("__b", F.floor((F.col("__r") - 1) / 100_000))
    runs = ranked.groupBy("__b").agg(F.sum(value).alias("__s"))
    # One row for each 100,000: this window over all of them is that much smaller than the table.
    before = runs.select(F.col("__b").alias("__k"), (F.sum("__s").over(Window.orderBy("__b")) - F.col("__s")).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy("__b").orderBy("__r").rowsBetween(Window.unboundedPreceding, 0))
    joined = ranked.withColumn("__in", inside).join(before, F.col("__b") == F.col("__k"))
    inclusive = F.col("__before") + F.coalesce("__in", F.lit(0))
    return joined.select(*df.columns, (inclusive - F.coalesce(value, F.lit(0))).alias("exclusive"), inclusive.alias("inclusive"))


def ray_intersection(rays: DataFrame, origin: list[str], direction: list[str], sigma: Column | None = None) -> dict:
    """The point nearest to all rays (weighted by 1 / sigma^2), its covariance and the condition of the system.

    A ray with unit direction d gives the projector I - d d^T; twelve sums reach the driver, where the 3 x 3
    system is solved. Rays that are parallel have no such point: an error.
    """
    norm = F.sqrt(reduce(Column.__add__, [F.col(c) * F.col(c) for c in direction]))
    d = [F.col(c) / norm for c in direction]
    w = 1 / (sigma * sigma) if sigma is not None else F.lit(1.0)
    entry = [[w * ((1.0 if i == j else 0.0) - d[i] * d[j]) for j in range(3)] for i in range(3)]
    right = [reduce(Column.__add__, [entry[i][j] * F.col(origin[j]) for j in range(3)]) for i in range(3)]
    row = rays.agg(*[F.sum(entry[i][j]) for i in range(3) for j in range(3)], *[F.sum(b) for b in right], F.count(F.lit(1))).first()
    system, known = np.array(row[:9], float).reshape(3, 3), np.array(row[9:12], float)
    condition = float(np.linalg.cond(system))
    if row[12] < 2 or not condition < 1e12:
        raise ValueError("at least two rays that are not parallel are needed")
    return {"point": np.linalg.solve(system, known), "covariance": np.linalg.inv(system), "condition": condition, "n": int(row[12])}


def robust_similarity(pairs: DataFrame, source: list[str], target: list[str], rounds: int = 6, limit: float = 3.0) -> dict:
    """A similarity fit that leaves out pairs whose residual lies over the median + limit x 1.4826 MAD, again and again.

    Each round is one fit from sums, and two exact medians by rank; only those reach the driver.
    """
    from .points import similarity_fit
    from .statistics import quantiles

    kept, n = pairs, pairs.count()
    fit = similarity_fit(kept, source, target)
    for _ in range(rounds):
        moved = [F.lit(float(fit["translation"][i])) + reduce(Column.__add__, [F.lit(float(fit["scale"] * fit["rotation"][i][j])) * F.col(source[j]) for j in range(len(source))]) for i in range(len(target))]
        residual = F.sqrt(reduce(Column.__add__, [F.pow(F.col(target[i]) - moved[i], 2) for i in range(len(target))]))
        away = pairs.withColumn("__d", residual)
        median = quantiles(away, [], F.col("__d"), {"m": ("linear", 0.5)}).first()["m"]
        mad = quantiles(away, [], F.abs(F.col("__d") - F.lit(median)), {"m": ("linear", 0.5)}).first()["m"]
        kept = away.where(F.col("__d") <= median + limit * 1.4826 * mad + 1e-9).drop("__d")
        now = kept.count()
        if now < 3:
            break
        fit = similarity_fit(kept, source, target)
        if now == n:
            break
        n = now
    return fit | {"n": n}


def degree_stats(edges: DataFrame, a: str, b: str) -> DataFrame:
    """One row: nodes, and least, greatest and mean number of edges of a node."""
    ends = edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return ends.agg(F.count(F.lit(1)).alias("nodes"), F.min("degree").alias("min"), F.max("degree").alias("max"), F.avg("degree").alias("mean"))


def telemetry(df: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Field-wise sums; a missing field counts as 0."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def against_baseline(df: DataFrame, run: str, baseline: Column, measures: list[str]) -> DataFrame:
    """Each run's measures as difference from and ratio to the one baseline row's."""
    base = df.where(baseline).limit(1).select(*[F.col(m).alias(f"__{m}") for m in measures])
    rows = df.join(F.broadcast(base))
    out = []
    for m in measures:
        out += [(F.col(m) - F.col(f"__{m}")).alias(f"{m}_delta"), (F.col(m) / F.nullif(f"__{m}", F.lit(0.0))).alias(f"{m}_ratio")]
    return rows.select(run, *out)


def scene_extent(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """One row: bounds, centre and the greatest distance of a point from the centre."""
    axes = (x, y, z)
    bounds = df.agg(*[F.min(c).alias(f"low_{c}") for c in axes], *[F.max(c).alias(f"high_{c}") for c in axes], *[F.avg(c).alias(f"centre_{c}") for c in axes])
    away = F.sqrt(reduce(Column.__add__, [F.pow(F.col(c) - F.col(f"centre_{c}"), 2) for c in axes]))
    radius = df.select(*axes).join(F.broadcast(bounds)).agg(F.max(away).alias("radius"))
    return bounds.join(radius)


def mission_projection(df: DataFrame, mission: str, stage: str, attempt: str, status: str, progress: str, priority: dict[str, int]) -> DataFrame:
    """For each mission its latest attempts as one: the status that comes first by priority, and the mean progress, half to even."""
    latest = df.groupBy(mission, stage).agg(F.max_by(F.struct(F.col(status).alias("s"), F.col(progress).alias("p")), attempt).alias("x"))
    rank = F.create_map(*[F.lit(v) for pair in priority.items() for v in pair])
    first = F.min_by("x.s", F.coalesce(F.try_element_at(rank, F.col("x.s")), F.lit(len(priority))))
    return latest.groupBy(mission).agg(first.alias("status"), F.bround(F.avg("x.p")).cast("int").alias("progress"), F.count(F.lit(1)).alias("stages"))


def dataset_summary(df: DataFrame, at: str, lat: str, lon: str, alt: str) -> DataFrame:
    """One row about geotagged images: counts, coverage, altitude figures, bounds, centre and times; nulls where there are none."""
    placed = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    z = finite(F.col(alt))
    return df.agg(
        F.count(F.lit(1)).alias("images"), F.count_if(placed).alias("placed"), (100 * F.count_if(placed) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("coverage_percent"),
        F.min(z).alias("alt_min"), F.max(z).alias("alt_max"), F.avg(z).alias("alt_mean"),
        F.min(F.when(placed, F.col(lon))).alias("west"), F.min(F.when(placed, F.col(lat))).alias("south"), F.max(F.when(placed, F.col(lon))).alias("east"), F.max(F.when(placed, F.col(lat))).alias("north"),
        F.avg(F.when(placed, F.col(lon))).alias("centre_lon"), F.avg(F.when(placed, F.col(lat))).alias("centre_lat"), F.min(at).alias("first_at"), F.max(at).alias("last_at"),
    )
