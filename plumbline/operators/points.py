"""Point and splat tables: filters, quantisation, merges, tree splits, seams and coverage."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.geometry import feather_weight, quantise

from .lineage import cut, small
from .statistics import with_quantiles


def visible(scales: list[str], opacity: str, most_scale: float, least_opacity: float, most_ratio: float) -> Column:
    """Whether a splat (log scales, opacity before the sigmoid) is small, opaque and round enough."""
    big, small = F.greatest(*scales), F.least(*scales)
    return (big <= F.log(F.lit(most_scale))) & (F.col(opacity) > F.log(F.lit(least_opacity) / (1 - F.lit(least_opacity)))) & (F.exp(big - small) <= most_ratio)


def outliers_removed(df: DataFrame, row_id: str, distances: DataFrame, deviations: float) -> DataFrame:
    """Rows whose mean neighbour distance (a, distance) is at most mean + deviations x population deviation."""
    mean = distances.groupBy("a").agg(F.avg("distance").alias("__d"))
    limits = mean.agg((F.avg("__d") + deviations * F.stddev_pop("__d")).alias("__limit"))
    good = mean.join(F.broadcast(limits)).where("__d <= __limit").select(F.col("a").alias(row_id))
    return df.join(good, row_id, "left_semi")


def largest_component(df: DataFrame, row_id: str, labels: DataFrame) -> DataFrame:
    """Rows of the component (node, component) with most nodes; of equals, the one with the smaller label."""
    best = labels.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    keep = labels.join(F.broadcast(best.select("component")), "component").select(F.col("node").alias(row_id))
    return df.join(keep, row_id, "left_semi")


def retained(before: DataFrame, after: DataFrame, least: float) -> DataFrame:
    """One row: how much is left, and whether that is enough; nothing left of nothing is not."""
    n = before.agg(F.count(F.lit(1)).alias("n_before")).join(after.agg(F.count(F.lit(1)).alias("n_after")))
    share = F.col("n_after") / F.nullif("n_before", F.lit(0))
    return n.withColumn("retention", share).withColumn("accepted", F.coalesce(share >= least, F.lit(False)))


def concatenated_cores(parts: list[DataFrame]) -> DataFrame:
    """Union of tables with the same columns and types in the same order; anything else is an error."""
    first = parts[0].schema
    for p in parts[1:]:
        if [(f.name, f.dataType) for f in p.schema] != [(f.name, f.dataType) for f in first]:
            raise ValueError("the parts differ in their columns")
    return reduce(DataFrame.unionAll, parts)


def feathered_weights(df: DataFrame, row_id: str, x: str, y: str, cells: DataFrame, width: float) -> DataFrame:
    """Normalised weights of rows in overlapping cells (cell, west, south, east, north): 1 inside, falling to an edge.

    Cells are few, and a row meets only those that hold it.
    """
    inside = F.col(x).between(F.col("west"), F.col("east")) & F.col(y).between(F.col("south"), F.col("north"))
    near = F.least(F.col(x) - F.col("west"), F.col("east") - F.col(x), F.col(y) - F.col("south"), F.col("north") - F.col(y))
    met = df.join(small(cells), inside).withColumn("__w", F.greatest(feather_weight(near, width), F.lit(1e-9)))
    total = F.sum("__w").over(Window.partitionBy(row_id))
    return met.withColumn("weight", F.col("__w") / total).drop("__w")


def quantised(df: DataFrame, columns: list[str], levels: int = 65535) -> DataFrame:
    """Columns as integers 0..levels over their finite range, which is added as `<column>_low` and `_high`."""
    extent = df.agg(*[F.min(c).alias(f"{c}_low") for c in columns], *[F.max(c).alias(f"{c}_high") for c in columns])
    joined = df.join(F.broadcast(extent))
    return joined.withColumns({c: quantise(F.col(c), F.col(f"{c}_low"), F.col(f"{c}_high"), levels) for c in columns})


def split_tree(df: DataFrame, row_id: str, axes: list[str], leaf_rows: int, most_depth: int = 48) -> DataFrame:
    """Add `node`, the path of a row's leaf in a binary tree ('' is the root, then 0 and 1).

    A node with more than leaf_rows rows is split at the middle of its longest axis, or by a hash of the id
    where it has no extent. Each level is one aggregate and one projection over all rows;
    rows of finished leaves are left alone.
    """
    work, done, depth = cut(df.withColumn("node", F.lit(""))), None, 0
    while True:
        sizes = work.groupBy("node").agg(F.count(F.lit(1)).alias("__n"), *[F.min(a).alias(f"__lo_{a}") for a in axes], *[F.max(a).alias(f"__hi_{a}") for a in axes])
        joined = work.join(sizes, "node")
        split = (F.col("__n") > leaf_rows) & F.lit(depth < most_depth)
        leaves = joined.where(~split).select(*work.columns)
        done = leaves if done is None else done.unionByName(leaves)
        rest = joined.where(split)
        if not rest.limit(1).count():
            return done
        longest = F.greatest(*[F.struct((F.col(f"__hi_{a}") - F.col(f"__lo_{a}")).alias("s"), F.lit(-i).alias("i")) for i, a in enumerate(axes)])
        value = F.coalesce(*[F.when(longest["i"] == -i, F.col(a)) for i, a in enumerate(axes)])
        middle = F.coalesce(*[F.when(longest["i"] == -i, (F.col(f"__lo_{a}") + F.col(f"__hi_{a}")) / 2) for i, a in enumerate(axes)])
        sided = rest.withColumn("__side", F.when(value < middle, 0).otherwise(1))
        # Only a node without extent has an empty half; it is halved by a hash of id and depth.
        flat = F.coalesce(longest["s"], F.lit(0.0)) <= 0
        sided = sided.withColumn("__side", F.when(flat, F.pmod(F.xxhash64(row_id, F.lit(depth)), F.lit(2))).otherwise(F.col("__side")))
        work = cut(sided.withColumn("node", F.concat("node", F.col("__side").cast("string"))).select(*work.columns))
        depth += 1


def principal_axes(moments: DataFrame, axes: list[str]) -> DataFrame:
    """Eigenvalues (descending) of each group's covariance, from columns cov_<a>_<b>."""
    pairs = [f"cov_{a}_{b}" for i, a in enumerate(axes) for b in axes[i:]]

    @F.pandas_udf("array<double>")
    def eigenvalues(c: pd.DataFrame) -> pd.Series:
        m = np.zeros((len(c), len(axes), len(axes)))
        k = 0
        for i in range(len(axes)):
            for j in range(i, len(axes)):
                m[:, i, j] = m[:, j, i] = c.iloc[:, k]
                k += 1
        return pd.Series(list(np.linalg.eigvalsh(m)[:, ::-1]))

    return moments.withColumn("eigenvalues", eigenvalues(F.struct(*pairs)))


def similarity_fit(pairs: DataFrame, source: list[str], target: list[str]) -> dict:
    """Scale, rotation, translation and RMSE of the similarity that maps source to target points.

    One aggregate gives means and covariances; the 3 x 3 decomposition of those sums is done on the driver.
    """
    d = len(source)
    sums = [F.count(F.lit(1))] + [F.avg(c) for c in source + target] + [F.var_pop(c) for c in source + target] + [F.covar_pop(t, s) for t in target for s in source]
    row = [float(v or 0) for v in pairs.agg(*sums).first()]
    n, mean_s, mean_t = row[0], np.array(row[1 : 1 + d]), np.array(row[1 + d : 1 + 2 * d])
    var_s, var_t = sum(row[1 + 2 * d : 1 + 3 * d]), sum(row[1 + 3 * d : 1 + 4 * d])
    if n < 3 or var_s <= 0:
        raise ValueError("at least three points that differ are needed")
    u, s, v = np.linalg.svd(np.array(row[1 + 4 * d :]).reshape(d, d))
    sign = np.ones(d)
    sign[-1] = np.sign(np.linalg.det(u) * np.linalg.det(v))
    rotation, scale = u @ np.diag(sign) @ v, float((s * sign).sum() / var_s)
    residual = max(0.0, var_t - scale * float((s * sign).sum()))
    return {"scale": scale, "rotation": rotation, "translation": mean_t - scale * rotation @ mean_s, "rmse": residual**0.5, "n": int(n)}


def seam_ratio(raster: DataFrame, seam_col: int) -> DataFrame:
    """One row about a raster (row, col, v): mean and p95 step across a column boundary against steps elsewhere."""
    steps = raster.withColumn("step", F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("row").orderBy("col")))).where("step IS NOT NULL")
    at = F.col("col") == seam_col
    means = steps.agg(F.avg(F.when(at, F.col("step"))).alias("seam_mean"), F.avg(F.when(~at, F.col("step"))).alias("interior_mean"))
    found = with_quantiles(steps, [], means, F.when(at, F.col("step")), {"seam_p95": ("linear", 0.95)})
    return found.withColumn("ratio", F.col("seam_mean") / F.nullif("interior_mean", F.lit(0.0)))


def within_reach(df: DataFrame, x: str, y: str, centres: DataFrame, cx: str, cy: str, reach: float) -> DataFrame:
    """Rows that have a centre within `reach`: centres go to the nine cells around theirs and meet the rows there."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = centres.select(F.col(cx).alias("__x"), F.col(cy).alias("__y")).withColumn("__i", F.explode(step)).withColumn("__j", F.explode(step))
    spread = spread.select("__x", "__y", (cell("__x") + F.col("__i")).alias("__cx"), (cell("__y") + F.col("__j")).alias("__cy"))
    near = F.hypot(F.col(x) - F.col("__x"), F.col(y) - F.col("__y")) <= reach
    return df.join(spread, (cell(x) == F.col("__cx")) & (cell(y) == F.col("__cy")) & near, "left_semi")
