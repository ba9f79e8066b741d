"""Rasters as pixel tables (row, col, v): stretching, downsampling, similarity, coverage, occupancy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import finite, quantiles


def stretched(raster: DataFrame, low: float = 0.02, high: float = 0.98, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add `shown`: v from its low to its high percentile (of each key, say a band) as 0 to 255; no range gives 0."""
    on = list(keys)
    q = quantiles(raster, on, F.col("v"), {"__lo": ("linear", low), "__hi": ("linear", high)})
    joined = raster.join(q, on) if keys else raster.join(F.broadcast(q))
    scaled = (finite(F.col("v")) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    shown = F.rint(F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)) * 255)
    return joined.withColumn("shown", F.when(finite(F.col("v")).isNotNull(), F.coalesce(shown, F.lit(0.0)).cast("int"))).drop("__lo", "__hi")


def downsampled(raster: DataFrame, factor: float) -> DataFrame:
    """A coarser raster: each target pixel is the mean of the source pixels it overlaps, weighted by area."""

    def spans(place: str) -> Column:
        first, last = F.floor(F.col(place) / factor), F.ceil((F.col(place) + 1) / factor) - 1
        return F.explode(F.sequence(first, last))

    def share(place: str, target: str) -> Column:
        return F.least(F.col(place) + 1, (F.col(target) + 1) * factor) - F.greatest(F.col(place).cast("double"), F.col(target) * factor)

    spread = raster.where(finite(F.col("v")).isNotNull()).withColumn("__r", spans("row")).withColumn("__c", spans("col"))
    weighed = spread.withColumn("__w", share("row", "__r") * share("col", "__c")).where("__w > 1e-12")
    out = weighed.groupBy(F.col("__r").alias("row"), F.col("__c").alias("col"))
    return out.agg((F.sum(F.col("__w") * F.col("v")) / F.sum("__w")).alias("v"))


def blurred(raster: DataFrame, value: Column, radius: int, sigma: float) -> DataFrame:
    """A Gaussian blur of a pixel expression over the pixels there are: each pixel gives its share to its neighbours."""
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    steps = F.array(*[F.struct(F.lit(i - radius).alias("d"), F.lit(w).alias("w")) for i, w in enumerate(kernel)])
    at = raster.select("row", "col", value.alias("__v"))
    for axis in ("row", "col"):  # separable: first along rows, then along columns
        spread = at.withColumn("__k", F.explode(steps)).withColumn(axis, F.col(axis) + F.col("__k.d"))
        sums = spread.groupBy("row", "col").agg(F.sum(F.col("__v") * F.col("__k.w")).alias("__s"), F.sum("__k.w").alias("__w"))
        at = sums.join(raster.select("row", "col"), ["row", "col"], "left_semi").select("row", "col", (F.col("__s") / F.col("__w")).alias("__v"))
    return at.withColumnRenamed("__v", "v")


def structural_similarity(a: DataFrame, b: DataFrame, peak: float, radius: int = 5, sigma: float = 1.5) -> DataFrame:
    """One row: mean SSIM and PSNR of two rasters over the pixels they share."""
    both = a.select("row", "col", F.col("v").alias("a")).join(b.select("row", "col", F.col("v").alias("b")), ["row", "col"])
    parts = {"ma": F.col("a"), "mb": F.col("b"), "aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b"), "ab": F.col("a") * F.col("b")}
    moments = both
    for name, value in parts.items():
        moments = moments.join(blurred(both, value, radius, sigma).withColumnRenamed("v", name), ["row", "col"])
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    va, vb, cov = F.col("aa") - F.col("ma") * F.col("ma"), F.col("bb") - F.col("mb") * F.col("mb"), F.col("ab") - F.col("ma") * F.col("mb")
    top = (2 * F.col("ma") * F.col("mb") + c1) * (2 * cov + c2)
    ssim = top / ((F.col("ma") * F.col("ma") + F.col("mb") * F.col("mb") + c1) * (va + vb + c2))
    mse = F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))
    return moments.agg(F.avg(ssim).alias("ssim"), F.when(mse > 0, 10 * F.log10(F.lit(peak * peak) / mse)).alias("psnr"))


def occupancy_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row about two sets of cells (col, row): share of a retained in b, IoU, share of b that is new."""
    x = a.select("col", "row").distinct().withColumn("__a", F.lit(1))
    y = b.select("col", "row").distinct().withColumn("__b", F.lit(1))
    n = x.join(y, ["col", "row"], "full_outer").agg(F.count("__a").alias("n_a"), F.count("__b").alias("n_b"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("n_both"), F.count(F.lit(1)).alias("n_any"))
    ratio = lambda p, q: (F.col(p) / F.nullif(F.col(q), F.lit(0)))
    return n.select(ratio("n_both", "n_a").alias("retained"), ratio("n_both", "n_any").alias("iou"), (1 - ratio("n_both", "n_b")).alias("new"))


def coverage_report(raster: DataFrame, size: int, least: float) -> DataFrame:
    """For each cell of `size` pixels a side: pixels, share of finite ones, and whether that is enough."""
    cell = [F.floor(F.col(c) / size).alias(f"cell_{c}") for c in ("row", "col")]
    share = F.count(finite(F.col("v"))) / F.count(F.lit(1))
    return raster.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), share.alias("coverage"), (share >= least).alias("covered"))
