"""Statistics: percentile families, robust masks, descriptions and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut
from .ranking import running_sums


def finite(c: Column) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _of_key(keys: list[str], right: DataFrame) -> tuple[DataFrame, Column]:
    """The right side of a join on keys of which any may be null, and the condition."""
    renamed = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return renamed, on


def quantiles(df: DataFrame, keys: list[str], value: Column, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact quantiles of each key's finite values: keys, and a column for each name of `wanted` (kind, p).

    Kinds over n sorted values from 0: `linear` interpolates at (n - 1) p, `nearest` takes ceil(n p) - 1 and
    `floor` floor((n - 1) p). Equal values are counted first, in each task and then in all; running counts over ranges of
    the distinct ones tell which value lies at a place. So neither a key's values nor a frequent value's rows meet in
    one buffer or task. A key without finite values has nulls.
    """
    x = df.select(*keys, finite(value.cast("double")).alias("__x")).where("__x IS NOT NULL")
    counted = x.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__c"))
    ranked = running_sums(counted, [], [*[F.col(k) for k in keys], F.col("__x")], {"__r": F.col("__c")})
    firsts = cut(ranked.groupBy(*keys).agg(F.min(F.col("__r") - F.col("__c")).alias("__first"), F.sum("__c").alias("__n")))
    n = F.col("__n")
    places = {}
    for name, (kind, p) in wanted.items():
        at = F.greatest(F.lit(0.0), F.ceil(n * p) - 1) if kind == "nearest" else (n - 1) * F.lit(p)
        places[name] = (F.floor(at), F.ceil(at) if kind == "linear" else F.floor(at), at)
    renamed, on = _of_key(keys, firsts)
    few = F.broadcast(renamed) if not keys else renamed
    after = F.col("__r") - F.col("__first")
    sides = F.array_distinct(F.array(*[side for low, high, _ in places.values() for side in (low, high)]))
    hits = ranked.join(few, on).withColumn("__at", F.explode(F.filter(sides, lambda p: (p < after) & (p >= after - F.col("__c")))))
    hits = hits.select(*keys, "__x", "__at", "__n")
    picked = []
    for name, (low, high, at) in places.items():
        picked += [F.max(F.when(F.col("__at") == low, F.col("__x"))).alias(f"__lo_{name}"), F.max(F.when(F.col("__at") == high, F.col("__x"))).alias(f"__hi_{name}"), F.max(at - low).alias(f"__w_{name}")]
    rows = hits.groupBy(*keys).agg(*picked)
    out = [(F.col(f"__lo_{m}") + (F.col(f"__hi_{m}") - F.col(f"__lo_{m}")) * (F.col(f"__w_{m}") if wanted[m][0] == "linear" else F.lit(0.0))).alias(m) for m in wanted]
    if not keys:
        return rows.select(*out)
    every, same = _of_key(keys, rows.select(*keys, *out))
    return df.select(*keys).distinct().join(every, same, "left").select(*keys, *wanted)


def with_quantiles(df: DataFrame, keys: list[str], sums: DataFrame, value: Column, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Add the quantiles of a value to one row for each key."""
    found, on = _of_key(keys, quantiles(df, keys, value, wanted))
    return sums.join(found, on, "left").select(*sums.columns, *wanted)


def describe(df: DataFrame, keys: list[str], c: Column) -> DataFrame:
    """For each key count, mean, population deviation, RMS, least, greatest, median, 5th and 95th percentile of finite values."""
    x = finite(c)
    sums = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.sqrt(F.avg(x * x)).alias("rmse"), F.min(x).alias("min"), F.max(x).alias("max")
    )
    return with_quantiles(df, keys, sums, c, {"median": ("linear", 0.5), "p05": ("linear", 0.05), "p95": ("linear", 0.95)})


def median_of_positives(df: DataFrame, keys: list[str], c: Column, default: float, name: str) -> DataFrame:
    """The median of each key's positive finite values, or the default."""
    found = quantiles(df, keys, F.when(c > 0, c), {name: ("linear", 0.5)})
    return found.withColumn(name, F.coalesce(name, F.lit(default)))


def mad_inliers(df: DataFrame, keys: list[str], c: str, threshold: float, scale: float = 3.0) -> DataFrame:
    """Add `inlier`: |x| <= max(threshold, med + scale 1.4826 MAD) of the key's |x|; keys under 4 rows keep all."""
    size = F.abs(F.col(c))
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    med, on = _of_key(keys, with_quantiles(df, keys, counted, size, {"__med": ("linear", 0.5)}))
    with_med = df.join(med, on).select(*df.columns, "__med", "__n")
    mad, on = _of_key(keys, quantiles(with_med, keys, F.abs(size - F.col("__med")), {"__mad": ("linear", 0.5)}))
    limit = F.greatest(F.lit(threshold), F.col("__med") + F.lit(scale * 1.4826) * F.col("__mad"))
    judged = with_med.join(mad, on).withColumn("inlier", (F.col("__n") < 4) | (size <= limit))
    return judged.select(*df.columns, "inlier")


def iqr_filter(df: DataFrame, c: str, factor: float = 5.0) -> DataFrame:
    """Rows within factor interquartile ranges of the quartiles (linear quantiles)."""
    q = quantiles(df, [], F.col(c), {"__q1": ("linear", 0.25), "__q3": ("linear", 0.75)})
    room = (F.col("__q3") - F.col("__q1")) * factor
    return df.join(F.broadcast(q)).where(F.col(c).between(F.col("__q1") - room, F.col("__q3") + room)).drop("__q1", "__q3")


def benchmark_summary(df: DataFrame, keys: list[str], c: str, success: Column) -> DataFrame:
    """Runs, successes, least, mean, median, nearest-rank p95 and greatest value, sample deviation and the mean's 95 % interval."""
    good = df.withColumn("__x", F.when(success, F.col(c)))
    sums = good.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.count("__x").alias("successes"), F.min("__x").alias("min"), F.avg("__x").alias("mean"), F.max("__x").alias("max"), F.stddev_samp("__x").alias("std")
    )
    out = with_quantiles(good, keys, sums, F.col("__x"), {"median": ("linear", 0.5), "p95": ("nearest", 0.95)})
    return out.withColumn("ci95", 1.96 * F.col("std") / F.sqrt("successes"))


def occupancy(df: DataFrame, x: Column, y: Column, n_x: int, n_y: int) -> DataFrame:
    """One row about a grid's cells: occupied share, effective cells (exp of entropy), shares of the fullest 1, 5, 10 %."""
    cells = df.groupBy(x.alias("cx"), y.alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("occupied"))
    # The grid bounds the rows of this window.
    ranked = cells.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "cx", "cy"))).join(F.broadcast(total))
    p = F.col("n") / F.col("total")

    def top(share: float) -> Column:
        return F.sum(F.when(F.col("r") <= F.ceil(F.col("occupied") * share), p).otherwise(0.0))

    return ranked.agg(
        F.max("occupied").alias("occupied"), (F.max("occupied") / (n_x * n_y)).alias("occupied_ratio"), F.exp(-F.sum(p * F.log(p))).alias("effective_cells"),
        top(0.01).alias("top1"), top(0.05).alias("top5"), top(0.10).alias("top10"), F.median("n").alias("median"), F.percentile("n", 0.9).alias("p90"),
    )


def signed_difference(a: str, b: str, peak: float) -> list[Column]:
    """Bias, RMS with and without it, mean absolute error, PSNR and correlation of two aligned columns."""
    d = F.col(a) - F.col(b)
    rmse = F.sqrt(F.avg(d * d))
    n, sd = F.count(d), F.stddev_pop(a) * F.stddev_pop(b)
    return [
        F.count(d).alias("n"), F.avg(d).alias("bias"), rmse.alias("rmse"), F.sqrt(F.var_pop(d)).alias("rmse_corrected"), F.avg(F.abs(d)).alias("mae"),
        F.when(rmse > 0, 20 * F.log10(F.lit(peak) / rmse)).alias("psnr"), F.when((n > 1) & (sd > 0), F.corr(a, b)).alias("correlation"),
    ]


def group_moments(df: DataFrame, key: str, weight: Column, axes: list[str]) -> DataFrame:
    """Mass, weighted centroid and weighted covariance of each group, from sums that combine on the map side."""
    w = df.withColumn("__w", weight)
    sums = [F.sum("__w").alias("mass")] + [F.sum(F.col("__w") * F.col(a)).alias(f"s_{a}") for a in axes]
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    sums += [F.sum(F.col("__w") * F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in pairs]
    m = w.groupBy(key).agg(*sums)
    mean = {a: F.col(f"s_{a}") / F.col("mass") for a in axes}
    return m.select(key, "mass", *[mean[a].alias(f"mean_{a}") for a in axes], *[(F.col(f"s_{a}_{b}") / F.col("mass") - mean[a] * mean[b]).alias(f"cov_{a}_{b}") for a, b in pairs])
