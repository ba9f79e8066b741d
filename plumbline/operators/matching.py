"""Joins with fallbacks, priorities, ranges and tolerances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import small


def priority_overlay(base: DataFrame, key: str, sources: dict[str, DataFrame], value: str) -> DataFrame:
    """Each key's value from the first source that has one, and which source that is."""
    out = base
    for name, df in sources.items():
        out = out.join(df.select(key, F.col(value).alias(f"__{name}")), key, "left")
    picked = F.coalesce(*[F.when(F.col(f"__{n}").isNotNull(), F.struct(F.col(f"__{n}").alias("v"), F.lit(n).alias("s"))) for n in sources])
    return out.withColumn(value, picked["v"]).withColumn("source", picked["s"]).drop(*[f"__{n}" for n in sources])


def fallback_join(left: DataFrame, right: DataFrame, exact: list[str], loose: list[str], value: str) -> DataFrame:
    """Match on all keys, else on the loose ones alone if these name one row only; `matched` tells how."""
    full = right.groupBy(*exact).agg(F.min(value).alias("__full"), F.count(F.lit(1)).alias("__nf"))
    part = right.groupBy(*loose).agg(F.min(value).alias("__part"), F.count(F.lit(1)).alias("__np"))
    both = left.join(full, exact, "left").join(part, loose, "left")
    how = F.when(F.col("__nf") == 1, "exact").when(F.col("__nf") > 1, "ambiguous").when(F.col("__np") == 1, "loose").when(F.col("__np") > 1, "ambiguous").otherwise("none")
    got = F.when(how == "exact", F.col("__full")).when(how == "loose", F.col("__part"))
    return both.withColumn(value, got).withColumn("matched", how).drop("__full", "__part", "__nf", "__np")


def clock_offset(left: DataFrame, right: DataFrame, key: str, at: str, hours: int = 14) -> DataFrame:
    """For each key the whole-hour offset of the right clock that brings it nearest to the left one."""
    both = left.select(key, F.col(at).alias("__a")).join(right.select(key, F.col(at).alias("__b")), key)
    tried = both.withColumn("offset", F.explode(F.sequence(F.lit(-hours), F.lit(hours))))
    off = F.abs(F.col("__a").cast("double") - (F.col("__b").cast("double") + F.col("offset") * 3600))
    return tried.groupBy(key).agg(F.min(F.struct(off.alias("seconds"), F.abs("offset").alias("o"), F.col("offset").alias("offset"))).alias("m")).select(key, "m.offset", "m.seconds")


def temporal_band(df: DataFrame, group: str, order: list[str], row_id: str, width: int) -> DataFrame:
    """Pairs (a, b) of rows at most `width` places apart in their group's order: an equi-join on the place."""
    placed = df.select(group, F.col(row_id).alias("id"), F.row_number().over(Window.partitionBy(group).orderBy(*order)).alias("p"))
    ahead = placed.select(group, F.col("id").alias("a"), "p", F.explode(F.sequence(F.lit(1), F.lit(width))).alias("gap"))
    return ahead.join(placed.select(group, F.col("id").alias("b"), F.col("p").alias("q")), [group]).where("p + gap = q").select(group, "a", "b", "gap")


def excluded_ranges(df: DataFrame, name: str, ranges: DataFrame, start: str, end: str) -> DataFrame:
    """Rows whose name, whatever its case, lies in none of the inclusive ranges (few: an error if too many)."""
    folded = F.lower(F.col(name))
    return df.join(small(ranges), folded.between(F.lower(F.col(start)), F.lower(F.col(end))), "left_anti")


def raster_lookup(points: DataFrame, col: Column, row: Column, raster: DataFrame, width: int, height: int) -> DataFrame:
    """The pixel (row, col, v) under each point, with `status`: outside, nodata or ok."""
    placed = points.withColumn("__c", F.floor(col)).withColumn("__r", F.floor(row))
    met = placed.join(raster.select(F.col("row").alias("__pr"), F.col("col").alias("__pc"), F.col("v").alias("value")), (F.col("__r") == F.col("__pr")) & (F.col("__c") == F.col("__pc")), "left")
    inside = F.col("__c").between(0, width - 1) & F.col("__r").between(0, height - 1)
    status = F.when(~F.coalesce(inside, F.lit(False)), "outside").when(F.col("value").isNull() | F.isnan("value"), "nodata").otherwise("ok")
    return met.withColumn("status", status).drop("__c", "__r", "__pc", "__pr")


def hold_out(df: DataFrame, order: list[str], every: int) -> DataFrame:
    """Add `held_out` for every n-th row of the order."""
    from .ranking import global_rank

    return global_rank(df, [F.col(c) for c in order], "__n").withColumn("held_out", F.col("__n") % every == 0).drop("__n")


def fan_in(plan: DataFrame, results: DataFrame, run: str, shard: str) -> DataFrame:
    """For each run of a plan (run, n_shards): results, distinct shards, missing ones, and whether it is complete."""
    got = results.groupBy(run).agg(F.count(F.lit(1)).alias("n_results"), F.collect_set(shard).alias("__have"))
    both = plan.join(got, run, "left").withColumn("__have", F.coalesce("__have", F.array().cast("array<bigint>")))
    missing = F.array_except(F.sequence(F.lit(0).cast("long"), (F.col("n_shards") - 1).cast("long")), "__have")
    return both.select(run, "n_shards", F.coalesce("n_results", F.lit(0)).alias("n_results"), missing.alias("missing"),
                       ((F.size(missing) == 0) & (F.col("n_results") == F.col("n_shards"))).alias("complete"))


def spatial_hold_out(df: DataFrame, row_id: str, x: str, y: str, every: int, guard: int) -> DataFrame:
    """Add `part`: the n/every rows nearest to the middle are `held_out`, the next n/guard a `guard` band, the rest `train`.

    Distances are in units of the extent along each axis, rounded to nine digits; ties go by id. Ranks come from
    range partitions.
    """
    from .ranking import global_rank

    middle = df.agg(F.avg(x).alias("__cx"), F.avg(y).alias("__cy"), (F.max(x) - F.min(x)).alias("__wx"), (F.max(y) - F.min(y)).alias("__wy"), F.count(F.lit(1)).alias("__n"))
    off = lambda c, m, w: F.coalesce(F.pow((F.col(c) - F.col(m)) / F.nullif(w, F.lit(0.0)), 2), F.lit(0.0))
    away = df.join(F.broadcast(middle)).withColumn("__d", F.round(off(x, "__cx", "__wx") + off(y, "__cy", "__wy"), 9))
    ranked = global_rank(away, [F.asc("__d"), F.asc(row_id)], "__k")
    held, band = F.ceil(F.col("__n") / every), F.ceil(F.col("__n") / guard)
    part = F.when(F.col("__k") <= held, "held_out").when(F.col("__k") <= held + band, "guard").otherwise("train")
    return ranked.withColumn("part", part).select(*df.columns, "part")
