"""Ordered rows: paths, passes, expansions and tile grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def path_length(df: DataFrame, key: str, order: list[str], step: Column) -> DataFrame:
    """Sum over consecutive rows of each key of `step`, which may use `prev` (a struct of the row before)."""
    w = Window.partitionBy(key).orderBy(*order)
    with_prev = df.withColumn("prev", F.lag(F.struct(*df.columns)).over(w))
    return with_prev.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("prev").isNotNull(), step)), F.lit(0.0)).alias("length"), F.count(F.lit(1)).alias("n"))


def passes(df: DataFrame, key: str, sequence: str, value: str, max_gap: float, max_step: float, min_rows: int, share: float = 0.25) -> DataFrame:
    """Runs of rows without a gap in sequence or a jump in value; short runs of a key go.

    A row starts a run if its sequence is not within (0, max_gap] of the row before or its value is more
    than max_step away. Kept are runs of at least max(min_rows, share x the key's longest run) rows.
    """
    w = Window.partitionBy(key).orderBy(sequence)
    gap, jump = F.col(sequence) - F.lag(sequence).over(w), F.abs(F.col(value) - F.lag(value).over(w))
    starts = F.when(gap.isNull() | (gap <= 0) | (gap > max_gap) | (jump > max_step), 1).otherwise(0)
    runs = df.withColumn("__s", starts).withColumn("run", F.sum("__s").over(w)).groupBy(key, "run").agg(
        F.count(F.lit(1)).alias("n"), F.min(sequence).alias("first"), F.max(sequence).alias("last")
    )
    longest = F.max("n").over(Window.partitionBy(key))
    return runs.withColumn("__longest", longest).where(F.col("n") >= F.greatest(F.lit(min_rows), F.col("__longest") * share)).drop("__longest")


def best_per_cell_then_fill(df: DataFrame, cells: list[str], best: list[Column], capacity: int) -> DataFrame:
    """The best row of each cell, and where capacity is left, the best of the rest; marked by `tier`."""
    per_cell = F.row_number().over(Window.partitionBy(*cells).orderBy(*best))
    return df.withColumn("tier", F.when(per_cell == 1, 0).otherwise(1)).orderBy("tier", *best).limit(capacity)


def lifecycle_log(df: DataFrame, key: str, times: list[str]) -> DataFrame:
    """A row (key, step, at) for each time that is set."""
    steps = F.array(*[F.struct(F.lit(t).alias("step"), F.col(t).alias("at")) for t in times])
    return df.select(key, F.inline(steps)).where(F.col("at").isNotNull())


def tile_starts(size: Column, tile: int, overlap: int) -> Column:
    """Where tiles of one axis start.

    Tiles follow at tile - overlap. The last one ends with the axis; where it would cover fewer new pixels
    than the overlap, the tile before it is moved there instead.
    """
    stride = tile - overlap
    last = size - tile
    regular = F.transform(F.sequence(F.lit(0), F.floor(last / stride).cast("int")), lambda i: i * stride)
    rest = last - F.element_at(regular, -1)
    moved = F.concat(F.slice(regular, 1, F.greatest(F.size(regular) - 1, F.lit(0))), F.array(last.cast("int")))
    snapped = F.when(rest == 0, regular).when((rest < overlap) & (F.size(regular) > 1), moved).otherwise(F.concat(regular, F.array(last.cast("int"))))
    return F.when(size <= tile, F.array(F.lit(0))).otherwise(snapped)


def tile_plan(rasters: DataFrame, row_id: str, width: str, height: str, tile: int, overlap: int, shard: int) -> DataFrame:
    """Row-major tiles of rasters: index, offsets, size and the shard of `shard` tiles that each belongs to."""
    grid = rasters.select(row_id, width, height, tile_starts(F.col(width), tile, overlap).alias("xs"), tile_starts(F.col(height), tile, overlap).alias("ys"))
    tiles = grid.select(row_id, width, height, "xs", F.posexplode("ys").alias("r", "offset_y")).select(
        row_id, width, height, F.size("xs").alias("columns"), "r", "offset_y", F.posexplode("xs").alias("c", "offset_x")
    )
    index = F.col("r") * F.col("columns") + F.col("c")
    return tiles.select(
        row_id, index.cast("long").alias("tile_index"), "offset_x", "offset_y", F.least(F.lit(tile), F.col(width) - F.col("offset_x")).cast("int").alias("tile_width"),
        F.least(F.lit(tile), F.col(height) - F.col("offset_y")).cast("int").alias("tile_height"), F.floor(index / shard).cast("long").alias("shard"),
    )


def even_parts(df: DataFrame, row_id: str, size: str, n: str) -> DataFrame:
    """A size cut into n parts at i * size // n: row id, part (from 0), x0, x1."""
    spread = df.select(row_id, F.col(size).alias("__s"), F.col(n).alias("__n"), F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("part"))
    at = lambda i: F.floor(i * F.col("__s") / F.col("__n")).cast("long")
    return spread.select(row_id, "part", at(F.col("part")).alias("x0"), at(F.col("part") + 1).alias("x1"))


def pixel_window(low: Column, high: Column, per_unit: float, size: int) -> list[Column]:
    """First and last pixel of a range, half to even, clamped to the raster."""
    place = lambda c: F.least(F.lit(size), F.greatest(F.lit(0.0), F.rint(c * per_unit))).cast("int")
    return [place(low).alias("first"), place(high).alias("last")]
