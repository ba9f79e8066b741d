"""Ranks and neighbours in a total order without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut, small


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add each row's rank (from 1) in the order, which must be total.

    Rows are range-partitioned by the order and numbered in their partition; the partitions' row counts, one
    number each, give the offsets. The partitioned rows are checkpointed, as both uses must see the same ranges.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(
        F.col("__part").alias("__p"),
        (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"),
    )
    inside = placed.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return (
        inside.join(F.broadcast(before), F.col("__part") == F.col("__p"))
        .withColumn(name, (F.col("__in") + F.col("__before")).cast("long"))
        .drop("__part", "__in", "__p", "__before")
    )


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add running sums inside each key (or over all rows) in a total order, the row's own value included.

    Rows are dealt by ranges of (keys, order), so that a key with many rows is spread over tasks. What is carried
    over from range to range is one row for each range at most. No key may be null.
    """
    placed = cut(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("__part", *keys).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    if keys:
        goes_on = totals.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*keys)
        totals = totals.join(goes_on, keys, "left_semi")
    carried = totals.select("__part", *keys, *[F.sum(f"__{n}").over(earlier).alias(f"__{n}") for n in sums])
    both = placed.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(carried), ["__part", *keys], "left")
    return both.withColumns({n: F.coalesce(n, F.lit(0)) + F.coalesce(f"__{n}", F.lit(0)) for n in sums}).select(*df.columns, *sums)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (attempts, creation times, ids)."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def top_n_truncated(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows, each with a flag whether there were more: one row too many is fetched to tell."""
    first = df.orderBy(*order).limit(n + 1)
    # n + 1 rows at most: the window is over what a page holds.
    window = Window.orderBy(*order)
    numbered = first.withColumn("position", F.row_number().over(window).cast("long"))
    return numbered.withColumn("truncated", F.max("position").over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > n).where(F.col("position") <= n)


def page_with_total(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of rows, each with the number of rows there are in all."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def round_robin(df: DataFrame, owner: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows when owners take turns, each with its own rows in order."""
    turn = F.row_number().over(Window.partitionBy(owner).orderBy(*order)).cast("long")
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", owner).limit(n)


def evenly_spaced(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """k rows at the distinct positions round(i (n - 1) / (k - 1)), half to even, of the ordered rows."""
    ranked = global_rank(df, order, "position").withColumn("position", F.col("position") - 1)
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    if k == 1:
        wanted = n.select(F.lit(0).cast("long").alias("wanted"))
    else:
        wanted = n.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"), "n").select(
            F.rint(F.col("i") * (F.col("n") - 1) / (k - 1)).cast("long").alias("wanted")
        )
    return ranked.join(small(wanted.distinct(), k), F.col("position") == F.col("wanted")).drop("wanted")


def weighted_sample(df: DataFrame, row_id: str, weight: str, k: int, seed: int) -> DataFrame:
    """k rows drawn without replacement, likelier by weight: the largest log(weight) + Gumbel noise, ties by id.

    The noise is a hash of seed and id, so a row's key depends on nothing else; rows without weight are never
    drawn. Top k is one partial top k for each task.
    """
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string"))), 1, 12)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 2.0**48
    key = F.log(F.col(weight).cast("double")) - F.log(-F.log(uniform))
    return df.where(F.col(weight) > 0).withColumn("key", key).orderBy(F.desc("key"), F.asc(row_id)).limit(k)


def bounded_history(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark drops the rest in each task before it shuffles."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def overlap_flags(df: DataFrame, keys: list[str], start: str, stop: str, row_id: str) -> DataFrame:
    """Add `overlaps`: whether an interval starts before or where the one before it in its key's order stops; both ends belong to it."""
    before = F.lag(stop).over(Window.partitionBy(*keys).orderBy(start, stop, row_id))
    return df.withColumn("overlaps", F.coalesce(F.col(start) <= before, F.lit(False)))


def best_grid(df: DataFrame, key: str, cells: Column, most_rows: int) -> DataFrame:
    """For each row the grid of at least so many cells that is nearest to a square, then smallest, then lowest."""
    tried = df.select(key, cells.alias("__n"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(most_rows).cast("long"))).alias("rows"))
    tried = tried.withColumn("cols", F.ceil(F.col("__n") / F.col("rows")).cast("long"))
    best = tried.groupBy(key).agg(F.min(F.struct(F.abs(F.col("rows") - F.col("cols")).alias("p"), (F.col("rows") * F.col("cols")).alias("c"), "rows", "cols")).alias("b"))
    return best.select(key, "b.rows", "b.cols")
