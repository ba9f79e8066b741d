"""Read models: searches, roll-ups, set reports and overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut
from .ranking import global_rank


def feature_search(
    df: DataFrame,
    query: str | None = None,
    text_cols: tuple[str, ...] = (),
    equal: dict | None = None,
    one_of: dict | None = None,
    at_least: dict | None = None,
    present: dict | None = None,
    box: tuple[str, str, tuple[float, float, float, float]] | None = None,
) -> DataFrame:
    """Optional predicates joined by AND; the text query is one ILIKE for each column, joined by OR.

    `%` and `_` in the query keep their meaning. `present` maps a column to whether it must be non-null.
    `box` names an x and a y column and west, south, east, north, all inclusive.
    """
    tests: list[Column] = []
    if query:
        tests.append(reduce(Column.__or__, [F.col(c).ilike(f"%{query}%") for c in text_cols]))
    tests += [F.col(c) == v for c, v in (equal or {}).items()]
    tests += [F.col(c).isin(*v) for c, v in (one_of or {}).items()]
    tests += [F.col(c) >= v for c, v in (at_least or {}).items()]
    tests += [F.col(c).isNotNull() if v else F.col(c).isNull() for c, v in (present or {}).items()]
    if box:
        x, y, (west, south, east, north) = box
        tests.append(F.col(x).between(west, east) & F.col(y).between(south, north))
    return reduce(DataFrame.where, tests, df)


def folded_contains(df: DataFrame, cols: list[str], needle: str) -> DataFrame:
    """Rows whose columns, joined by spaces, hold the needle whatever its case; no wildcards."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *cols)), F.lit(needle.lower())))


#: Rows, and then digests, that one digest of `revision_hash` folds.
FOLD = 1000


def revision_hash(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """A SHA-256 of each key's rows, folded in order (a total one): equal exactly if the rows are.

    Runs of `FOLD` rows are folded into a digest each, runs of `FOLD` digests again, until a key has one; so no
    key's rows meet in one task.
    """
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    ranked = global_rank(df.select(F.col(key).alias("k"), F.col(order).alias("o"), text.alias("s")), [F.col("k"), F.col("o")], "r")
    firsts = cut(ranked.groupBy("k").agg(F.min("r").alias("first"), F.count(F.lit(1)).alias("n_rows")))
    level = ranked.join(firsts.withColumnRenamed("k", "f"), F.col("k").eqNullSafe(F.col("f"))).select("k", (F.col("r") - F.col("first")).alias("at"), "s", F.lit(False).alias("folded"))
    while True:
        runs = level.groupBy("k", F.floor(F.col("at") / FOLD).cast("long").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "s", "folded"))).alias("rows"))
        whole = F.sha2(F.array_join(F.transform("rows", lambda r: r["s"]), "|"), 256)
        alone = (F.size("rows") == 1) & F.element_at("rows", 1)["folded"]
        level = cut(runs.select("k", "at", F.when(alone, F.element_at("rows", 1)["s"]).otherwise(whole).alias("s"), F.lit(True).alias("folded")))
        if not level.where("at > 0").limit(1).count():
            break
    hashed = level.select(F.col("k").alias(key), F.col("s").alias("revision"))
    return hashed.join(firsts, F.col(key).eqNullSafe(F.col("k"))).select(key, "revision", "n_rows")


def storage_totals(parts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One row: the sum over each table, 0 where it has none, and the total."""
    sums = [df.agg(F.coalesce(F.sum(value), F.lit(0)).alias(name)) for name, (df, value) in parts.items()]
    row = reduce(lambda a, b: a.crossJoin(b), sums)  # single rows
    return row.withColumn("total", reduce(Column.__add__, [F.col(n) for n in parts]))


def set_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, as `missing` (expected alone) or `unexpected`."""
    a, b = expected.select(key).distinct(), actual.select(key).distinct()
    missing = a.join(b, key, "left_anti").withColumn("status", F.lit("missing"))
    return missing.unionByName(b.join(a, key, "left_anti").withColumn("status", F.lit("unexpected")))


def key_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Added, removed and changed keys between two versions of a map."""
    a = old.select(key, F.col(value).alias("old_value"), F.lit(True).alias("in_old"))
    b = new.select(key, F.col(value).alias("new_value"), F.lit(True).alias("in_new"))
    both = a.join(b, key, "full_outer").where(~F.col("old_value").eqNullSafe(F.col("new_value")) | F.col("in_old").isNull() | F.col("in_new").isNull())
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed")
    return both.select(key, "old_value", "new_value", change.alias("change"))


def overlay_last_wins(layers: list[DataFrame], key: str) -> DataFrame:
    """Union of layers in which a key's row comes from the last layer that has it."""
    ranked = [df.withColumn("layer", F.lit(i)) for i, df in enumerate(layers)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    top = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("layer")))
    return every.withColumn("__rn", top).where("__rn = 1").drop("__rn")


def append_with_limit(first: DataFrame, second: DataFrame, order: list[str], limit: int) -> DataFrame:
    """All of `first`, then of `second` what the limit leaves room for."""
    both = first.withColumn("tier", F.lit(0)).unionByName(second.withColumn("tier", F.lit(1)))
    return both.orderBy("tier", *order).limit(limit)


def unambiguous_lookup(df: DataFrame, row_id: str, keys: list[Column]) -> DataFrame:
    """A row for each key that names exactly one row id; keys that several rows share are dropped."""
    spread = df.select(F.col(row_id), F.explode(F.array_distinct(F.array(*keys))).alias("lookup")).where("lookup IS NOT NULL")
    named = spread.groupBy("lookup").agg(F.min(row_id).alias(row_id), F.max(row_id).alias("__other"))
    return named.where(F.col(row_id) == F.col("__other")).drop("__other")


def longest_prefix(df: DataFrame, path: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Each row with the longest of the prefixes that is one of its path's ancestors, or null."""
    parts = F.split(F.col(path), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    spread = df.select(path).distinct().withColumn("__a", F.explode(ancestors))
    found = spread.join(prefixes.select(F.col(prefix).alias("__a")).distinct(), "__a").groupBy(path).agg(F.max_by("__a", F.length("__a")).alias(prefix))
    return df.join(found, path, "left")


def relational_division(needs: DataFrame, has: DataFrame, owner: str, item: str) -> DataFrame:
    """Owners all of whose needed items are there."""
    there = needs.join(has.select(item).distinct().withColumn("__ok", F.lit(1)), item, "left")
    counts = there.groupBy(owner).agg(F.count(F.lit(1)).alias("n_needed"), F.count("__ok").alias("n_there"))
    return counts.where("n_needed = n_there").select(owner, "n_needed")


def refresh_generation(old: DataFrame, new: DataFrame, key: str, generation: int) -> DataFrame:
    """Soft delete and insert: live old rows whose key is in the new ones are marked as deleted by the generation."""
    hit = new.select(F.col(key).alias("__k")).distinct()
    live = F.col("deleted_by").isNull() & F.col("__k").isNotNull()
    marked = old.join(hit, F.col(key) == F.col("__k"), "left").withColumn("deleted_by", F.when(live, F.lit(generation).cast("long")).otherwise(F.col("deleted_by"))).drop("__k")
    added = new.withColumn("deleted_by", F.lit(None).cast("long")).withColumn("generation", F.lit(generation))
    return marked.unionByName(added)


def browse_rollup(df: DataFrame, path: str, prefix: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Entries right below a prefix: how many files each holds, and how many with one of the suffixes."""
    rest = F.substring(F.col(path), len(prefix) + 1, 1_000_000)
    entry = F.element_at(F.split(rest, "/"), 1)
    wanted = F.lower(F.col(path)).rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    below = df.where(F.col(path).startswith(prefix)).withColumn("entry", entry)
    return below.groupBy("entry").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(wanted).alias("n_wanted"), F.bool_or(F.contains(rest, F.lit("/"))).alias("is_folder"))


def identical_content(df: DataFrame, name: str, content: str) -> DataFrame:
    """One row for each name: its hash, how many files have it, and whether they differ."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    return df.groupBy(name).agg(F.min(digest).alias("sha256"), F.count(F.lit(1)).alias("n_files"), (F.min(digest) != F.max(digest)).alias("conflict"))


def gate_checks(row: DataFrame, checks: dict[str, tuple[str, str, float]]) -> DataFrame:
    """A row for each named check (column, `>=` or `<=`, limit) with its value, whether it passed, and whether all did.

    A missing value fails.
    """
    named = [
        F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("actual"), F.lit(limit).alias("limit"), F.coalesce(F.col(c) >= limit if op == ">=" else F.col(c) <= limit, F.lit(False)).alias("passed"))
        for n, (c, op, limit) in checks.items()
    ]
    every = F.forall(F.array(*named), lambda s: s["passed"])
    return row.withColumn("accepted", every).select("accepted", F.inline(F.array(*named)))
