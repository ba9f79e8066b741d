"""Mixing sources to target weights by capped water-filling.

Each source is to hold a share of the mix given by its weight. A source cannot be repeated more than
`max_epochs` times; what it cannot supply is shared again among the others by weight, until no source
is above its cap. Whole repetitions of a source take every document; the fractional rest takes documents
in the order of a seeded hash, the last of them in part, so that each source meets its target to a word.

Nothing passes through one task or the driver but a few sums: the water level is found from aggregates
over one row for each source, and the fractional cut of a source from sums over 256 hash buckets, then over
as many buckets of the one that holds the cut, and so on until few rows are left. Words are counted and cut by
built-in functions.

Defined results: a null or empty text has size 0 and takes 0 words. A null source is a source of its own,
after all others. A null id is hashed as the text `null`. Rows alike in source, id and size share what is
left at the cut equally, rounded down. A source without a weight is left out of the mix; a size of 0 of a
whole source gives it the target 0. Texts may have any length. Empty input gives an empty result. Columns of
the documents keep their names, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, SPACES, WORD, global_rank, saved

#: At most this many sources are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Documents of the last bucket that holds a source's cut, at most (but for documents alike in hash).
BUCKET_ROWS = 2_000
#: Hex digits by which buckets are refined at a time: 256 buckets.
DIGITS = 2
#: Hex digits of a document's hash.
KEY_DIGITS = 32


def cycled_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weigh sources 1, 2, ..., `cycle`, repeating, in code-point order with null last."""
    ranked = global_rank(sources.select("source"), [F.col("source").asc_nulls_last()], "rank")
    return ranked.select("source", ((F.col("rank") - 1) % cycle + 1).cast("long").alias("weight"))


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Add `target` to one row for each source (source, weight, source_size).

    The level only rises, and a source once clamped stays so; each round is one aggregate whose few
    sums reach the driver.
    """
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        at_cap = cap < F.lit(level) * F.col("weight")
        n, held, free = sources.agg(
            F.coalesce(F.sum(at_cap.cast("long")), F.lit(0)),
            F.coalesce(F.sum(F.when(at_cap, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0)),
        ).first()
        if n == clamped or not free:
            break
        level, clamped = (total - held) / free, n
    return sources.withColumn(
        "target",
        F.when(cap < F.lit(level) * F.col("weight"), cap.cast("double")).otherwise(F.lit(level) * F.col("weight")),
    )


def _key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))))


def source_plan(sized: DataFrame, weights: DataFrame | None, max_epochs: int) -> DataFrame:
    """One row for each source: its size, target, whole repetitions and the place of its fractional cut.

    `sized` has mix_source, mix_id, mix_size and mix_key for each document.
    """
    totals = saved(
        sized.groupBy(F.col("mix_source").alias("source")).agg(F.sum("mix_size").alias("source_size")), "mix-sources"
    )
    if weights is None:
        weights = cycled_weights(totals)
    weighed = totals.join(
        weights.select(F.col("source").alias("w_source"), "weight"), F.col("source").eqNullSafe(F.col("w_source")), "left"
    ).drop("w_source")
    weighed = weighed.withColumn("weight", F.coalesce("weight", F.lit(0)))
    filled = water_fill(saved(weighed, "mix-weights"), max_epochs)
    words = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    plan = filled.withColumn("whole", whole.cast("long")).withColumn("extra", (words - F.col("whole") * F.col("source_size")).cast("long"))
    plan = saved(plan, "mix-targets")
    cuts = cut_buckets(sized, plan)
    same = F.col("mix_source").eqNullSafe(F.col("c_source")) & F.col("mix_key").startswith(F.col("c_bucket"))
    inside = sized.join(bounded_broadcast(cuts), same)
    ties = (
        inside.groupBy("c_source", "extra", "before", "mix_key", "mix_id", "mix_size")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("held", F.col("n") * F.col("mix_size"))
    )
    order = Window.partitionBy("c_source").orderBy("mix_key", "mix_id", "mix_size")
    prior = F.col("before") + F.coalesce(F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (
        ties.withColumn("prior", prior)
        .where((F.col("prior") <= F.col("extra")) & (F.col("extra") < F.col("prior") + F.col("held")))
        .select(
            "c_source",
            F.col("mix_key").alias("cut_key"),
            F.col("mix_id").alias("cut_id"),
            F.col("mix_size").alias("cut_size"),
            F.floor((F.col("extra") - F.col("prior")) / F.col("n")).cast("long").alias("cut_words"),
        )
    )
    return plan.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")


def cut_buckets(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """The bucket of hashes that holds each source's cut, and the words before it: c_source, extra, c_bucket, before.

    Each round splits the buckets at hand into `16 ** DIGITS`; one number of it reaches the driver.
    """
    cuts = plan.select(F.col("source").alias("c_source"), "extra", F.lit("").alias("c_bucket"), F.lit(0).cast("long").alias("before"))
    for digits in range(DIGITS, KEY_DIGITS + 1, DIGITS):
        same = F.col("mix_source").eqNullSafe(F.col("c_source")) & F.col("mix_key").startswith(F.col("c_bucket"))
        finer = sized.join(bounded_broadcast(cuts), same).groupBy("c_source", "extra", "before", F.substring("mix_key", 1, digits).alias("bucket"))
        finer = finer.agg(F.sum("mix_size").alias("held"), F.count(F.lit(1)).alias("n"))
        running = Window.partitionBy("c_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        finer = finer.withColumn("upto", F.col("before") + F.coalesce(F.sum("held").over(running), F.lit(0)))
        here = (F.col("upto") <= F.col("extra")) & (F.col("extra") < F.col("upto") + F.col("held"))
        found = saved(finer.where(here).select("c_source", "extra", F.col("bucket").alias("c_bucket"), F.col("upto").alias("before"), "n"), "mix-buckets")
        cuts = found.drop("n")
        if (found.agg(F.max("n")).first()[0] or 0) <= BUCKET_ROWS:
            break
    return cuts


def bounded_broadcast(table: DataFrame) -> DataFrame:
    """Broadcast a table with a row for each source while there are few enough sources."""
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return F.broadcast(table)
    return table


def with_sources(sized: DataFrame, plan: DataFrame) -> DataFrame:
    return sized.join(bounded_broadcast(plan), F.col("mix_source").eqNullSafe(F.col("source")))


def _taken() -> Column:
    here = F.struct("mix_key", F.coalesce("mix_id", F.lit(-(2**63))), "mix_size")
    cut = F.struct("cut_key", F.coalesce("cut_id", F.lit(-(2**63))), "cut_size")
    part = (
        F.when(F.col("cut_key").isNull(), 0)
        .when(here < cut, F.col("mix_size"))
        .when(here == cut, F.col("cut_words"))
        .otherwise(0)
    )
    return (F.col("whole") * F.col("mix_size") + part).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    return [
        F.col(f"`{source_col}`").cast("string").alias("mix_source"),
        F.col(f"`{id_col}`").cast("long").alias("mix_id"),
        word_count(F.col(f"`{text_col}`")).alias("mix_size"),
        _key(id_col, seed).alias("mix_key"),
    ]


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null. Each word becomes one mark, and the marks are counted."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), SPACES, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text with the white space before and between them."""
    words = F.regexp_extract_all(text, F.lit(f"([{SPACE}]*{WORD})"), 1)
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")


def mix_counts(
    docs: DataFrame,
    weights: DataFrame | None = None,
    max_epochs: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """For each document: its size, its source's size and target, and the words that the mix takes of it.

    `weights` (source, weight) may name any weights; without it sources weigh 1, 2, 3, repeating.
    """
    sized = saved(docs.select(*_sized(docs, id_col, text_col, source_col, seed)), "mix-sizes")
    plan = saved(source_plan(sized, weights, max_epochs), "mix-plan")
    return with_sources(sized, plan).select(
        F.col("mix_id").alias("doc_id"),
        F.col("mix_size").alias("size"),
        "source",
        "weight",
        "source_size",
        "target",
        _taken().alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    weights: DataFrame | None = None,
    max_epochs: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself, with the columns of `docs`: a row for each repetition of a document.

    The document at a source's cut is repeated last with its first words only.
    """
    sized = saved(docs.select(*_sized(docs, id_col, text_col, source_col, seed)), "mix-sizes")
    plan = saved(source_plan(sized, weights, max_epochs), "mix-plan")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *_sized(docs, id_col, text_col, source_col, seed))
    taken = with_sources(whole, plan).select("doc", "mix_size", _taken().alias("taken"))
    last = F.col("taken") % F.nullif("mix_size", F.lit(0))
    rows = taken.where(F.col("taken") > 0).select(
        "doc",
        "mix_size",
        F.explode(
            F.concat(
                F.array_repeat(F.col("mix_size"), F.floor(F.col("taken") / F.col("mix_size")).cast("int")),
                F.when(last > 0, F.array(last)).otherwise(F.array().cast("array<bigint>")),
            )
        ).alias("n"),
    )
    whole_text = F.col(f"doc.`{text_col}`")
    text = F.when(F.col("n") == F.col("mix_size"), whole_text).otherwise(first_words(whole_text, F.col("n")))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.length(text).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"doc.`{c}`").alias(c))
    return rows.select(*out)

