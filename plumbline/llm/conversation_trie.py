"""A prefix trie over conversations: one row for each distinct sequence of first turns.

The digest of a prefix is a sum over its turns of numbers drawn from (position, role, text) by SHA-256, in four
lanes of 32 bits that add up without overflow. Sums need no order of evaluation, so the prefixes of one very
long conversation are made by many tasks. The smallest conversation that begins with a prefix owns its node. Who
owns a node owns all that follows on its way, so each conversation has a first owned depth, found by binary
search: in each round all conversations still in question look up one prefix each in the minima of digests. The
rounds go by falling powers of two, and a round of 2^k meets only prefixes whose depth that power divides and no
higher one, so all rounds together read each prefix once. What a conversation owns is a chain of nodes, which
hangs from the node before its first. Chains are aggregated from their ends upwards: inside by running sums, and a
chain's total goes to every node above it, the unowned prefixes of its conversation, with partial sums in each task.

Defined results: an empty table has no node. Rows with a null conversation belong to none and are left out. Turns
are ordered by turn, null first; equal turns by role, then text, and rows alike in all stay as so many turns. A
null role or text counts as empty. Texts of any length are digested whole. Columns beyond those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, frees, saved

#: Conversations of one block share the first turns of its first conversation, up to so many less one.
BLOCK = 20
SHARED = 4
#: Ids that are joined before they are hashed, at most.
CHUNK = 50_000
EMPTY_SHA256 = hashlib.sha256().hexdigest()

_LANES = range(4)


def _running(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add running sums inside each key, in order, the row's own value included.

    Rows are dealt by ranges of (key, order), so that a key with many rows is spread over tasks. Only a key that
    goes on from one range to the next has something carried over: one row for each range at most.
    """
    placed = saved(df.repartitionByRange(F.col(key), *order).withColumn("__part", F.spark_partition_id()), "trie-ranges")
    inside = Window.partitionBy("__part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("__part", key).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    over = totals.groupBy(key).agg(F.count(F.lit(1)).alias("__parts")).where("__parts > 1").select(key)
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.join(over, key, "left_semi").select("__part", key, *[F.sum(f"__{n}").over(earlier).alias(f"__{n}") for n in sums])
    both = placed.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(carried), ["__part", key], "left")
    return both.withColumns({n: F.col(n) + F.coalesce(f"__{n}", F.lit(0)) for n in sums}).select(*df.columns, *sums)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text of every turn."""
    rows = conversations.select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).where("conv_id IS NOT NULL")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return _running(rows, "conv_id", order, {"pos": F.lit(1).cast("long")}).select("conv_id", "pos", "role", "text")


def shared_starts(turns: DataFrame, block: int = BLOCK, shared: int = SHARED) -> DataFrame:
    """Conversations that begin with the first turns of the first conversation of their block.

    `turns` has conv_id, pos, role, text. A conversation c takes the first h = crc32(c) % `shared` turns of
    conversation c - c % `block`, then its own after its first h. Turns come back as conv_id, depth, role, text.
    """
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    head = turns.where(F.col("pos") < shared)
    # Spark's % keeps the sign, so a block's first conversation is the multiple next to zero.
    base = head.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    convs = turns.groupBy("conv_id").agg(F.first("pos").alias("any")).select("conv_id", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    starts = convs.join(base, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "role", "text")
    length = base.groupBy("base").agg(F.max("pos").alias("n"))
    short = convs.join(length, "base", "left").select("conv_id", (F.col("h") - F.least("h", F.coalesce("n", F.lit(0)))).alias("less")).where("less > 0")
    own = turns.where(F.col("pos") > taken).join(short, "conv_id", "left")
    return starts.unionByName(own.select("conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("depth"), "role", "text"))


def _prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every prefix of every conversation: conv_id, depth, node, parent, words of its last turn, power of two in its depth."""
    drawn = F.sha2(F.concat_ws(":", F.col("depth"), F.length("role"), "role", "text").cast("binary"), 256)
    lanes = [F.conv(F.substring(drawn, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"turn{i}") for i in _LANES]
    rows = turns.select("conv_id", "depth", *lanes, F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    summed = _running(rows, "conv_id", [F.col("depth")], {f"s{i}": F.col(f"turn{i}") for i in _LANES})

    def digest(depth: Column, sums: list[Column]) -> Column:
        return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))

    power = F.length(F.regexp_extract(F.bin("depth"), "0*$", 0))
    zero = F.lit(0).cast("long")
    later = summed.select(
        "conv_id", "depth", digest(F.col("depth"), [F.col(f"s{i}") for i in _LANES]).alias("node"),
        digest(F.col("depth") - 1, [F.col(f"s{i}") - F.col(f"turn{i}") for i in _LANES]).alias("parent"), "words", power.alias("power"),
    )
    first = convs.select("conv_id", zero.alias("depth"), digest(zero, [zero] * 4).alias("node"), F.lit(None).cast("binary").alias("parent"), zero.alias("words"), F.lit(-1).alias("power"))
    return later.unionByName(first)


def _first_owned(prefixes: DataFrame, minima: DataFrame) -> DataFrame:
    """conv_id and the depth from which on it is the smallest of its prefixes' conversations; one past its end if it never is."""
    at_root = prefixes.where("depth = 0").select("conv_id", "node").join(minima.where("power = -1").select("node", "owner"), "node")
    known = saved(at_root.select("conv_id", F.when(F.col("owner") < F.col("conv_id"), 0).otherwise(-1).cast("long").alias("unowned")), "trie-search")
    deepest = minima.agg(F.max("depth")).first()[0] or 0
    for k in range(deepest.bit_length() - 1, -1, -1):
        wanted = known.where("unowned >= 0").select("conv_id", (F.col("unowned") + (1 << k)).alias("depth"))
        probe = prefixes.where(F.col("power") == k).join(wanted, ["conv_id", "depth"]).select("conv_id", "depth", "node")
        found = probe.join(minima.where(F.col("power") == k).select("node", "owner"), "node").where("owner < conv_id")
        known = known.join(found.select("conv_id", F.col("depth").alias("lower")), "conv_id", "left")
        known = saved(known.select("conv_id", F.coalesce("lower", "unowned").alias("unowned")), "trie-search")
    return known.select("conv_id", (F.col("unowned") + 1).alias("first"))


def _hashed_ids(ends: DataFrame) -> DataFrame:
    """For each node the SHA-256 of its conversations' ids in numerical order, joined by commas.

    Ids are joined in chunks by tasks of even ranges; one task then hashes a node's chunks one after the other.
    """

    @frees
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []
        for batch in batches:
            for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (own != node or len(ids) == CHUNK):
                    out.append((node, ids[0], ",".join(map(str, ids)).encode()))
                    ids = []
                node = own
                ids.append(conv)
            if out:
                yield _columns(out)
                out = []
        if ids:
            yield _columns([(node, ids[0], ",".join(map(str, ids)).encode())])

    def _columns(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["node", "conv_id", "ids"])

    @frees
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            nodes, hexes = [], []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if own != node:
                    if state is not None:
                        nodes.append(node)
                        hexes.append(state.hexdigest())
                    node, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hexes, pa.string())], names=["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    chunks = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(join, "node binary, conv_id long, ids binary")
    return chunks.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(digest, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the conversations.

    `turns` has conv_id, depth (from 1, without gaps), role, text; `convs` one row conv_id for each conversation, also
    for one without turns. Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.
    """
    prefixes = saved(_prefixes(turns, convs), "trie-prefixes")
    minima = prefixes.groupBy("node").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.first("depth").alias("depth"), F.first("power").alias("power"))
    minima = saved(minima, "trie-minima")
    firsts = _first_owned(prefixes, minima)
    split = prefixes.join(firsts, "conv_id")

    # Chains: the nodes that a conversation owns.
    owned = split.where("depth >= first").join(minima.select("node", "n_convs"), "node")
    children = owned.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    chained = owned.join(children, "node", "left").select(
        "conv_id", "depth", "first", "node", "parent", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("tokens"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"),
    )
    chains = saved(_running(chained, "conv_id", [F.col("depth")], {"tokens_to": F.col("tokens"), "leaves_to": F.col("leaf")}), "trie-chains")
    totals = chains.groupBy("conv_id").agg(F.sum("tokens").alias("all_tokens"), F.sum("leaf").alias("all_leaves"))

    # From the ends upwards: what follows in the chain, and each chain's total to the nodes above it.
    inside = chains.join(totals, "conv_id").select(
        "node", (F.col("all_tokens") - F.col("tokens_to") + F.col("tokens")).alias("tokens"), (F.col("all_leaves") - F.col("leaves_to") + F.col("leaf")).alias("leaves")
    )
    above = split.where("depth < first").join(totals, "conv_id").select("node", F.col("all_tokens").alias("tokens"), F.col("all_leaves").alias("leaves"))
    subtree = inside.unionByName(above).groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("tokens").alias("saved_tokens"))

    hangs = chains.where("depth = first AND parent IS NOT NULL").join(minima.select(F.col("node").alias("parent"), F.col("owner").alias("above")), "parent").select("conv_id", "above")
    last = prefixes.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    out = chains.join(subtree, "node").join(_hashed_ids(last.select("node", "conv_id")), "node", "left").join(hangs, "conv_id", "left")
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("above"))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def shared_start_trie(conversations: DataFrame, block: int = BLOCK, shared: int = SHARED) -> DataFrame:
    """The trie of conversations rebuilt by `shared_starts`, also of those that are left without a turn."""
    turns = saved(ordered_turns(conversations), "trie-turns")
    convs = turns.groupBy("conv_id").agg(F.first("pos").alias("any")).select("conv_id")
    return prefix_trie(shared_starts(turns, block, shared), convs)
