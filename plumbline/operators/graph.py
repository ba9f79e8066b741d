"""Graphs as edge tables: reachability, cycles, releases, components, suppression."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Edges that one task scans at most when a matching ends.
SCANNED_EDGES = 100_000


def reachable(edges: DataFrame, roots: DataFrame, src: str, dst: str) -> DataFrame:
    """Nodes that can be reached from the roots (`node`), with the fewest steps (`depth`): breadth-first."""
    found = cut(roots.select(F.col(roots.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0)))
    steps = edges.select(F.col(src).alias("__src"), F.col(dst).alias("__dst"))
    front, depth = found, 0
    while True:
        depth += 1
        ahead = front.join(steps, F.col("node") == F.col("__src")).select(F.col("__dst").alias("node")).distinct()
        front = cut(ahead.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            return found
        found = cut(found.unionByName(front))


def unreachable(nodes: DataFrame, node: str, edges: DataFrame, roots: DataFrame, src: str, dst: str) -> DataFrame:
    """Mark and sweep: rows of `nodes` that no root reaches."""
    return nodes.join(reachable(edges, roots, src, dst).select(F.col("node").alias(node)), node, "left_anti")


def in_cycles(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Nodes left when nodes without incoming or without outgoing edges are peeled off again and again.

    There are none exactly if the graph has no cycle; what is left lies on cycles or between them.
    """
    left = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct())
    n = left.count()
    while n:
        inner = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        inner = inner.join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        left = cut(inner)
        now = left.count()
        if now == n:
            break
        n = now
    return left.select(F.col("a").alias("node")).union(left.select("b")).distinct()


def components(nodes: DataFrame, node: str, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Each node with the smallest node of its connected component: labels spread and are shortened in turn."""
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    both = cut(pairs.union(edges.select(F.col(dst), F.col(src))).distinct())
    labels = cut(nodes.select(F.col(node).alias("node"), F.col(node).alias("component")).distinct())
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("was"), F.least("component", "m").alias("now"))
        up = labels.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
        after = cut(lower.join(up, F.col("now") == F.col("__n"), "left").select("node", "was", F.least("now", "__c").alias("component")))
        labels = after.select("node", "component")
        if not after.where("was <> component").limit(1).count():
            return labels


def suppress(items: DataFrame, item: str, rank: str, pairs: DataFrame) -> DataFrame:
    """Greedy suppression: in rank order an item is kept unless a kept one before it is its duplicate.

    `pairs` (a, b) are duplicates in either direction. Instead of a sequential scan, each round keeps all
    items without an earlier duplicate that is still there, and drops their duplicates.
    """
    ranks = items.select(F.col(item).alias("id"), F.col(rank).alias("r"))
    both = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct()
    first = both.join(ranks.withColumnsRenamed({"id": "a", "r": "ra"}), "a").join(ranks.withColumnsRenamed({"id": "b", "r": "rb"}), "b")
    edges = cut(first.where("ra < rb").select(F.col("a").alias("before"), F.col("b").alias("id")))
    # Items without any earlier duplicate are kept; only the others take part in the rounds.
    left = cut(edges.select("id").distinct())
    dropped = left.limit(0)
    while left.limit(1).count():
        blocked = edges.select("id").distinct()
        free = edges.select(F.col("before").alias("id")).distinct().join(blocked, "id", "left_anti")
        out = cut(edges.join(free.withColumnRenamed("id", "before"), "before", "left_semi").select("id").distinct())
        dropped = dropped.union(out)
        # Neither what a dropped item suppressed nor what suppressed it counts any more.
        edges = edges.join(out, "id", "left_anti").join(out.withColumnRenamed("id", "before"), "before", "left_anti")
        edges = cut(edges.select("before", "id"))
        left = edges.select("id")
    gone = dropped.distinct().withColumnRenamed("id", "__gone")
    return items.join(gone, F.col(item) == F.col("__gone"), "left").withColumn("kept", F.col("__gone").isNull()).drop("__gone")


def _scanned(group: pd.DataFrame) -> pd.DataFrame:
    """The pairs that a greedy scan in (cost, a, b) order is sure to pick among a block's edges.

    An edge that leaves the block may or may not be picked: from its turn on its end here is in doubt, and so are both
    ends of an edge with an end in doubt. Doubt ends where the node is picked before.
    """
    group = group.sort_values(["cost", "a", "b"], kind="stable")
    used, doubt, picked = set(), set(), []
    for place, (a, b, inner) in enumerate(zip(group["a"].tolist(), group["b"].tolist(), group["inner"].tolist(), strict=True)):
        if a in used or b in used:
            continue
        if not inner or a in doubt or b in doubt:
            doubt.update((a, b))
        else:
            used.update((a, b))
            picked.append(place)
    return group.iloc[picked][["a", "b", "cost"]]


def greedy_matching(edges: DataFrame, a: str, b: str, cost: str, span: int | None = None) -> DataFrame:
    """Disjoint pairs as a greedy scan in (cost, a, b) order picks them.

    Where nodes are numbers and most edges join near ones, `span` numbers make a block; a task scans a block's edges and
    picks those that no edge out of the block can change. Else, or where that picks none, a round picks all edges that come
    first at both of their ends, which the scan picks whatever else there is. Either way their ends leave, and
    the last `SCANNED_EDGES` edges are one block. Self-edges and repeats of a pair go first.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    left = edges.where(F.col(a) != F.col(b)).select(low.alias("a"), high.alias("b"), F.col(cost).alias("cost"))
    left = cut(left.groupBy("a", "b").agg(F.min("cost").alias("cost")))
    picked, n, turn, blocks = [left.limit(0)], left.count(), 0, span is not None
    while n:
        if n <= SCANNED_EDGES:
            picked.append(cut(left.withColumns({"inner": F.lit(True), "block": F.lit(0)}).groupBy("block").applyInPandas(_scanned, left.schema)))
            break
        if blocks:
            # Every other round the borders are in the middle of the blocks before.
            at = lambda c: F.floor((F.col(c) + turn % 2 * (span // 2)) / span)  # noqa: E731, B023
            dealt = left.withColumn("inner", at("a") == at("b")).withColumn("block", F.explode(F.array_distinct(F.array(at("a"), at("b")))))
            both = cut(dealt.groupBy("block").applyInPandas(_scanned, left.schema))
        else:
            ends = left.select(F.col("a").alias("node"), F.struct("cost", "a", "b").alias("e")).union(left.select("b", F.struct("cost", "a", "b")))
            first = ends.groupBy("node").agg(F.min("e").alias("e"))
            both = cut(first.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("e.a", "e.b", "e.cost"))
        picked.append(both)
        used = both.select(F.col("a").alias("__u")).union(both.select("b"))
        left = left.join(used, F.col("a") == F.col("__u"), "left_anti").join(used, F.col("b") == F.col("__u"), "left_anti")
        left, before = cut(left), n
        n = left.count()
        turn, blocks = turn + 1, span is not None and n < before
    return reduce(DataFrame.union, picked)


def ancestors(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """All (node, ancestor) pairs of an acyclic graph, by doubling paths: as many rounds as the depth has bits."""
    pairs = cut(edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).distinct())
    n = pairs.count()
    while True:
        longer = pairs.join(pairs.withColumnsRenamed({"node": "__m", "ancestor": "__a"}), F.col("ancestor") == F.col("__m"))
        pairs = cut(pairs.union(longer.select("node", "__a")).distinct())
        now = pairs.count()
        if now == n:
            return pairs
        n = now
