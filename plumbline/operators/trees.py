"""Trees of tiles as tables of nodes: what is wrong with them, and which nodes to show.

No operator walks a tree from the driver. What depends on all ancestors of a node is found by doubling paths: each
node keeps a pointer and what lies between, and takes over its pointer's, so that as many joins do as the depth has bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import reachable
from .lineage import cut
from .ranking import global_rank, running_sums

#: Bytes of a pack's header, of a record, and of a pack at most.
HEADER_BYTES = 32
RECORD_BYTES = 96
MOST_PACK_BYTES = 128 << 20


def _box_is_sound(box: Column) -> Column:
    low, high = box["min"], box["max"]
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    three = (F.size(low) == 3) & (F.size(high) == 3) & F.forall(F.concat(low, high), finite)
    return F.coalesce(three & F.forall(F.arrays_zip(low.alias("a"), high.alias("b")), lambda p: p["a"] <= p["b"]), F.lit(False))


def _contains(outer: Column, inner: Column) -> Column:
    zipped = F.arrays_zip(outer["min"].alias("a"), inner["min"].alias("b"), outer["max"].alias("c"), inner["max"].alias("d"))
    return F.forall(zipped, lambda p: (p["a"] <= p["b"]) & (p["c"] >= p["d"]))


def _no(c: Column) -> Column:
    """True where the condition is false or unknown."""
    return ~F.coalesce(c, F.lit(False))


def _kinds(rules: dict[str, Column]) -> Column:
    return F.explode(F.array_compact(F.array(*[F.when(wrong, F.lit(kind)) for kind, wrong in rules.items()])))


def is_inner_path(path: Column) -> Column:
    """Whether a path names something below its folder: relative, without `.`, `..`, empty parts or backslashes."""
    parts = F.split(path, "/")
    return F.coalesce((path != "") & ~path.contains("\\") & F.forall(parts, lambda p: ~p.isin("", ".", "..")), F.lit(False))


def unreached(trees: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (tree, node) from which no way leads up to their tree's root; a node on a cycle is one of them.

    `edges` has tree, parent, node. Of several parents of a node the smallest counts. Paths double each round, so
    the joins are no more than the bits of the number of nodes, cycles or not.
    """
    parent = edges.groupBy("tree", "node").agg(F.min("parent").alias("up"))
    at_root = F.col("node") == F.col("root")
    known = nodes.select("tree", "node").distinct().join(trees.select("tree", "root"), "tree").join(parent, ["tree", "node"], "left")
    # A pointer that has arrived is `done`; one without a parent leads nowhere.
    known = cut(known.select("tree", "node", F.when(at_root, F.col("node")).otherwise(F.col("up")).alias("up"), F.coalesce(at_root, F.lit(False)).alias("done")))
    for _ in range(max(1, known.count()).bit_length() + 1):
        if not known.where("NOT done AND up IS NOT NULL").limit(1).count():
            break
        ahead = known.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("done").alias("arrives"))
        moved = known.join(ahead, ["tree", "up"], "left")
        known = cut(moved.select("tree", "node", F.when(F.col("done"), F.col("up")).otherwise(F.col("next")).alias("up"), (F.col("done") | F.coalesce("arrives", F.lit(False))).alias("done")))
    return known.where("NOT done").select("tree", "node")


def tree_violations(
    trees: DataFrame, nodes: DataFrame, packs: DataFrame, header: int = HEADER_BYTES, record: int = RECORD_BYTES, most_bytes: int = MOST_PACK_BYTES, children: int = 2
) -> DataFrame:
    """A row (tree, kind, id) for each thing that is wrong with a tree of tiles; a tree without a row is sound.

    `trees` has tree, root, records. `nodes` has tree, node, children (ids, null for a leaf), box and support (structs of
    min and max), error, records, tile and merged: where the records of a leaf, and those that stand for an inner node,
    lie (structs of pack, offset, length, records, sha256). `packs` has tree, pack, path, offset, length, records, sha256.

    Kinds of nodes: no_id, duplicate_node, children_or_tile, no_merged_tile, child_count, box, support, support_misses_box,
    records, error. Of the hierarchy: unknown_root, unknown_child, shared_child, unreachable, parent_misses_child. Of
    packs: duplicate_pack, path, pack_length, pack_offset, pack_hash. Of tiles: unknown_pack, tile_range, leaf_records,
    merged_records, gap and overlap (the tiles of a pack must cover it exactly; id is the pack), unused_pack.
    Of a whole tree: population (id is null).
    """
    leaf, inner = F.col("tile").isNotNull(), F.col("children").isNotNull()
    number = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) != float("inf"))
    own = nodes.select("tree", F.col("node").alias("id"), _kinds({
        "no_id": F.coalesce(F.col("node") == "", F.lit(True)), "children_or_tile": leaf == inner, "no_merged_tile": inner != F.col("merged").isNotNull(),
        "child_count": inner & ((F.size("children") != children) | F.exists("children", lambda c: c.isNull() | (c == ""))),
        "box": _no(_box_is_sound(F.col("box"))), "support": _no(_box_is_sound(F.col("support"))),
        "support_misses_box": _box_is_sound(F.col("box")) & _box_is_sound(F.col("support")) & ~_contains(F.col("support"), F.col("box")),
        "records": _no(F.col("records") >= 1), "error": _no(number(F.col("error")) & (F.col("error") >= 0)),
    }).alias("kind"))

    def repeated(df: DataFrame, name: str, kind: str) -> DataFrame:
        return df.groupBy("tree", F.col(name).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tree", "id", F.lit(kind).alias("kind"))

    edges = nodes.where(inner).select("tree", F.col("node").alias("parent"), F.explode("children").alias("node")).where("node IS NOT NULL")
    ids = nodes.select("tree", "node").distinct()
    unknown_child = edges.join(ids, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("id"), F.lit("unknown_child").alias("kind")).distinct()
    unknown_root = trees.select("tree", F.col("root").alias("node")).join(ids, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("id"), F.lit("unknown_root").alias("kind"))
    lost = unreached(trees, nodes, edges).select("tree", F.col("node").alias("id"), F.lit("unreachable").alias("kind"))
    supports = nodes.select("tree", "node", "support").where(_box_is_sound(F.col("support")))
    around = edges.join(supports, ["tree", "node"]).join(supports.select("tree", F.col("node").alias("parent"), F.col("support").alias("outer")), ["tree", "parent"])
    outside = around.where(~_contains(F.col("outer"), F.col("support"))).select("tree", F.col("node").alias("id"), F.lit("parent_misses_child").alias("kind"))

    of_pack = packs.select("tree", F.col("pack").alias("id"), _kinds({
        "no_id": F.coalesce(F.col("pack") == "", F.lit(True)), "path": ~is_inner_path(F.col("path")),
        "pack_length": _no((F.col("records") >= 1) & (F.col("length") <= most_bytes) & (F.col("length") == header + F.col("records") * record)),
        "pack_offset": _no(F.col("offset") == header), "pack_hash": _no(F.col("sha256").rlike("^[0-9a-f]{64}$")),
    }).alias("kind"))

    stands = lambda name, exact: nodes.where(F.col(name).isNotNull()).select("tree", F.col("node").alias("id"), F.lit(exact).alias("exact"), F.col("records").alias("of"), f"{name}.*")
    tiles = stands("tile", True).unionByName(stands("merged", False))
    stored = packs.groupBy("tree", "pack").agg(F.max("length").alias("pack_length"), F.max("records").alias("pack_records"), F.max("sha256").alias("pack_sha256"))
    placed = tiles.join(stored, ["tree", "pack"], "left")
    fits = (F.col("records") >= 1) & (F.col("records") <= F.col("pack_records")) & (F.col("offset") >= header) & ((F.col("offset") - header) % record == 0)
    fits &= (F.col("length") == F.col("records") * record) & (F.col("offset") + F.col("length") <= F.col("pack_length")) & F.col("sha256").eqNullSafe(F.col("pack_sha256"))
    of_tile = placed.select("tree", "id", _kinds({
        "unknown_pack": F.col("pack_length").isNull(), "tile_range": F.col("pack_length").isNotNull() & _no(fits),
        "leaf_records": F.col("exact") & _no(F.col("records") == F.col("of")), "merged_records": ~F.col("exact") & _no(F.col("records") <= F.col("of")),
    }).alias("kind"))

    # A pack's size bounds the rows of this window. A pack's end is one more range, of no length.
    ends = stored.select("tree", "pack", F.col("pack_length").alias("offset"), F.lit(0).cast("long").alias("length"))
    ranges = placed.where("pack_length IS NOT NULL").select("tree", "pack", "offset", "length").unionByName(ends)
    before = F.max(F.col("offset") + F.col("length")).over(Window.partitionBy("tree", "pack").orderBy("offset", "length").rowsBetween(Window.unboundedPreceding, -1))
    step = F.col("offset") - F.coalesce(before, F.lit(header))
    covered = ranges.select("tree", F.col("pack").alias("id"), F.when(step > 0, "gap").when(step < 0, "overlap").alias("kind")).where("kind IS NOT NULL").distinct()
    unused = packs.select("tree", "pack").distinct().join(tiles.select("tree", "pack").distinct(), ["tree", "pack"], "left_anti").select("tree", F.col("pack").alias("id"), F.lit("unused_pack").alias("kind"))

    held = tiles.where("exact").groupBy("tree").agg(F.sum("records").alias("held"))
    population = trees.join(held, "tree", "left").where(_no(F.col("records") == F.coalesce("held", F.lit(0)))).select("tree", F.lit(None).cast("string").alias("id"), F.lit("population").alias("kind"))

    out = own
    for more in (repeated(nodes, "node", "duplicate_node"), repeated(edges, "node", "shared_child"), unknown_root, unknown_child, lost, outside, of_pack, repeated(packs, "pack", "duplicate_pack"), of_tile, covered, unused, population):
        out = out.unionByName(more)
    return out.select("tree", "kind", "id")


def least_above(nodes: DataFrame, value: str, name: str) -> DataFrame:
    """Add the smallest value among all proper ancestors of each node (node, parent); null for the root.

    The tree must be sound. Joins are as many as its depth has bits.
    """
    own = nodes.select(F.col("node").alias("__n"), F.col(value).alias("__v"))
    known = cut(nodes.select("node", F.col("parent").alias("up")).join(own, F.col("up") == F.col("__n"), "left").select("node", "up", F.col("__v").alias("least")))
    while known.where("up IS NOT NULL").limit(1).count():
        ahead = known.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("least").alias("beyond"))
        known = cut(known.join(ahead, "up", "left").select("node", F.col("next").alias("up"), F.least("least", "beyond").alias("least")))
    return nodes.join(known.select("node", F.col("least").alias(name)), "node")


def refined_before(nodes: DataFrame, shown: DataFrame) -> DataFrame:
    """The ancestors (node) of the nodes that were shown before, which a cut keeps refined a little longer."""
    up = nodes.where("parent IS NOT NULL").select("node", "parent")
    return reachable(up, shown.join(up, "node").select("parent"), "node", "parent").select("node")


def best_cut(nodes: DataFrame, budget: int, error: float, keep_unseen: bool = False, fill_siblings: bool = False) -> DataFrame:
    """The finest cut through a tree whose records fit a budget, by one threshold of projected error for the whole tree.

    `nodes` has node, parent, visible, error, radius (pixels, as `cameras.seen` gives them), records and leaf. A
    visible inner node with (visible) children is refined while its error is above the threshold. An
    unseen branch shows nothing, or with `keep_unseen` its topmost node. If the finest cut fits, it is taken. Otherwise
    the threshold is searched by bisection among 0 and the errors of visible inner nodes, in ascending order, as for
    costs that fall with it. With `fill_siblings` leaves beside the shown ones, in order of id, are added as far as
    they fit, once no merged node is shown.

    A node is shown for thresholds from its own error (0 if it can't be refined) up to the least error above it, so
    the cost of every threshold is a running sum over the ends of these intervals. Columns: node, records, error,
    radius, exact, threshold (the one taken), limited (whether the budget forces a larger error than `error`).
    An error if even the coarsest cut is over the budget; no row if the root is unseen and nothing unseen is kept.
    """
    top = nodes.where("parent IS NULL").select("records", "visible").first()
    if top is None or not (top["visible"] or keep_unseen):
        return nodes.select("node", "records", "error", "radius", F.lit(True).alias("exact"), F.lit(0.0).alias("threshold"), F.lit(False).alias("limited")).limit(0)
    if top["records"] > budget:
        raise ValueError(f"the root alone has {top['records']} records, the budget is {budget}")
    shown = F.lit(True) if keep_unseen else F.col("visible")
    kids = nodes.where(shown & F.col("parent").isNotNull()).groupBy("parent").agg(F.count(F.lit(1)).alias("kids"))
    known = nodes.join(kids.withColumnRenamed("parent", "__p"), F.col("node") == F.col("__p"), "left").drop("__p")
    refinable = F.col("visible") & F.col("kids").isNotNull()
    # Nothing below a node that can't be refined is ever reached: its bound is below every threshold.
    known = least_above(known.withColumn("bound", F.when(refinable, F.col("error")).otherwise(-1.0)), "bound", "until")
    nothing = F.col("visible") & ~F.col("leaf") & F.col("kids").isNull()
    since, until = F.when(refinable, F.col("error")).otherwise(0.0), F.coalesce("until", F.lit(float("inf")))
    spans = known.where(shown & ~nothing).select("node", "records", "error", "radius", "leaf", "parent", since.alias("since"), until.alias("until"))
    spans = cut(spans.where("since < until"))

    def cost(threshold: float) -> int:
        return spans.where((F.col("since") <= threshold) & (F.col("until") > threshold)).agg(F.sum("records")).first()[0] or 0

    limited = False
    if cost(0.0) <= budget:
        threshold = 0.0
    else:
        limited = cost(error) > budget
        inner = nodes.where("visible AND NOT leaf AND error > 0 AND error < double('inf')").select(F.col("error").alias("at"))
        steps = spans.select(F.col("since").alias("at"), F.col("records").alias("more")).unionByName(spans.select("until", -F.col("records")).toDF("at", "more")).where("at < double('inf')")
        steps = steps.unionByName(inner.select("at", F.lit(0).cast("long").alias("more"))).unionByName(nodes.sparkSession.createDataFrame([(0.0, 0)], "at double, more long"))
        steps = steps.groupBy("at").agg(F.sum("more").alias("more"))
        costs = cut(global_rank(running_sums(steps, [], [F.col("at")], {"cost": F.col("more")}), [F.col("at")], "rank"))
        low, high, threshold = 1, costs.count(), None
        while low <= high:
            middle = (low + high) // 2
            at = costs.where(F.col("rank") == middle).first()
            if at["cost"] <= budget:
                threshold, high = at["at"], middle - 1
            else:
                low = middle + 1
        if threshold is None:
            raise ValueError("no cut fits the budget")
    chosen = spans.where((F.col("since") <= threshold) & (F.col("until") > threshold)).withColumn("exact", F.col("leaf"))
    columns = ["node", "records", "error", "radius", "exact"]
    out = chosen.select(*columns)
    if fill_siblings and not chosen.where("NOT exact").limit(1).count():
        beside = nodes.where("leaf").join(chosen.select("parent").where("parent IS NOT NULL").distinct(), "parent", "left_semi").join(chosen.select("node"), "node", "left_anti")
        out = out.unionByName(_as_fit(beside.select("node", "records", "error", "radius"), budget - cost(threshold)).withColumn("exact", F.lit(True)))
    return out.select(*columns, F.lit(threshold).alias("threshold"), F.lit(limited).alias("limited"))


def _as_fit(rows: DataFrame, room: int) -> DataFrame:
    """Rows in order of node, each taken if its records still fit.

    The scan is one task of bounded work: the rows are siblings of shown nodes, so no more than the budget has records.
    """

    def scan(batches):
        left = room
        for batch in batches:
            take = []
            for n in batch["records"]:
                take.append(n <= left)
                left -= n if n <= left else 0
            yield batch[take]

    return rows.repartition(1).sortWithinPartitions("node").mapInPandas(scan, rows.schema)
