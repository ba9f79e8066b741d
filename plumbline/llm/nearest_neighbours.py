"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is built on a bounded sample, whose size and so its leaves are in proportion to the vectors up to
that bound, and then indexes every vector: each goes to the leaf of its nearest centroids. A query walks the
tree with a priority queue, nearest branch first, and visits so many leaves as calibration found necessary:
for a set of calibration queries, which the tree was not built on, the true neighbours among all vectors are
computed, and visits are widened until the tree reaches the wanted share of them. A query whose leaves hold
too few vectors for a whole result walks on, and one that still lacks neighbours (where ids repeat) visits all.

Leaves meet the queries that visit them in a co-grouped join, the first leaves of each query before the
others, so that of the others only what is near enough comes back. Large leaves are split into chunks of
bounded size, their queries into blocks, and of vectors that are exactly alike only as many are kept as a result can
hold, so that none of them makes a group grow with the input.

Defined results: vectors that are null, empty, all zero, or hold a null or non-finite component take no part.
Vectors of different lengths have no distance: a query finds those of its own length. Ties go to the
smaller id. A query's own id is never in its result. Rows alike in id and vector count once; rows of one id
with different vectors are different queries and different candidates, so that a result can hold an id more
than once. With no more candidates than wanted neighbours all are returned. Rows with a null id take no part.
Other columns are not read, whatever their names. Empty input gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import frees, saved

#: Vectors that the tree is built on: one of `SAMPLE_EVERY`, but so many at least, and of so many numbers at most.
SAMPLE = 20_000
SAMPLE_EVERY = 50
SAMPLE_NUMBERS = 12_800_000
#: Children of a node, and sample vectors below which a node is a leaf.
BRANCHES = 8
LEAF = 48
#: Calibration queries, and the share of their true neighbours that the visited leaves must hold.
CALIBRATION = 256
RECALL = 0.95
#: Leaves visited first; what they hold bounds what is kept of the others.
FIRST = 8
#: Vectors of a leaf that meet the queries in one group, about.
CHUNK = 4096
#: Queries of a leaf that meet a chunk in one group, about.
QUERY_BLOCK = 4096


@dataclass
class Tree:
    """Nodes in one list: the centroids and numbers of a node's children, or its number as a leaf."""

    centroids: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def add(self, points: np.ndarray, rng: np.random.Generator) -> int:
        node = len(self.leaf)
        self.centroids.append(np.zeros((0, points.shape[1])))
        self.children.append([])
        self.leaf.append(-1)
        labels = _kmeans(points, BRANCHES, rng) if len(points) > LEAF else None
        parts = [points[labels == k] for k in np.unique(labels)] if labels is not None else []
        if len(parts) < 2:  # few points, or all alike
            self.leaf[node] = self.leaves
            self.leaves += 1
        else:
            self.centroids[node] = np.stack([p.mean(axis=0) for p in parts])
            self.children[node] = [self.add(p, rng) for p in parts]
        return node

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: at each node the nearest centroid."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            nearest = _squares(points[rows], self.centroids[node]).argmin(axis=1)
            todo += [(c, rows[nearest == k]) for k, c in enumerate(self.children[node]) if (nearest == k).any()]
        return out

    def visits(self, query: np.ndarray, most: int, sizes: np.ndarray | None = None, enough: int = 0) -> list[int]:
        """Leaves in best-bin-first order: `most`, and more of them until they hold `enough` vectors."""
        queue, found, held = [(0.0, 0)], [], 0
        while queue and (len(found) < most or held < enough):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
                held += enough if sizes is None else int(sizes[self.leaf[node]])
                continue
            far = np.square(self.centroids[node] - query).sum(axis=1)
            for d, child in zip(far.tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (d, child))
        return found


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1)[None] - 2 * (a @ b.T)


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    labels = np.zeros(len(points), np.int64)
    for _ in range(rounds):
        labels = _squares(points, centres).argmin(axis=1)
        centres = np.stack([points[labels == i].mean(axis=0) if (labels == i).any() else c for i, c in enumerate(centres)])
    return labels


def build_tree(points: np.ndarray, seed: int = 5) -> Tree:
    tree = Tree()
    tree.add(points, np.random.default_rng(seed))
    return tree


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dimension)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _top(ids: np.ndarray, points: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the places of the k nearest points: exact distances in double precision, ties to the smaller id."""
    for start in range(0, len(queries), 256):
        block = queries[start : start + 256]
        rough = _squares(block, points)
        slack = 1e-6 * (1 + np.square(block).sum(axis=1) + np.square(points).sum(axis=1).max())
        reach = np.partition(rough, min(k, len(points)) - 1, axis=1)[:, min(k, len(points)) - 1]
        for i in range(len(block)):
            near = np.flatnonzero(rough[i] <= reach[i] + slack[i])
            exact = np.sqrt(np.square(points[near] - block[i]).sum(axis=1))
            order = np.lexsort((ids[near], exact))[:k]
            yield start + i, near[order], exact[order]


def _calibrate(tree: Tree, candidates: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int, recall: float) -> int:
    """Leaves to visit so that the calibration queries find `recall` of their true neighbours."""
    dimension = queries.shape[1]

    @frees
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, int]]] = [[] for _ in queries]
        for batch in batches:
            ids, points = batch.column(0).to_numpy(), _matrix(batch.column(1), dimension)
            if not len(ids):
                continue
            leaf = tree.assign(points)
            for i, near, far in _top(ids, points, queries, k + 1):
                best[i] = sorted(best[i] + list(zip(far.tolist(), ids[near].tolist(), leaf[near].tolist(), strict=True)))[: k + 1]
        rows = [(i, d, v, x) for i, found in enumerate(best) for d, v, x in found]
        yield pa.RecordBatch.from_pydict(
            {"q": pa.array([r[0] for r in rows], pa.int64()), "d": pa.array([r[1] for r in rows], pa.float64()),
             "v": pa.array([r[2] for r in rows], pa.int64()), "leaf": pa.array([r[3] for r in rows], pa.int64())}
        )

    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "v"))
    rows = candidates.mapInArrow(nearest, "q long, d double, v long, leaf long").withColumn("r", rank).where(F.col("r") <= k + 1).collect()
    truth: dict[int, list[tuple[float, int, int]]] = {}
    for r in rows:
        if r["v"] != query_ids[r["q"]]:
            truth.setdefault(r["q"], []).append((r["d"], r["v"], r["leaf"]))
    at = np.zeros(tree.leaves, np.int64)
    for q, found in truth.items():
        place = {leaf: i for i, leaf in enumerate(tree.visits(queries[q], tree.leaves))}
        for _, _, leaf in sorted(found)[:k]:
            at[place[leaf]] += 1
    if not at.sum():
        return tree.leaves
    return int(np.searchsorted(np.cumsum(at) / at.sum(), recall) + 1)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    recall: float = RECALL,
    sample: int | None = None,
) -> DataFrame:
    """The k nearest vectors of each query row: query_id, rank, vec_id, score (Euclidean distance).

    Vectors have neighbours of their own length only: each length is searched by itself, one after the other.
    """
    spark = vectors.sparkSession
    rows = (
        vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"), is_query.alias("is_query"))
        .where(F.col("id").isNotNull())
        .where(usable(F.col("v")))
    )
    out = None
    for length in rows.groupBy(F.size("v").alias("n")).agg(F.count_if("is_query").alias("asked")).where("asked > 0").orderBy("n").collect():
        found = _search_length(rows.where(F.size("v") == length["n"]), length["n"], k, recall, sample)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _search_length(rows: DataFrame, dimension: int, k: int, recall: float, sample: int | None) -> DataFrame:
    """`search` among vectors (id, v, is_query) of one length."""
    spark = rows.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    # Of equal vectors a result can hold the k + 1 smallest ids at most (one may be the query's own).
    alike = Window.partitionBy("v").orderBy("id")
    candidates = saved(
        rows.select("id", "v").withColumn("r", F.dense_rank().over(alike)).where(F.col("r") <= k + 1).drop("r").distinct(), "ann-vectors"
    )
    asked = saved(rows.where("is_query").select("id", "v").distinct(), "ann-queries")
    same = asked.groupBy("v").agg(F.min("id").alias("rep")).withColumn("rep", F.xxhash64("v", "rep"))
    n = candidates.count()
    if not n:
        return spark.createDataFrame([], result)
    if sample is None:
        sample = min(max(SAMPLE, n // SAMPLE_EVERY), max(CALIBRATION, SAMPLE_NUMBERS // dimension))
    wanted = sample + CALIBRATION
    rate = F.lit(1_000_003 * min(1.0, wanted / n))
    picked = candidates.where(F.pmod(F.xxhash64("id", "v"), F.lit(1_000_003)) < rate).orderBy(F.xxhash64("id", "v"), "id").limit(wanted)
    got = picked.toArrow()
    if not len(got):
        got = candidates.limit(wanted).toArrow()
    sample_ids, points = got.column(0).to_numpy(), _matrix(got.column(1), dimension)
    # Of a very small table the calibration queries are among what the tree is built on.
    tree = build_tree(points[CALIBRATION:] if len(points) >= 4 * CALIBRATION else points)
    visits = _calibrate(tree, candidates, sample_ids[:CALIBRATION], points[:CALIBRATION], k, recall)

    @frees
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(_matrix(batch.column(1), dimension))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf)], names=["id", "v", "leaf"])

    @frees
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tree.visits(q, visits, held, k + 1) for q in _matrix(batch.column(0), dimension)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["rep", "q", "leaves"]
            )

    kind = candidates.schema["v"].dataType.simpleString()
    indexed = saved(candidates.select("id", "v").mapInArrow(index, f"id long, v {kind}, leaf long"), "ann-index")
    # One row for each leaf, and there are fewer leaves than sample vectors.
    leaves = saved(indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "ann-leaves")
    held = np.zeros(tree.leaves, np.int64)
    for r in leaves.collect():
        held[r["leaf"]] = r["n"]
    chunks = F.broadcast(leaves.select("leaf", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    left = indexed.join(chunks, "leaf").select("leaf", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "id", "v")
    walked = saved(same.select("v", "rep").mapInArrow(walk, f"rep long, q {kind}, leaves array<long>"), "ann-visits")

    def in_chunks(queries: DataFrame) -> DataFrame:
        """Queries (rep, q, leaves) dealt to the chunks of their leaves."""
        turns = queries.select("rep", "q", F.posexplode("leaves").alias("turn", "leaf")).join(chunks, "leaf")
        return turns.select("turn", "leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "rep", "q")

    def dealt(queries: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Points and queries by leaf, chunk and block: of a leaf that many queries visit, some meet each copy of its points."""
        # One row for each leaf.
        sizes = queries.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
        sizes = F.broadcast(saved(sizes, name))
        copies = left.join(sizes, "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        asking = in_chunks(queries).join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks")
        return copies, asking

    by = ["leaf", "chunk", "block"]
    copies, visited = dealt(walked, "ann-blocks")

    def meet(points: pa.Table, queries: pa.Table) -> pa.Table:
        reps, ids, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(points) and len(queries):
            rep, bound = queries.column("rep").to_numpy(), queries.column("bound").to_numpy()
            own = points.column("id").to_numpy()
            found = _top(own, _matrix(points.column("v"), dimension), _matrix(queries.column("q"), dimension), k + 1)
            for i, near, far in found:
                n = int(np.searchsorted(far, bound[i], side="right"))
                reps.append(np.full(n, rep[i]))
                ids.append(own[near[:n]])
                scores.append(far[:n])
        return pa.table({"rep": np.concatenate(reps), "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})

    def met_by(right: DataFrame) -> DataFrame:
        right = right.select(*by, "rep", "q", "bound")
        both = copies.groupBy(*by).cogroup(right.groupBy(*by))
        return both.applyInArrow(meet, "rep long, vec_id long, score double")

    nearest = Window.partitionBy("rep").orderBy("score", "vec_id")
    top = F.row_number().over(nearest)
    first = met_by(visited.where(F.col("turn") < FIRST).withColumn("bound", F.lit(float("inf"))))
    first = saved(first.withColumn("r", top).where(F.col("r") <= k + 1), "ann-first")
    # Nothing farther than the last of k + 1 vectors already found can be among the nearest k + 1.
    bounds = first.where(F.col("r") == k + 1).select("rep", F.col("score").alias("bound"))
    later = visited.where(F.col("turn") >= FIRST).join(bounds, "rep", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    met = first.select("rep", "vec_id", "score").unionByName(met_by(later))
    # Rows of one id in one distance (opposite vectors, say) are one neighbour each, but nothing tells them apart here.
    best = saved(met.withColumn("r", top).where(F.col("r") <= k + 1).drop("r"), "ann-best")
    named = saved(asked.join(same, asked["v"] == same["v"]).select(asked["id"].alias("query_id"), "rep"), "ann-named")
    order = Window.partitionBy("query_id", "rep").orderBy("score", "vec_id")

    def ranked(queries: DataFrame, near: DataFrame) -> DataFrame:
        others = queries.join(near, "rep").where(F.col("vec_id") != F.col("query_id"))
        return others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score", "rep")

    done = saved(ranked(named, best), "ann-result")
    counted = done.groupBy("query_id", "rep").agg(F.count(F.lit(1)).alias("got"))
    short = saved(named.join(counted.where(F.col("got") >= min(k, n - 1)), ["query_id", "rep"], "left_anti"), "ann-short")
    if not short.limit(1).count():
        return done.drop("rep")
    # Rows of the query's own id took the place of others: these queries meet all leaves, and what is theirs is left out at once.
    everywhere = walked.join(short.select("rep").distinct(), "rep", "left_semi").withColumn("leaves", F.lit(np.flatnonzero(held).tolist()))
    others, again = dealt(everywhere, "ann-blocks")
    again = again.join(short, "rep").select(*by, "query_id", "rep", "q")

    def meet_others(points: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(points) and len(queries):
            own, places = points.column("id").to_numpy(), _matrix(points.column("v"), dimension)
            for at, (query, rep) in enumerate(zip(queries.column("query_id").to_pylist(), queries.column("rep").to_pylist(), strict=True)):
                other = own != query
                if other.any():
                    block = _matrix(queries.column("q").slice(at, 1), dimension)
                    for _, near, far in _top(own[other], places[other], block, k):
                        out += [(query, rep, v, d) for v, d in zip(own[other][near].tolist(), far.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = [("query_id", pa.int64()), ("rep", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
        return pa.table({name: pa.array(column, kind) for (name, kind), column in zip(kinds, columns, strict=True)})

    exact = others.groupBy(*by).cogroup(again.groupBy(*by)).applyInArrow(meet_others, "query_id long, rep long, vec_id long, score double")
    exact = exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    return done.join(short, ["query_id", "rep"], "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(exact)
