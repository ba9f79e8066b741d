"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

A document is its set of word shingles. Documents with equal sets are one node from the start. Each node
has MinHash values, whose bands send it to buckets, and an odd sketch: a parity bitmap into which the
MinHash values are folded, so that the population count of two sketches' XOR estimates how many values
differ. Pairs of one bucket that pass the estimate are confirmed on the full sets of both documents, and
confirmed links are joined into components.

A bucket's pairs are not all compared at once. First each bucket's nodes meet its smallest one, then, where
a bucket still spans several components, the node with most confirmed links (the likely original of a
group of copies). What remains between different components of a bucket is compared in blocks of bounded
size by finer sketches: first, in one bucket of each node, the pair of two components that looks most alike is
confirmed, and then every other pair that passes between components that are still apart. So no link between components is passed over, and a large
group of copies costs some pairs for each of its members. With 26 bands of 4 values a link of
similarity 0.80 shares no bucket with probability 1e-6; so does one of 0.85 with 24 bands of 5.

Texts travel only for documents of candidate pairs. Edges, labels and buckets stay in Spark tables.

Defined results: a null text or one without a word has an empty set, is linked with nothing and is its own
component. With fewer words than a shingle the whole sequence is the one shingle. Rows with a null id take
part, but a component's id is its smallest other id (null if it has none), and `kept` is false for them.
Rows with equal ids are separate documents. An empty table gives an empty result; `near_duplicates` reads no
column but the two named, and `deduplicate` keeps all columns under their names. `deduplicate` removes no row with a null id, and of rows alike
in id and text, or in id and set, it keeps one, and none but one with an id of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frees, saved

SHINGLE_WORDS = 5
PERCENT = 80
#: Bands and values of a band for `PERCENT`; a higher similarity can do with longer and fewer bands.
BANDS = 26
ROWS = 4
SKETCH_WORDS = 8  # of 64 bits
#: MinHash values and words of the finer sketches by which blocks are compared.
FINE_VALUES = 4096
FINE_WORDS = 64
#: Estimates so many standard deviations below the threshold still pass to confirmation.
SLACK = 5.0
#: Nodes of a block when all pairs of a bucket are compared by sketch.
BLOCK = 512
#: Pairs of one hub that its text goes to together, about.
HUB_PAIRS = 1000
#: Candidate nodes are broadcast to the documents while there are at most so many.
BROADCAST_NODES = 400_000

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _constants(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingles of a text as 64-bit hashes; A-Z count as a-z."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))[ids]
    span = min(width, len(words))
    mixed = np.full(len(words) - span + 1, span, np.uint64)
    for i in range(span):
        mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(mixed)])
    return np.unique(mixed)


def minhash(shingles: np.ndarray, count: int) -> np.ndarray:
    """`count` MinHash values: minima under multiplication by random odd numbers."""
    factors = _constants(count, 11) | np.uint64(1)
    out = np.full(count, _MASK)
    for start in range(0, len(shingles), 256):
        np.minimum(out, (factors[:, None] * shingles[None, start : start + 256]).min(axis=1), out=out)
    return out


def odd_sketch(values: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Flip one bit for each (position, value); bits hit an even number of times are 0."""
    bits = (_mix(values ^ _constants(len(values), 23)) % np.uint64(64 * words)).astype(np.int64)
    parity = np.bincount(bits, minlength=64 * words) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def most_differing_bits(similarity: float, count: int, words: int = SKETCH_WORDS, slack: float = SLACK) -> int:
    """XOR population count up to which a pair of that similarity is taken for one.

    The number of differing values is binomial, each of them flips two random bits of n, and d flips leave
    an odd number in n/2 (1 - (1 - 2/n)^d) bits on average. The bound lies `slack` joint standard
    deviations above the mean.
    """
    n = 64 * words
    flips = 2 * count * (1 - similarity)
    mean = n / 2 * (1 - (1 - 2 / n) ** flips)
    spread = n / 4 * (1 - (1 - 4 / n) ** flips) + n * (n - 1) / 4 * ((1 - 4 / n) ** flips - (1 - 2 / n) ** (2 * flips))
    slope = 2 * (1 - 2 / n) ** flips
    return int(mean + slack * (slope**2 * count * similarity * (1 - similarity) + max(0.0, spread)) ** 0.5) + 1


def _nodes(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """A row for each document: id, set size, 128-bit fingerprint of its set, bands' buckets, sketch."""

    @frees
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = _constants(bands, 37)
        for batch in batches:
            sizes, prints, buckets, sketches = [], [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), width)
                sizes.append(len(found))
                if not len(found):
                    prints.append(None)
                    buckets.append(None)
                    sketches.append(None)
                    continue
                prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                values = minhash(found, bands * rows)
                key = salt
                for column in values.reshape(bands, rows).T:
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
                buckets.append(key.view(np.int64))
                sketches.append(odd_sketch(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                 pa.array(buckets, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "node", "buckets", "sketch"],
            )

    return docs.mapInArrow(
        describe, "doc_id long, n_shingles long, node binary, buckets array<long>, sketch array<long>"
    )


def _differing_bits(a: str, b: str, words: int = SKETCH_WORDS) -> Column:
    bits = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(words)]
    total = bits[0]
    for x in bits[1:]:
        total = total + x
    return total


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    """Sets can only be that similar if the smaller one is that share of the larger one."""
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b, hub) whose full shingle sets are similar enough, as (a, b).

    `hub` is one of the two, which many pairs may share. Its text goes once to each `HUB_PAIRS` of its pairs
    and stands before the others' texts in their order, so that a task holds two sets at a time.
    """

    @frees
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = np.zeros(0, np.uint64)
        for batch in batches:
            hubs, nodes = [], []
            for hub, turn, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = shingle_set(text.as_py(), width)
                if not turn:
                    around = own
                    continue
                common = len(np.intersect1d(around, own, assume_unique=True))
                if 100 * common >= percent * (len(around) + len(own) - common):
                    hubs.append(hub)
                    nodes.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.binary()), pa.array(nodes, pa.binary())], names=["hub", "node"])

    pairs = pairs.select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"))
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).alias("parts"))
    pairs = pairs.join(parts, "hub").select("hub", "other", F.pmod(F.xxhash64("other"), F.col("parts")).alias("part"))
    known = texts.select(F.col("node").alias("of"), "text")
    others = pairs.join(known, F.col("other") == F.col("of")).select("hub", "part", F.lit(1).alias("turn"), F.col("other").alias("node"), "text")
    hubs = pairs.select("hub", "part").distinct().join(known, F.col("hub") == F.col("of"))
    rows = others.unionByName(hubs.select("hub", "part", F.lit(0).alias("turn"), F.col("hub").alias("node"), "text"))
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "turn").select("hub", "turn", "node", "text")
    return rows.mapInArrow(similar, "hub binary, node binary").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else ids


def _texts_of(docs: DataFrame, nodes: DataFrame, width: int, again: DataFrame | None) -> DataFrame:
    """The text of each node (node, doc_id): one row, found by the id of a document that has that set.

    `again` has the ids that several documents have, null among them. What they name is found by its set as well, so
    that a node meets no document but those with its own set.
    """
    wanted = nodes.select("node", F.col("doc_id").alias("rep"))
    if again is None:
        return saved(docs.join(_few(wanted), F.col("doc_id") == F.col("rep")).select("node", "text"), "dedup-texts")

    @frees
    def with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(text.as_py(), width) for text in batch.column(1))
            prints = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints, batch.column(1)], names=["doc_id", "own", "text"])

    named = again.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"))
    once = wanted.where("rep IS NOT NULL").join(named, "rep", "left_anti")
    found = docs.join(_few(once), F.col("doc_id") == F.col("rep")).select("node", "text")
    several = docs.where("doc_id IS NOT NULL").join(_few(named), F.col("doc_id") == F.col("rep"), "left_semi")
    several = several.unionByName(docs.where("doc_id IS NULL")).mapInArrow(with_set, "doc_id long, own binary, text string")
    more = several.join(wanted, (F.col("own") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")
    return saved(found.unionByName(more.dropDuplicates(["node"])), "dedup-texts")


def _fine_sketches(texts: DataFrame, width: int) -> DataFrame:
    """A finer odd sketch of each node from its text."""

    @frees
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [odd_sketch(minhash(shingle_set(t.as_py(), width), FINE_VALUES), FINE_WORDS) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "fine"])

    return texts.select("node", "text").mapInArrow(sketch, "node binary, fine array<long>")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node, component (the smallest node of its component).

    Each round gives every node the smallest label around it and then the label of that label.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(both.distinct(), "dedup-edges")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "dedup-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("component").alias("was"), F.least("component", "m").alias("now")
        )
        up = labels.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        jumped = lower.join(up, F.col("now") == F.col("n2"), "left").select(
            "node", F.least("now", F.coalesce("c2", "now")).alias("component"), "was"
        )
        jumped = saved(jumped, "dedup-labels")
        labels = jumped.select("node", "component")
        if not jumped.where("component <> was").limit(1).count():
            return labels


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id and whether it is kept."""
    found = _judged(docs, shingle_words, percent, id_col, text_col, bands, rows)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, shingle_words: int, percent: int, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """The rows of `near_duplicates` with `node`, and `one`: whether this id and set stand for the component."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    described = saved(_nodes(docs, shingle_words, bands, rows), "dedup-documents")
    again = described.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    again = saved(again.where("n > 1 OR doc_id IS NULL").select("doc_id"), "dedup-again")
    repeated = again if again.limit(1).count() else None
    nodes = saved(
        described.where("n_shingles > 0").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"), F.first("sketch").alias("sketch")
        ),
        "dedup-nodes",
    )
    spread = nodes.select("node", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("o"), F.explode("buckets").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("o", "node")).alias("s"))
    shared = shared.where("m > 1").select("bucket", "m", F.col("s.node").alias("hub"))
    members = saved(spread.join(shared, "bucket").select("bucket", "node", "m", "hub"), "dedup-members")
    known = saved(nodes.drop("buckets").join(members.select("node").distinct(), "node", "left_semi"), "dedup-candidates")
    texts: DataFrame | None = None
    most = most_differing_bits(percent / 100, bands * rows)

    def passing(pairs: DataFrame) -> DataFrame:
        a = known.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
        b = known.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
        near = pairs.join(a, "a").join(b, "b")
        return near.where(_sizes_allow("n_a", "n_b", percent) & (_differing_bits("sketch_a", "sketch_b") <= most)).select("a", "b", "hub")

    def with_hub(found: DataFrame) -> DataFrame:
        """Pairs (a < b) of found nodes and hubs, each once."""
        pairs = found.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), "hub")
        return pairs.groupBy("a", "b").agg(F.min("hub").alias("hub"))

    def texts_for(wanted: DataFrame) -> DataFrame:
        """Texts of the nodes wanted and of those wanted before."""
        nonlocal texts
        wanted = known.join(wanted, "node", "left_semi").select("node", "doc_id")
        if texts is None:
            texts = _texts_of(docs, wanted, shingle_words, repeated)
        else:
            wanted = saved(wanted.join(texts, "node", "left_anti"), "dedup-wanted")
            if wanted.limit(1).count():
                texts = texts.unionByName(_texts_of(docs, wanted, shingle_words, repeated))
        return texts

    def confirmed(pairs: DataFrame) -> DataFrame:
        texts = texts_for(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        return saved(_confirm(pairs, texts, shingle_words, percent), "dedup-links")

    def both_ways(links: DataFrame) -> DataFrame:
        return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))

    # First every member against the smallest one of its bucket.
    tested = saved(passing(with_hub(members.where("node <> hub"))), "dedup-pairs")
    links = confirmed(tested)

    # Then against the member with most links, where a bucket's members have not all the same smallest neighbour.
    around = both_ways(links).groupBy("a").agg(F.count(F.lit(1)).alias("degree"), F.min("b").alias("low"))
    around = around.select(F.col("a").alias("node"), "degree", F.least("a", "low").alias("low"))
    near = members.select("bucket", "node").join(around, "node", "left")
    near = near.select("bucket", "node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("low", "node").alias("low"))
    split = near.groupBy("bucket").agg(F.min("low").alias("l"), F.max("low").alias("h"), F.max(F.struct("degree", "node", "low")).alias("s"))
    split = split.where("l <> h").select("bucket", F.col("s.node").alias("hub"), F.col("s.low").alias("hub_low"))
    again = with_hub(near.join(split, "bucket").where("node <> hub AND low <> hub_low"))
    second = saved(passing(again.join(tested, ["a", "b"], "left_anti")), "dedup-pairs")
    if second.limit(1).count():
        links = links.unionByName(confirmed(second))
        tested = tested.unionByName(second)
    labels = components(links)

    # At last everything that is still apart in a bucket, in blocks and by finer sketches.
    def apart_in(labels: DataFrame) -> DataFrame:
        named = members.select("bucket", "node", "m").join(labels, "node", "left")
        named = named.select("bucket", "node", "m", F.coalesce("component", "node").alias("component"))
        apart = named.groupBy("bucket").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l <> h").select("bucket")
        return named.join(apart, "bucket")

    open_nodes = saved(apart_in(labels).select("node").distinct(), "dedup-open")
    fine = saved(_fine_sketches(texts_for(open_nodes).join(open_nodes, "node", "left_semi"), shingle_words), "dedup-sketches")
    sketches = saved(known.select("node", "n", "sketch").join(fine, "node"), "dedup-sketches")
    alike = (F.col("c_a") != F.col("c_b")) & _sizes_allow("n_a", "n_b", percent) & (_differing_bits("sketch_a", "sketch_b") <= most)
    alike &= _differing_bits("fine_a", "fine_b", FINE_WORDS) <= most_differing_bits(percent / 100, FINE_VALUES, FINE_WORDS)

    def across(labels: DataFrame, once: bool = False) -> DataFrame:
        """Pairs of different components of a bucket that pass both sketches: a, b, c_a, c_b, differing bits.

        With `once` each node is looked for in one of its buckets only, which finds a part of the pairs at a
        fraction of the cost.
        """
        own = apart_in(labels)
        if once:
            own = own.join(own.groupBy("node").agg(F.min("bucket").alias("bucket")), ["node", "bucket"])
        own = own.join(sketches, "node").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        own = own.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        x = own.select("bucket", F.col("block").alias("i"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("j"),
                       F.col("node").alias("a"), F.col("component").alias("c_a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"), F.col("fine").alias("fine_a"))
        y = own.select("bucket", F.explode(F.expr("sequence(0, block)")).alias("i"), F.col("block").alias("j"),
                       F.col("node").alias("b"), F.col("component").alias("c_b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"), F.col("fine").alias("fine_b"))
        order = (F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))
        return x.join(y, ["bucket", "i", "j"]).where(order & alike).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("c_a", "c_b").alias("c_a"), F.greatest("c_a", "c_b").alias("c_b"),
            _differing_bits("fine_a", "fine_b", FINE_WORDS).alias("bits"),
        )

    # First the pair that looks most alike of each two components that meet in one bucket of their nodes, which joins
    # most that belong together; then all that is left, which is many pairs only where many are within the sketches'
    # error of the threshold.
    closest = across(labels, once=True).groupBy("c_a", "c_b").agg(F.min_by(F.struct("a", "b"), F.struct("bits", "a", "b")).alias("p"))
    closest = closest.select("p.a", "p.b", F.col("p.a").alias("hub")).join(tested, ["a", "b"], "left_anti")
    closest = saved(closest, "dedup-pairs")
    if closest.limit(1).count():
        tested = tested.unionByName(closest)
        more = confirmed(closest)
        if more.limit(1).count():
            links = links.unionByName(more)
            labels = components(links)
    rest = across(labels).select("a", "b", F.col("a").alias("hub")).distinct().join(tested, ["a", "b"], "left_anti")
    rest = saved(rest, "dedup-pairs")
    if rest.limit(1).count():
        more = confirmed(rest)
        if more.limit(1).count():
            labels = components(links.unionByName(more))

    joined = nodes.select("node", "doc_id").join(labels, "node")
    # Ids may repeat, so the smallest id alone does not tell which of its rows belongs to the component.
    stands = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "node")))
    smallest = joined.groupBy("component").agg(stands.alias("s")).select("component", F.col("s.doc_id").alias("component_id"), F.col("s.node").alias("first"))
    of_node = joined.join(smallest, "component").select(F.col("node").alias("l_node"), "component_id", "first")
    single = nodes.select("node", F.col("doc_id").alias("own"))
    lowest = single.join(of_node, F.col("node") == F.col("l_node"), "left").select(
        F.col("node").alias("r_node"), F.coalesce("component_id", "own").alias("component_id"), F.coalesce("first", "node").alias("first")
    )
    out = described.select("doc_id", "n_shingles", "node").join(lowest, F.col("node") == F.col("r_node"), "left")
    component = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(False))
    one = kept & F.col("node").eqNullSafe(F.col("first"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "node", one.alias("one"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of `docs` with one document of each component, the one with the smallest id."""
    how = {"shingle_words": SHINGLE_WORDS, "percent": PERCENT, "bands": BANDS, "rows": ROWS} | how
    found = saved(_judged(docs, id_col=id_col, text_col=text_col, **how).select("doc_id", "node", "one"), "dedup-result")
    named = found.where(F.col("doc_id").isNotNull())
    gone = named.where(~F.col("one")).select(F.col("doc_id").alias("__gone")).distinct()
    again = named.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again"))

    own = F.col(f"`{id_col}`").cast("long")
    if not again.limit(1).count():
        return docs.join(_few(gone), own == F.col("__gone"), "left_anti")
    repeated = _few(again)
    once = docs.join(repeated, own == F.col("__again"), "left_anti").join(_few(gone), own == F.col("__gone"), "left_anti")

    @F.arrow_udf("binary")
    @frees
    def set_print(texts: pa.Array) -> pa.Array:
        sets = (shingle_set(text.as_py(), how["shingle_words"]) for text in texts)
        return pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())

    # Rows of an id that others have too are told apart by their sets.
    ones = named.where("one").join(repeated, F.col("doc_id") == F.col("__again"), "left_semi")
    ones = _few(ones.select(F.col("doc_id").alias("__id"), F.col("node").alias("__one")).distinct())
    more = docs.join(repeated, own == F.col("__again"), "left_semi").withColumns({"__own": own, "__node": set_print(F.col(f"`{text_col}`"))})
    more = more.join(ones, (F.col("__own") == F.col("__id")) & F.col("__node").eqNullSafe(F.col("__one")), "left_semi")
    more = more.withColumn("__text", F.when(F.col("__node").isNull(), F.col(f"`{text_col}`")))
    return once.unionByName(more.dropDuplicates(["__own", "__node", "__text"]).drop("__own", "__node", "__text"))
