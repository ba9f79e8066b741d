"""Collocations: phrases whose words meet more often than their parts would by chance.

Each shard of texts becomes a generalised suffix automaton of its pieces, a piece counted as often as it occurs. Its
depth is bounded: a step starts from the state of the last words short of the bound, so that states
are classes of phrases up to that length with equal end positions. End positions are counted along suffix links,
all paths from the root are enumerated with the counts of the states that they reach, and the phrases go, packed by
hash, to one bucket each, where the shards' counts are added. A phrase that is frequent in all has frequent parts, so
only frequent phrases leave the buckets. A longer phrase subsumes two shorter ones directly: the one its suffix link
leads to, which lacks its first word, and the one that lacks its last.

Defined results: a null text has no words, a null language is `und`. A-Z count as a-z, other letters as they are.
Texts and pieces of any length are read whole. Ids are not read; repeated rows count as often as they occur. Ties
in score and count go by phrase, in the order of UTF-8 bytes. An empty table, and a language without a frequent
phrase, give no rows. Columns beyond those named are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import frees, saved, trim

#: Words of a phrase, at most, and occurrences, at least.
MOST_WORDS = 3
LEAST_COUNT = 10
#: A longer candidate with this percentage of a phrase's occurrences subsumes it.
SUBSUMED_PERCENT = 50
#: Phrases returned of each language.
TOP = 2_000
#: Words of one automaton, about, and bytes of text for which a bucket is made.
SHARD_WORDS = 300_000
BUCKET_BYTES = 8_000_000
#: Bytes of unpacked phrases and counts between two sums of a bucket.
HELD_BYTES = 64_000_000
#: Parts that a language's phrases are ranked in first.
SALTS = 64

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)


class PhraseAutomaton:
    """A generalised suffix automaton of symbol sequences, exact for substrings of up to `depth` symbols.

    It is built from all sequences at once: suffix links form the tree of the reversed prefixes, so that the states, which
    are its nodes, stand together once the prefixes are sorted by their last symbols.
    """

    def __init__(self, depth: int):
        self.depth = depth
        self._sequences: list[list[int]] = []
        self._weights: list[int] = []

    def add(self, symbols: list[int], weight: int) -> None:
        """Add a sequence that occurs `weight` times."""
        self._sequences.append(symbols)
        self._weights.append(weight)

    def build(self) -> None:
        """Number the states, root first, and set `length`, `link` and `count` of each and its steps.

        State s has the steps from first[s] to first[s + 1], by `symbols` to `states`.
        """
        sizes = np.fromiter(map(len, self._sequences), np.int64, len(self._sequences))
        text = np.fromiter(chain.from_iterable(self._sequences), np.int64, sizes.sum())
        weights = np.repeat(np.array(self._weights, np.int64), sizes)
        known = np.minimum(np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1, self.depth)

        # Prefixes by their last symbols, the very last first; 0 stands before a sequence.
        base = int(text.max(initial=0)) + 2
        columns = [text + 1]
        for n in range(1, self.depth):
            column = np.zeros(len(text), np.int64)
            column[n:] = columns[0][:-n]
            column[known <= n] = 0
            columns.append(column)
        key, span = columns[0], base
        for column in columns[1:]:
            if span * base >= 1 << 63:
                values, key = np.unique(key, return_inverse=True)
                span = len(values)
            key, span = key * base + column, span * base
        order = np.argsort(key)

        # Strings of each length: where they begin in that order. A string has the state of the one longer by a symbol
        # that stands before all its occurrences, or one of its own.
        begins, ends, differs = [], [], np.zeros(len(text), bool)
        differs[:1] = True
        for column in columns:
            column = column[order]
            differs[1:] |= column[1:] != column[:-1]
            begin = np.flatnonzero(differs)
            end = np.append(begin, len(text))[1:]
            real = column[begin] > 0
            begins.append(begin[real])
            ends.append(end[real])
        made, own = 1, []
        length = [np.zeros(1, np.int64)]
        longer, longer_end = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        for n in range(self.depth, 0, -1):
            begin, end = begins[n - 1], ends[n - 1]
            state = longer[begin]
            fresh = longer_end[begin] != end
            state[fresh] = np.arange(made, made + fresh.sum())
            made += int(fresh.sum())
            length.append(np.full(fresh.sum(), n))
            own.insert(0, state)
            longer_end[:] = 0
            longer[begin], longer_end[begin] = state, end
        self.length, self.link, self.count = np.concatenate(length), np.full(made, -1), np.zeros(made, np.int64)

        # Of each occurrence, the state of its last n symbols; steps lead there from the state of the n - 1 before the last.
        before, edges = np.zeros(len(text), np.int64), []
        for n, (begin, end, state) in enumerate(zip(begins, ends, own, strict=True), 1):
            at = order[begin]
            source = before[at - 1] if n > 1 else np.zeros(len(at), np.int64)
            # The longest string that can be followed has all steps of its state.
            most = np.minimum(self.length[source], self.depth - 1) == n - 1
            edges.append((source[most], text[at[most]], state[most]))
            parted = before[at]
            apart = parted != state
            self.link[state[apart]] = parted[apart]
            sizes = end - begin
            inside = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            reached = np.zeros(len(text), np.int64)
            reached[order[inside]] = np.repeat(state, sizes)
            deepest = known == n
            np.add.at(self.count, reached[deepest], weights[deepest])
            before = reached
        for n in range(self.depth, 0, -1):
            those = np.flatnonzero(self.length == n)
            np.add.at(self.count, self.link[those], self.count[those])
        source, symbols, states = map(np.concatenate, zip(*edges, strict=True))
        order = np.argsort(source, kind="stable")
        self.symbols, self.states = symbols[order], states[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(source, minlength=made))])

    def substrings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1 to `depth` a matrix with a row of symbols for each substring, and their counts.

        Rows with the same first symbols stand together.
        """
        self.build()
        rows, at = np.zeros((1, 0), np.int64), np.zeros(1, np.int64)
        for _ in range(self.depth):
            n = self.first[at + 1] - self.first[at]
            edge = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            rows, at = np.column_stack([np.repeat(rows, n, axis=0), self.symbols[edge]]), self.states[edge]
            yield rows, self.count[at]


def _buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) % buckets


def _shard_rows(lang: str, pieces: dict[bytes, int], most_words: int, buckets: int) -> Iterator[tuple]:
    """(lang, bucket, phrases, counts, words) of one shard; phrases, a line each, and counts packed."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    automaton = PhraseAutomaton(most_words)
    words = 0
    for piece, weight in pieces.items():
        symbols = list(map(numbers.__getitem__, piece.split()))
        words += weight * len(symbols)
        automaton.add(symbols, weight)
    names = pa.array(numbers, pa.large_binary())
    # A phrase's words stand before a space, the last one before a line's end.
    spaced, closed = (pc.binary_join_element_wise(names, pa.scalar(b"", pa.large_binary()), pa.scalar(end, pa.large_binary())) for end in (b" ", b"\n"))
    drawn = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
    packer = zstandard.ZstdCompressor(level=1)
    lengths = []
    for rows, counts in automaton.substrings():
        hashes = np.full(len(rows), rows.shape[1], np.uint64)
        for column in rows.T:
            hashes = (hashes ^ drawn[column]) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(29)
        bucket = _buckets(hashes, buckets)
        # Phrases with the same first words stay together, which packs well.
        order = np.argsort(bucket.astype(np.uint16) if buckets < 65_536 else bucket, kind="stable")
        rows = rows[order]
        parts = [*(spaced.take(pa.array(column)) for column in rows.T[:-1]), closed.take(pa.array(rows[:, -1]))]
        lines = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()))
        if len(lines):
            begins = np.searchsorted(bucket[order], np.arange(buckets + 1))
            at = np.frombuffer(lines.buffers()[1], np.int64)[begins]
            lengths.append((memoryview(lines.buffers()[2]), at.tolist(), counts[order], begins.tolist()))
    for bucket in range(buckets):
        lines = b"".join(text[at[bucket] : at[bucket + 1]] for text, at, _, _ in lengths)
        if lines:
            counts = b"".join(n[begins[bucket] : begins[bucket + 1]] for _, _, n, begins in lengths)
            yield lang, bucket, packer.compress(lines), packer.compress(counts), words
            words = 0


def phrase_counts(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, shard_words: int = SHARD_WORDS, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of up to so many words that occur often enough, and (lang, n), the words of each language.

    `docs` has lang and text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    most_bytes = 6 * shard_words
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))

    @frees
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, int]] = {}
        sizes: dict[str, int] = {}

        def flushed(lang: str) -> pa.RecordBatch:
            made = list(zip(*_shard_rows(lang, held.pop(lang), most_words, buckets), strict=True))
            trim()
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made or [()] * 5, kinds, strict=True)], names=["lang", "bucket", "phrases", "counts", "words"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own, size = held.setdefault(lang, {}), sizes.get(lang, 0)
                for piece in text.as_py().translate(_LOWER).split(b"\n"):
                    if piece in own:
                        own[piece] += 1
                    elif piece and not piece.isspace():
                        own[piece] = 1
                        size += len(piece)
                        if size >= most_bytes:
                            yield flushed(lang)
                            own, size = held.setdefault(lang, {}), 0
                sizes[lang] = size
        for lang in list(held):
            if held[lang]:
                yield flushed(lang)

    @frees
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        key, totals = None, {}
        held: list[pa.RecordBatch] = []
        size = 0

        def summed() -> pa.RecordBatch:
            sums = pa.Table.from_batches(held).group_by("phrase", use_threads=False).aggregate([("f", "sum")])
            return pa.RecordBatch.from_arrays([sums["phrase"].combine_chunks(), sums["f_sum"].combine_chunks()], names=["phrase", "f"])

        def frequent() -> pa.RecordBatch:
            found = summed()
            found = found.filter(pc.greater_equal(found["f"], least))
            phrases = pc.utf8_rtrim(found["phrase"].cast(pa.string()), "\n")
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(phrases), pa.string()), phrases, found["f"]], names=["lang", "phrase", "f"])

        for batch in batches:
            for lang, bucket, phrases, counts, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:4], batch.column(4).to_pylist(), strict=True):
                totals[lang] = totals.get(lang, 0) + words
                if (lang, bucket) != key:
                    if held:
                        yield frequent()
                    key, held, size = (lang, bucket), [], 0
                lines, ns = unpack(phrases.as_py()), unpack(counts.as_py())
                ends = np.append(-1, np.flatnonzero(np.frombuffer(lines, np.uint8) == 10)).astype(np.int32) + np.int32(1)
                arrays = [pa.Array.from_buffers(t, len(ends) - 1, [None, *map(pa.py_buffer, own)]) for t, own in ((pa.binary(), (ends, lines)), (pa.int64(), (ns,)))]
                held.append(pa.RecordBatch.from_arrays(arrays, names=["phrase", "f"]))
                size += held[-1].nbytes
                if size >= HELD_BYTES:
                    held = [summed()]
                    size = 0
        if held:
            yield frequent()
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["lang", "phrase", "f"])

    packed = rows.mapInArrow(shards, "lang string, bucket long, phrases binary, counts binary, words long")
    dealt = packed.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    found = saved(dealt.mapInArrow(added, "lang string, phrase string, f long"), "phrase-counts")
    return found.where("phrase IS NOT NULL"), found.where("phrase IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))


#: floor(1000000 a a / (l r)) in decimals of 38 digits, enough for 10^16 occurrences; the quotient is a million at most.
_SCORE = """CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)) * CAST(1000000 AS DECIMAL(7, 0))
div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"""


def collocations(
    docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, subsumed_percent: int = SUBSUMED_PERCENT, top: int = TOP, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """Each language's best phrases of two words and more: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = phrase_counts(docs, most_words, least, shard_words)
    counts = counts.withColumn("size", F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1)
    candidates = counts.where("size > 1").withColumnRenamed("f", "a")

    # What a longer candidate subsumes: itself without its last word, and its suffix link, itself without its first one; in turn theirs.
    longer = candidates.where("size > 2").select("lang", "phrase", F.col("a").alias("longest"), "size")
    reached = None
    for _ in range(most_words - 2):
        first, last = F.regexp_extract("phrase", "^(.*) [^ ]*$", 1), F.regexp_extract("phrase", "^[^ ]* (.*)$", 1)
        longer = longer.select("lang", F.explode(F.array(first, last)).alias("phrase"), "longest", (F.col("size") - 1).alias("size"))
        reached = longer if reached is None else reached.unionByName(longer)
        longer = longer.where("size > 2")
    if reached is not None:
        reached = reached.groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))
        candidates = candidates.join(reached, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < subsumed_percent * F.col("a"))).drop("longest")

    # Every cut of a candidate, with the counts of both parts.
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), (F.col("size") - 1).cast("int"))).alias("k"))
    cut = cut.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substr(phrase, length(left) + 2)"))
    parts = counts.select("lang", "phrase", "f")
    cut = cut.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = cut.select("lang", "phrase", "a", "k", "l", "r", F.expr(_SCORE).alias("score"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("b")).select("lang", "phrase", "a", "b.*")

    # First in parts of a language, so that no task ranks all its phrases.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
