"""Passages that repeat over documents, found in prefix-partitioned suffix trees.

A window of words is a repeat if the same words also stand in a document with a smaller id. Its suffix, cut at the window's
length, ends below an inner node of the generalised suffix tree that lies that deep; the smallest id under that
node tells which documents keep the passage. Windows that follow each other join into maximal repeats.

The tree is never built whole:

- Texts alike word for word are one node from the start, held by their smallest id. The rest is kept in blocks.
- A suffix whose window is alone has no deep node above it. Each window draws the smallest hash among its sequences
  of half its words; a block's hashes meet those of other blocks in hash ranges, and only suffixes whose hash is
  found in two documents go on. An accidental match costs work, never a result.
- In each block the suffixes left are a subtree of their own, whose deep nodes send one suffix each, with its
  smallest id. So a passage in a third of all documents sends one suffix for each block.
- These suffixes are split by prefixes of one word, and where too many have one prefix by longer ones, until a group
  fits in memory; its subtree is built from sorted suffixes and the words that neighbours have in common. Back goes
  to each block which of its suffixes a smaller id has elsewhere.

Words are compared as words, and windows by their numbers, not by hashes.

Defined results: a null or empty text has no words; one with fewer words than a window keeps all. Repeated rows (same id,
same text) are no copies of each other. A null id counts as larger than all others. A text of any length takes
part whole. Words are kept unchanged; white space between them is one blank in what is left. An empty table gives none.
Columns beyond those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frees, saved, trim

WINDOW = 13
#: Bytes of text of a block, about; a task holds some 25 times as many.
BLOCK_BYTES = 4_000_000
#: Hashes of a range, and suffixes of a group, about.
RANGE_HASHES = 4_000_000
GROUP_SUFFIXES = 250_000
#: Texts' digests are broadcast while there are at most so many.
BROADCAST_DIGESTS = 400_000
_LAST = 2**63 - 1
_EMPTY = hashlib.sha256().hexdigest()


def _pack(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _array(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(_unpack(data), kind)


def _batch(columns: dict[str, tuple[pa.DataType, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in columns.values()], names=list(columns))


def subtree(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of word numbers; the order, and how many first words each has in common with the one before.

    Together they are the suffix tree: an inner node of some depth is a run of neighbours with that much in common.
    """
    order = np.lexsort(suffixes.T[::-1])
    rows = suffixes[order]
    common = np.minimum.accumulate(rows[1:] == rows[:-1], axis=1).sum(axis=1)
    return order, np.concatenate([[-1], common])


def _deep_nodes(suffixes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix the number of its node at full depth; for each node its smallest id and one of its suffixes."""
    order, common = subtree(suffixes)
    starts = np.flatnonzero(common < suffixes.shape[1])
    node = np.empty(len(order), np.int64)
    node[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(order)))
    return node, np.minimum.reduceat(ids[order], starts), order[starts]


class _Block:
    """Texts of a block, one a line, with single blanks between words: where words and windows lie."""

    def __init__(self, texts: bytes, window: int):
        self.bytes = texts
        self.window = window
        raw = np.frombuffer(texts, np.uint8)
        gaps = np.flatnonzero((raw == 32) | (raw == 10))
        #: First byte and end of each word.
        self.start = np.concatenate([[0], gaps + 1])
        self.stop = np.concatenate([gaps, [len(raw)]])
        last = np.concatenate([np.flatnonzero(raw[gaps] == 10), [len(gaps)]])
        self.sizes = np.diff(last, prepend=-1)
        #: First word of each text.
        self.first = last + 1 - self.sizes
        text = np.repeat(np.arange(len(last)), self.sizes)
        #: First word and text of each window.
        self.at = np.flatnonzero(np.arange(len(text)) + window <= np.repeat(last + 1, self.sizes))
        self.text = text[self.at]

    def lowest_hashes(self) -> np.ndarray:
        """Of each window the smallest 48-bit hash of its sequences of half its words."""
        seed = max(1, self.window // 2)
        drawn = _word_hashes(np.frombuffer(self.bytes, np.uint8), self.start, self.stop)
        mixed = np.zeros(len(drawn) - seed + 1, np.uint64)
        for i in range(seed):
            mixed = (mixed ^ drawn[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed >>= np.uint64(16)
        lowest = mixed[self.at]
        for i in range(1, self.window - seed + 1):
            np.minimum(lowest, mixed[self.at + i], out=lowest)
        return lowest

    def suffixes(self, windows: np.ndarray) -> np.ndarray:
        """The words of some windows as numbers, a row for each."""
        at = self.at[windows]
        inside = np.zeros(len(self.start) + 1, np.int32)
        np.add.at(inside, at, 1)
        np.add.at(inside, at + self.window, -1)
        words = np.flatnonzero(np.cumsum(inside[:-1]))
        numbers: dict[bytes, int] = {}
        data = self.bytes
        out = np.zeros(len(self.start), np.int32)
        out[words] = [numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(self.start[words].tolist(), self.stop[words].tolist(), strict=True)]
        return np.stack([out[at + i] for i in range(self.window)], axis=1)

    def lines(self, windows: np.ndarray) -> list[bytes]:
        at = self.at[windows]
        return [self.bytes[a:b] for a, b in zip(self.start[at].tolist(), self.stop[at + self.window - 1].tolist(), strict=True)]

    def whole(self, text: int) -> bytes:
        first = self.first[text]
        return self.bytes[self.start[first] : self.stop[first + self.sizes[text] - 1]]


_RANDOM = np.random.default_rng(20).integers(1, 2**63, (2, 4096), dtype=np.uint64) | np.uint64(1)
_OF_BYTE = np.where(np.isin(np.arange(256), (10, 32)), 0, _RANDOM[0][:256]).astype(np.uint64)


def _word_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, piece: int = 1 << 19) -> np.ndarray:
    """A hash of each word: random numbers of its bytes times those of their places, some words at a time."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(stop, start[lo] + piece)))
        first, end = start[lo], start[hi] if hi < len(start) else len(raw)
        place = np.arange(first, end) - np.repeat(start[lo:hi], np.diff(start[lo:hi], append=end))
        out[lo:hi] = np.add.reduceat(_OF_BYTE[raw[first:end]] * _RANDOM[1][np.minimum(place, 4095)], start[lo:hi] - first)
        lo = hi
    return out


def _packed_hashes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked_hashes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _digested(docs: DataFrame, keep_text: bool) -> DataFrame:
    """doc_id, id (the same, null last), digest of the words, their number, and if asked for the words joined by blanks."""

    @frees
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, joined = [], [], []
            for text in batch.column(1):
                words = text.as_py().split()
                sizes.append(len(words))
                words = b" ".join(words)
                digests.append(hashlib.sha256(words).digest())
                if keep_text:
                    joined.append(words)
            columns = {"digest": (pa.binary(), digests), "n_words": (pa.int64(), sizes)}
            made = _batch(columns | ({"words": (pa.binary(), joined)} if keep_text else {}))
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=["doc_id", *made.schema.names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    made = rows.mapInArrow(digest, "doc_id long, digest binary, n_words long" + ", words binary" * keep_text)
    return made.withColumn("id", F.coalesce("doc_id", F.lit(_LAST)))


def _blocks(texts: DataFrame, block_bytes: int) -> DataFrame:
    """Rows of (block, ids, digests, texts) from rows of (id, digest, words)."""

    @frees
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, size = TaskContext.get().partitionId(), 0, 0
        ids, digests, texts = [], [], []

        def block() -> pa.RecordBatch:
            packed = {"ids": np.array(ids, np.int64).tobytes(), "digests": b"".join(digests), "texts": _pack(b"\n".join(texts), 6)}
            return _batch({"block": (pa.string(), [f"{part}-{made}"])} | {k: (pa.binary(), [v]) for k, v in packed.items()})

        for batch in batches:
            for own, digest, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids.append(own)
                digests.append(digest)
                texts.append(words.as_py())
                size += len(texts[-1])
                if size >= block_bytes:
                    yield block()
                    ids, digests, texts, size, made = [], [], [], 0, made + 1
        if ids:
            yield block()

    return texts.mapInArrow(gather, "block string, ids binary, digests binary, texts binary")


def _shared_hashes(blocks: DataFrame, window: int, ranges: int) -> DataFrame:
    """For each block those of its windows' hashes that another block has too."""

    @frees
    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.unique(_Block(_unpack(texts.as_py()), window).lowest_hashes())
                at = (values % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                starts = np.flatnonzero(np.diff(at[order], prepend=-1))
                parts = np.split(values[order], starts[1:]) if len(starts) else []
                trim()
                yield _batch({"range": (pa.int64(), at[order][starts].tolist()), "block": (pa.string(), [block] * len(parts)), "hashes": (pa.binary(), [_packed_hashes(p) for p in parts])})

    @frees
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def answers() -> pa.RecordBatch:
            every = np.sort(np.concatenate([h for _, h in held]))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            found = [(b, h[np.isin(h, twice, assume_unique=True)]) for b, h in held]
            found = [(b, _packed_hashes(h)) for b, h in found if len(h)]
            return _batch({"block": (pa.string(), [b for b, _ in found]), "hashes": (pa.binary(), [h for _, h in found])})

        for batch in batches:
            for own, block, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if own != at:
                    if held:
                        yield answers()
                        trim()
                    at, held = own, []
                held.append((block, _unpacked_hashes(hashes.as_py())))
        if held:
            yield answers()

    rows = blocks.select("block", "texts").mapInArrow(drawn, "range long, block string, hashes binary")
    return rows.repartition("range").sortWithinPartitions("range").mapInArrow(met, "block string, hashes binary")


_SUFFIX_ROW = "block string, n long, lines binary, least binary, node binary, at binary, beaten binary, digests binary, texts binary"


def _suffixes(blocks: DataFrame, hashes: DataFrame, window: int) -> DataFrame:
    """For each block its deep nodes that other blocks may share, and what its own subtree has decided.

    `lines` has a suffix for each node sent, `least` its smallest id; `at` the windows of that id with their `node`;
    `beaten` a bit for each word at which a window starts that a smaller id of the block has. Only texts with
    such windows are kept, with their digests.
    """

    @frees
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ids, digests, texts, shared in zip(*[c for c in batch.columns], strict=True):
                block = _Block(_unpack(texts.as_py()), window)
                ids = np.frombuffer(ids.as_py(), np.int64)
                digests = digests.as_py()
                shared = np.concatenate([np.zeros(0, np.uint64), *[_unpacked_hashes(h) for h in shared.as_py() or []]])
                lowest = block.lowest_hashes()
                elsewhere = np.isin(lowest, shared)
                # Hashes that two texts of this block have.
                order = np.argsort(lowest, kind="stable")
                runs = np.flatnonzero(np.diff(lowest[order], prepend=~lowest[order[:1]]))
                several = block.text[order[runs]] < block.text[order[np.append(runs[1:], len(order)) - 1]]
                here = np.empty(len(order), bool)
                here[order] = np.repeat(several, np.diff(runs, append=len(order)))
                chosen = np.flatnonzero(elsewhere | here)
                del lowest, order, here
                trim()
                if not len(chosen):
                    continue
                at, text = block.at[chosen], block.text[chosen]
                node, least, one = _deep_nodes(block.suffixes(chosen), ids[text])
                beaten = ids[text] > least[node]
                # In the order of the text, as suffixes that follow each other pack well.
                sent = np.flatnonzero(elsewhere[chosen][one])
                sent = sent[np.argsort(one[sent], kind="stable")]
                number = np.full(len(least), -1)
                number[sent] = np.arange(len(sent))
                waits = ~beaten & (number[node] >= 0)
                touched = np.unique(text[beaten | waits])
                if not len(touched):
                    continue
                # Positions among the words of the texts kept.
                moved = np.zeros(len(ids), np.int64)
                moved[touched] = np.cumsum(block.sizes[touched]) - block.sizes[touched] - block.first[touched]
                at = at + moved[text]
                bits = np.zeros(int(block.sizes[touched].sum()), np.uint8)
                bits[at[beaten]] = 1
                lines = block.lines(chosen[one[sent]])
                columns = {
                    "lines": b"\n".join(lines), "least": least[sent].tobytes(), "node": number[node[waits]].astype(np.int32).tobytes(),
                    "at": at[waits].astype(np.int64).tobytes(), "beaten": np.packbits(bits).tobytes(),
                    "digests": b"".join(digests[32 * i : 32 * i + 32] for i in touched), "texts": b"\n".join([block.whole(i) for i in touched]),
                }
                yield _batch({"block": (pa.string(), [name.as_py()]), "n": (pa.int64(), [len(sent)])} | {k: (pa.binary(), [_pack(v)]) for k, v in columns.items()})

    answers = hashes.groupBy("block").agg(F.collect_list("hashes").alias("hashes"))
    joined = blocks.join(answers, "block", "left").select("block", "ids", "digests", "texts", "hashes")
    return joined.mapInArrow(found, _SUFFIX_ROW)


def _prefix_hashes(lines: list[bytes], depth: int) -> np.ndarray:
    """Hashes of the first `depth` words of each line."""
    known: dict[bytes, int] = {}
    out = np.empty(len(lines), np.uint64)
    for i, line in enumerate(lines):
        prefix = b" ".join(line.split(b" ", depth)[:depth])
        if prefix not in known:
            known[prefix] = xxhash.xxh3_64_intdigest(prefix)
        out[i] = known[prefix]
    return out


def _heavy_prefixes(suffixes: DataFrame, window: int, most: int) -> list[np.ndarray]:
    """Of each length the prefixes with more than `most` suffixes, as hashes; there are total / most of a length at most."""
    heavy: list[np.ndarray] = []
    while len(heavy) < window:
        above = list(heavy)

        @frees
        def counted(batches: Iterator[pa.RecordBatch], above: list = above) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for packed in batch.column(0):
                    lines = _unpack(packed.as_py()).split(b"\n")
                    for depth, known in enumerate(above, 1):
                        under = np.isin(_prefix_hashes(lines, depth), known)
                        lines = [x for x, y in zip(lines, under, strict=True) if y]
                    values, n = np.unique(_prefix_hashes(lines, len(above) + 1), return_counts=True)
                    yield _batch({"prefix": (pa.int64(), values.view(np.int64)), "n": (pa.int64(), n)})

        sums = suffixes.where("n > 0").select("lines").mapInArrow(counted, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
        found = [r["prefix"] for r in sums.where(F.col("n") > most).select("prefix").collect()]
        if not found:
            break
        heavy.append(np.array(found, np.int64).view(np.uint64))
    return heavy


def _outdone(suffixes: DataFrame, heavy: list[np.ndarray], groups: int, window: int) -> DataFrame:
    """For each block the numbers of the suffixes that have a smaller id in another block."""

    @frees
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed, least in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                lines, least = _unpack(packed.as_py()).split(b"\n"), _array(least.as_py(), np.int64)
                group = np.full(len(lines), -1)
                left = np.arange(len(lines))
                for depth in range(1, window + 1):
                    own = _prefix_hashes([lines[i] for i in left], depth)
                    light = ~np.isin(own, heavy[depth - 1]) if depth <= len(heavy) else np.full(len(own), True)
                    light |= depth == window
                    group[left[light]] = (own[light] % np.uint64(groups)).astype(np.int64)
                    left = left[~light]
                    if not len(left):
                        break
                order = np.argsort(group, kind="stable")
                starts = np.flatnonzero(np.diff(group[order], prepend=-1))
                parts = np.split(order, starts[1:])
                yield _batch({
                    "group": (pa.int64(), group[order][starts]), "block": (pa.string(), [block] * len(parts)), "number": (pa.binary(), [_pack(np.diff(p, prepend=0).astype(np.int32).tobytes()) for p in parts]),
                    "lines": (pa.binary(), [_pack(b"\n".join([lines[i] for i in p])) for p in parts]), "least": (pa.binary(), [_pack(least[p].tobytes()) for p in parts]),
                })

    @frees
    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def answers() -> pa.RecordBatch:
            numbers: dict[bytes, int] = {}
            flat = [numbers.setdefault(w, len(numbers)) for _, _, lines, _ in held for line in lines for w in line.split(b" ")]
            least = np.concatenate([x[3] for x in held])
            node, smallest, _ = _deep_nodes(np.array(flat, np.int32).reshape(-1, window), least)
            worse, first, found = least > smallest[node], 0, []
            for block, number, _, own in held:
                lost = number[worse[first : first + len(own)]]
                first += len(own)
                if len(lost):
                    found.append((block, lost.tobytes()))
            return _batch({"block": (pa.string(), [b for b, _ in found]), "numbers": (pa.binary(), [x for _, x in found])})

        for batch in batches:
            for own, block, number, lines, least in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                if own != at:
                    if held:
                        yield answers()
                        trim()
                    at, held = own, []
                held.append((block.as_py(), np.cumsum(_array(number.as_py(), np.int32)).astype(np.int32), _unpack(lines.as_py()).split(b"\n"), _array(least.as_py(), np.int64)))
        if held:
            yield answers()

    rows = suffixes.where("n > 0").select("block", "lines", "least").mapInArrow(dealt, "group long, block string, number binary, lines binary, least binary")
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(built, "block string, numbers binary")


def _cleaned(suffixes: DataFrame, outdone: DataFrame, window: int) -> DataFrame:
    """For each text that loses words: digest, n_removed, kept_sha256, removed (start, stop of each run of words)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    @frees
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, at, beaten, digests, texts, numbers in zip(*batch.columns, strict=True):
                numbers = [np.frombuffer(x, np.int32) for x in numbers.as_py() or []]
                digests, texts = _unpack(digests.as_py()), _unpack(texts.as_py()).split(b"\n")
                words = [t.split(b" ") for t in texts]
                ends = np.cumsum([len(w) for w in words])
                starting = np.unpackbits(_array(beaten.as_py(), np.uint8))[: ends[-1]].astype(np.int64)
                lost = np.isin(_array(node.as_py(), np.int32), np.concatenate([np.zeros(0, np.int32), *numbers]))
                starting[_array(at.as_py(), np.int64)[lost]] = 1
                upto = np.cumsum(starting)
                gone = upto > np.concatenate([np.zeros(window, np.int64), upto])[: len(upto)]
                rows = []
                for i, own in enumerate(words):
                    mask = gone[ends[i] - len(own) : ends[i]]
                    if mask.any():
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).reshape(-1, 2).tolist()
                        kept = b" ".join([own[k] for k in np.flatnonzero(~mask)])
                        rows.append((digests[32 * i : 32 * i + 32], int(mask.sum()), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in edges]))
                if rows:
                    yield _batch(dict(zip(("digest", "n_removed", "kept_sha256", "removed"), zip((pa.binary(), pa.int64(), pa.string(), kind), map(list, zip(*rows, strict=True)), strict=True), strict=True)))

    answers = outdone.groupBy("block").agg(F.collect_list("numbers").alias("numbers"))
    joined = suffixes.select("block", "node", "at", "beaten", "digests", "texts").join(answers, "block", "left")
    return joined.drop("block").mapInArrow(clean, "digest binary, n_removed long, kept_sha256 string, removed array<struct<start:long,stop:long>>")


def repeated_passages(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, removed, digest.

    `removed` has the runs of words (start, stop) that windows cover whose words also stand in a document with a
    smaller id; `kept_sha256` is of the words left, joined by one blank.
    """
    spark = docs.sparkSession
    described = saved(_digested(docs, False), "passages-documents")
    firsts = saved(described.groupBy("digest").agg(F.min("id").alias("least"), F.first("n_words").alias("n")), "passages-texts")
    long = firsts.where(F.col("n") >= window)
    size = long.agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("words")).first()
    wanted = long.select("digest", F.col("least").alias("id"))
    if size["texts"] <= BROADCAST_DIGESTS:
        wanted = F.broadcast(wanted)
    texts = _digested(docs, True).join(wanted, ["digest", "id"], "left_semi").select("id", "digest", "words")
    blocks = saved(_blocks(texts, block_bytes), "passages-blocks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashes = saved(_shared_hashes(blocks, window, max(parts, (size["words"] or 0) // (4 * RANGE_HASHES) + 1)), "passages-hashes")
    suffixes = saved(_suffixes(blocks, hashes, window), "passages-suffixes")
    total = suffixes.agg(F.sum("n")).first()[0] or 0
    # Beyond 25 billion suffixes groups grow with them, as the prefixes that are told to all tasks are bounded.
    most = max(group_suffixes, total // 100_000)
    heavy = _heavy_prefixes(suffixes, window, most) if total > most else []
    outdone = saved(_outdone(suffixes, heavy, max(parts, 2 * total // most + 1), window), "passages-outdone")
    cleaned = saved(_cleaned(suffixes, outdone, window).dropDuplicates(["digest"]), "passages-cleaned")

    out = described.join(firsts.select("digest", "least"), "digest").join(cleaned, "digest", "left")
    copy = (F.col("id") > F.col("least")) & (F.col("n_words") >= window)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"), F.when(copy, whole).otherwise(F.coalesce("removed", none)).alias("removed"), "digest",
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, **how: int) -> DataFrame:
    """doc_id and text of every document, its words without repeated passages joined by one blank."""
    found = repeated_passages(docs, window, **how).select(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "digest", "removed").where(F.size("removed") > 0).dropDuplicates(["id", "digest"])
    words = _digested(docs, True).join(found, ["id", "digest"], "left")
    split = F.split(F.decode("words", "UTF-8"), " ")
    kept = F.filter(split, lambda _, i: ~F.exists("removed", lambda r: (i >= r["start"]) & (i < r["stop"])))
    text = F.when(F.col("removed").isNull(), F.decode("words", "UTF-8")).otherwise(F.array_join(kept, " "))
    return words.select("doc_id", text.alias("text"))
